r"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Every 5-word gram of a text is hashed; from each run of 4 neighbouring grams
(8 words) the least hash is kept, with all its places. A shared span of 8 words
has the same least hash on both sides, so the join of kept hashes finds every
one. A match is then extended word by word, up to three to either side, which
covers every 8-word window that holds the gram; it counts if 8 words agree.
Items of fewer than 8 words are joined on the hash of the whole item.

Each kept hash travels with the three words (as hashes) on either side, so that
the extension needs no second look at the texts and texts are never shuffled.
The benchmark's hashes are broadcast if there are at most ``broadcast_rows`` of
them (counted first); beyond that the join is a shuffled one.

Defined results: a null text has no words; items without words never occur; a
repeated (id, text) row gets its result again; items that repeat an id count
once; an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import TERM, ascii_lower, let

K, RUN = 5, 4
SPAN = K + RUN - 1
SIDE = SPAN - K


def word_hashes(text: Column) -> Column:
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), TERM.replace("[^", "["))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def count_words(text: Column) -> Column:
    """Words before lower-casing, which changes no word's limits."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def fingerprints(words: Column) -> Column:
    """Winnowed grams of an array of word hashes: array of (pos, fp, side words)."""

    def of(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))

        def pick(g: Column) -> Column:
            least = F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.least(*[F.get(g, i + j) for j in range(RUN)]))

            def kept(m: Column) -> Column:
                def chosen(i: Column) -> Column:
                    own = F.get(g, i)
                    out = F.get(m, i) == own
                    for j in range(1, RUN):
                        out = out | (F.get(m, i - j) == own)
                    return out

                places = F.filter(F.sequence(F.lit(0), n - K), chosen)
                sides = [-1, -2, -3, K, K + 1, K + 2]
                return F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(g, i).alias("fp"), F.array(*[F.get(w, i + j) for j in sides]).alias("side")))

            return let(least, kept)

        return F.when(n >= SPAN, let(grams, pick))

    return let(words, of)


def short_grams(words: Column, m: int) -> Column:
    """Hashes of all runs of ``m`` words: array of (pos, fp)."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= m, F.transform(F.sequence(F.lit(0), n - m), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(w, i + j) for j in range(m)]).alias("fp"))))

    return let(words, of)


def _agree(first: list[Column]) -> Column:
    """How many of the comparisons hold before the first that doesn't."""
    out = F.lit(0)
    for k in range(len(first), 0, -1):
        ok = F.coalesce(first[k - 1], F.lit(False))
        out = F.when(ok, 1 + out).otherwise(0)
    return out


def hits(docs: DataFrame, items: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs``: key columns and ``text``; ``items``: ``item_id``, ``text`` -> one row per
    match: key columns, item_id, first word and last word (exclusive) of the hit."""
    keys = [c for c in docs.columns if c != "text"]
    own = items.select("item_id", word_hashes(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    own = own.where("n > 0")
    marks = own.where(F.col("n") >= SPAN).select("item_id", F.inline(fingerprints(F.col("w")))).select("fp", "item_id", F.col("side").alias("item_side")).distinct()
    words = docs.select(*keys, word_hashes(F.col("text")).alias("w"))
    d = words.select(*keys, F.inline(fingerprints(F.col("w"))))
    sized = F.broadcast(marks) if marks.limit(broadcast_rows + 1).count() <= broadcast_rows else marks
    same = [F.get(F.col("side"), F.lit(j)) == F.get(F.col("item_side"), F.lit(j)) for j in range(2 * SIDE)]
    found = d.join(sized, "fp").select(*keys, "item_id", "pos", _agree(same[:SIDE]).alias("l"), _agree(same[SIDE:]).alias("r")).where(F.col("l") + F.col("r") >= SIDE)
    out = found.select(*keys, "item_id", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + K + F.col("r")).alias("last"))
    for (m,) in own.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect():  # at most 7 lengths
        short = own.where(F.col("n") == m).select("item_id", F.inline(short_grams(F.col("w"), m))).select("fp", "item_id").distinct()
        sized = F.broadcast(short) if short.limit(broadcast_rows + 1).count() <= broadcast_rows else short
        d = words.select(*keys, F.inline(short_grams(F.col("w"), m)))
        out = out.unionByName(d.join(sized, "fp").select(*keys, "item_id", F.col("pos").alias("first"), (F.col("pos") + m).alias("last")))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside a hit), ``items`` (ids found, as sorted strings)."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    b = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    found = hits(d, b, broadcast_rows)
    # a document's hits are bounded by its length
    per = found.groupBy("id", "h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("first"), F.col("last") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    base = d.select("id", "h", count_words(F.col("text")).alias("n_words")).alias("b")
    out = base.join(per.alias("p"), F.expr("b.id <=> p.id AND b.h = p.h"), "left")
    return out.select(F.col("b.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate(docs, items)
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(8, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM m)),
x AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM m) WHERE len(w) >= n)),
h AS (SELECT x.rid, x.p, x.n, g.item_id FROM x JOIN g USING (n, s)),
q AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN q USING (rid) LEFT JOIN t USING (rid)
"""
