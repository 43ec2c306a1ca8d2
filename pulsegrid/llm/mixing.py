"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, passed over up to
three times; a copy's virtual finish time is the source's cumulative size
divided by its target. Copies are range-sorted by finish time over all sources
and the sequence is cut at the total budget.

At scale: only ids, sources and sizes are shuffled, never texts. Cumulative
sizes come from sums per hash bucket of a source (4,096 buckets, so a source
with a third of all rows is spread) plus a running sum within a bucket. The
range sort goes by fixed ranges of finish time: the sums per range tell which
one holds the cut, and only that range is sorted row by row; the cut is then
one finish time that every row is compared with.

Defined results: a null text has size 0 and is taken 0 times; null sources form
one source, last in order; repeated ids are separate documents; sources without
words have target 0; an empty table gives an empty table. The order is fixed by
a digest of the id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
RANGES = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source``, ``source_size`` -> also ``rank`` and ``target``.

    Targets are ``min(most * size, level * weight)`` with the level at which they
    add up to the sum of all sizes: what sharing an excess by weight, again and
    again, ends in. One row per source goes through a single window.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("double")
    s = sizes.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    upto = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy((F.col("cap") / F.col("w")).desc(), F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("open", F.col("cap") / F.col("w") > F.col("level"))
    # the first open source in order of cap / w sets the level; levels never fall before it
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)
    s = s.withColumn("first", first)
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("w")))
    return s.select("source", "source_size", "rank", target.alias("target"))


def weighted_fair_mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: id, source, size, source_size, target, ``copies`` (0 to ``most``),
    ``taken`` (copies times size) and ``finish`` (virtual finish time of its first copy)."""
    spark = df.sparkSession
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    d = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size")).withColumn("key", key)
    d = materialize(spark, d, "mix-sizes").withColumn("bucket", F.substring("key", 1, 3))
    per_bucket = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    per_bucket = per_bucket.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "b.bucket", "b.base", "t.source_size", "t.rank", "t.target")
    within = W.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("size").over(within)).alias("d").join(per_bucket.alias("p"), F.expr("d.source <=> p.source AND d.bucket = p.bucket"))
    d = d.select("id", "d.source", "size", "source_size", "rank", "target", (F.col("base") + F.col("run")).alias("upto"))
    d = materialize(spark, d, "mix-queues")
    budget = d.agg(F.sum("size")).first()[0] or 0

    finish = [F.try_divide((F.lit(k) * F.col("source_size") + F.col("upto")).cast("double"), F.col("target")) for k in range(most)]
    copies = d.where("size > 0").select("size", "rank", F.explode(F.array(*finish)).alias("f"))
    # ranges of equal width below 2, of equal ratio beyond
    copies = copies.withColumn("range", F.when(F.col("f") < 2, F.floor(F.col("f") * RANGES)).otherwise(2 * RANGES + F.floor(F.log2("f") * 64)).cast("long"))
    sums = copies.groupBy("range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)))
    cut = sums.where(F.col("upto") > budget).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before")))).first()[0]
    if cut is None:  # no words at all
        taken = F.lit(0)
    else:
        within = W.orderBy("f", "rank").rowsBetween(W.unboundedPreceding, 0)
        at = copies.where(F.col("range") == cut["range"]).withColumn("sum", F.sum("size").over(within))
        last = at.where(F.col("sum") + cut["before"] <= budget).agg(F.max(F.struct("f", "rank"))).first()[0]
        edge = (last["f"], last["rank"]) if last else (None, None)
        taken = sum((_taken(f, cut["range"], edge).cast("int") for f in finish), F.lit(0))
        taken = F.when(F.col("size") > 0, taken).otherwise(0)
    out = d.withColumn("copies", taken.cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.when(F.col("size") > 0, finish[0]).alias("finish"))


def _taken(f: Column, at: int, edge: tuple) -> Column:
    where = F.when(f < 2, F.floor(f * RANGES)).otherwise(2 * RANGES + F.floor(F.log2(f) * 64))
    if edge[0] is None:
        return where < at
    return (where < at) | ((where == at) & ((f < edge[0]) | ((f == edge[0]) & (F.col("rank") <= edge[1]))))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return weighted_fair_mix(docs, n_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w DESC, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM w),
f AS (SELECT level FROM l WHERE cap / w > level ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN (SELECT count(*) FROM f) = 0 THEN cap ELSE least(cap, (SELECT level FROM f) * w) END AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, rank, (k * source_size + upto)::DOUBLE / target AS f FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0),
o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY f, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
