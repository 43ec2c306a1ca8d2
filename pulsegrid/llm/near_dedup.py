"""Near-duplicates by one-permutation MinHash with optimal densification.

1. Each text becomes the sorted set of its shingle hashes; equal sets form a
   class, so copies cost one row from here on.
2. A class's set is cut into 256 bins by the top bits of the hashes; the least
   hash of each bin is the signature, empty bins borrow from a full one in an
   order of their own (a random permutation per bin). 42 bands of 6 bins are the
   bucket keys: a pair of similarity 0.8 shares a bucket but for 3 in a million.
3. Candidate edges are stars: the centre of a bucket is the member that shares
   most with others over all its buckets, and each member is compared with the
   best of its centres.
4. Where a bucket still holds several components, each member's set is taken as
   its difference to the bucket's centre. Members linked with the centre join it.
   Others are similar to each other only if their differences share a known
   number of elements, so only members of different components that share one of
   the rarest elements of their differences are compared. A group of members that
   share one and would make more than ``MOST`` pairs a member is a bucket again,
   with a centre of its own, and step 4 is done again: a star loses no link, and
   no large group is compared pair by pair. A member's centres fall in rank from
   round to round, so the rounds end.
5. Components are found by hooking and contraction, whose rounds grow with the
   logarithm of the graph.

Intermediate tables are written to the shared folder; only counts come to the
driver. Centres of many members are salted, so that no task gets all of them.

Defined results: texts that are null or have no words have no shingles and are
linked with nothing; rows with a null id are never linked and have no component;
rows that repeat an id are linked as their own texts are; one output row per
input row; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialize, small_batches

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
#: Members that share an element are compared pair by pair up to so many pairs a member; else they form a bucket.
MOST = 4096
#: A centre's set is sent once for so many members.
SALTED = 256
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, size=BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: _TURN[i, j]: when the empty bin i asks the bin j.
_TURN = np.argsort(np.random.default_rng(11).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000 and len(word) <= 32:
            self[word] = h
        return h


def shingle_set(text: bytes, size: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's word runs of ``size``; fewer words are one shingle."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(n, size)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h + w[j : n - k + 1 + j])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash of each of ``BINS`` bins, densified; ``shingles`` is sorted and not empty."""
    bin_of = (shingles >> np.uint64(56)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    full = bin_of[first]
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = shingles[first[np.argmin(_TURN[empty[:, None], full[None, :]], axis=1)]]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = (sig[: BANDS * ROWS] * _MULTIPLIERS[: BANDS * ROWS]).reshape(BANDS, ROWS)
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, h (digest of the text), n (shingles), sig (digest of the set, null if empty), bands."""
    d = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches):
        known = WordHash()
        for b in batches:
            n, sig, keys = [], [], []
            for raw in pc.fill_null(b.column(2), "").cast(pa.binary()):
                s = shingle_set(raw.as_py(), size, known)
                n.append(len(s))
                sig.append(_digest(s) if len(s) else None)
                if len(s):
                    keys.append(bands(signature(s)))
            lengths = np.r_[0, np.cumsum([BANDS if x else 0 for x in n])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], ["id", "h", "n", "sig", "bands"])

    return d.mapInArrow(run, f"id {id_type}, h long, n int, sig binary, bands array<long>")


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """t -> sig, s (bytes of the sorted shingle hashes)."""

    def run(batches):
        known = WordHash()
        for b in batches:
            sets = [shingle_set(raw.as_py(), size, known) for raw in pc.fill_null(b.column(0), "").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "s"])

    return texts.select("t").mapInArrow(run, "sig binary, s binary")


def _sets(spark: SparkSession, nodes: DataFrame, docs: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """x, sig, s of the classes in ``nodes`` (x, sig, id)."""
    ids = nodes.select("id").distinct()
    # counted, so that only a table of a known size is broadcast; beyond that the join is a shuffled one
    ids = F.broadcast(ids) if nodes.count() <= broadcast_rows else ids
    # (an id can stand on several rows and texts; the digest tells which set is meant, and each is kept once)
    found = shingle_sets(docs.join(ids, "id", "left_semi"), size).groupBy("sig").agg(F.first("s").alias("s"))
    return materialize(spark, nodes.select("x", "sig").join(found, "sig"), "near-sets")


def _pairs_with_sets(pairs: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    """pairs of ``left`` and ``right`` (named as in ``sets``: x or sig) with both sets; a hot ``left`` is salted."""
    key = "x" if "x" in (left, right) else "sig"
    hot = pairs.groupBy(left).agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64(right), F.greatest(F.col("salts"), F.lit(1))).cast("int")
    dealt = pairs.join(hot, left).withColumn("salt", salt).drop("salts")
    one = hot.join(sets.select(F.col(key).alias(left), F.col("sig").alias("sig_l"), F.col("s").alias("sl")), left)
    one = one.select(left, "sig_l", "sl", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = sets.select(F.col(key).alias(right), F.col("sig").alias("sig_r"), F.col("s").alias("sr"))
    return dealt.join(other, right).join(one, [left, "salt"])


def confirm(pairs: DataFrame, sets: DataFrame, left: str, right: str, percent: int) -> DataFrame:
    """a, b: the digests of the pairs whose full sets reach the similarity."""
    p = _pairs_with_sets(pairs, sets, left, right).select("sig_l", "sig_r", "sl", "sr")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return p.mapInArrow(run, "a binary, b binary")


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 64) -> DataFrame | None:
    """node, comp: the least node reachable, by hooking and contraction; nodes without edges are absent (None if all are).

    Each round every node hooks onto its least neighbour. Only two nodes can hook onto
    each other (the lesser is the root then), longer cycles cannot be; each root takes
    in another node at least, so the nodes that still have edges are halved.
    """
    graph = materialize(spark, edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "near-graph")
    own = None
    for _ in range(most_rounds):
        if not graph.limit(1).count():
            break
        hook = graph.groupBy("a").agg(F.min("b").alias("up"))
        back = hook.select(F.col("a").alias("up"), F.col("up").alias("back"))
        root = hook.join(back, "up").select(F.col("a").alias("node"), F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up"))
        root = _roots(spark, materialize(spark, root, "near-hooks"), most_rounds)
        if own is None:
            own = root
        else:
            later = root.select(F.col("node").alias("up"), F.col("up").alias("top"))
            own = materialize(spark, own.join(later, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "near-labels")
        x, y = (root.select(F.col("node").alias(c), F.col("up").alias("r" + c)) for c in "ab")
        graph = graph.join(x, "a").join(y, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        graph = materialize(spark, graph, "near-graph")
    else:
        if graph.limit(1).count():
            raise RuntimeError(f"components: edges are left after {most_rounds} rounds")
    if own is None:
        return None
    least = own.groupBy("up").agg(F.min("node").alias("comp"))
    return materialize(spark, own.join(least, "up").select("node", "comp"), "near-labels")


def _roots(spark: SparkSession, up: DataFrame, most_rounds: int) -> DataFrame:
    """node, up: the root of each node's tree; each round halves the way to it."""
    for _ in range(most_rounds):
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = materialize(spark, up.join(jump, "up").select("node", F.col("up").alias("old"), F.col("top").alias("up")), "near-hooks")
        up = new.select("node", "up")
        if not new.where("old <> up").limit(1).count():
            return up
    raise RuntimeError(f"components: no roots after {most_rounds} rounds")


def _best_centres(members: DataFrame, percent: int) -> DataFrame:
    """centre, x: for each member of buckets (key, x, n, pop) the best centre of about its size."""
    centre = members.groupBy("key").agg(F.max_by(F.struct("x", "n", "pop"), F.struct("pop", "x")).alias("c"))
    near = members.join(centre, "key").where(f"x <> c.x AND 100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
    return near.groupBy("x").agg(F.max_by("c.x", F.struct("c.pop", "c.x")).alias("centre"))


def _stars(members: DataFrame, key: list[str]) -> DataFrame:
    """centre, x: every member of a bucket with its centre, the one of highest rank: of small size, then popular."""
    rank = F.struct((-F.floor(F.log("n") / F.log(F.lit(1.1)))).alias("small"), "pop", "x")
    own = members.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], "x", rank.alias("rank"))
    names = [f"k{i}" for i in range(len(key))]
    top = own.groupBy(*names).agg(F.max_by("x", "rank").alias("centre"))
    return own.drop("rank").join(top, names).where("x <> centre").select("centre", "x").distinct()


def _differences(spark: SparkSession, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """centre, sig, x, n, nc, linked, diff: how each member's set differs from its centre's.

    ``n`` and ``nc`` are the sizes of the member's and the centre's set, ``diff`` is
    their symmetric difference, ``linked`` tells whether they reach the similarity.
    """
    pairs = _pairs_with_sets(stars, sets, "centre", "x")
    names = ["centre", "sig", "x", "n", "nc", "linked", "diff"]

    def run(batches):
        for batch in batches:
            n, nc, linked, diffs = [], [], [], []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                d = np.setxor1d(u, v, assume_unique=True)
                total = len(u) + len(v)
                n.append(len(u))
                nc.append(len(v))
                linked.append((100 + percent) * len(d) <= (100 - percent) * total)
                diffs.append(d.view(np.int64))
            ends = np.r_[0, np.cumsum([len(d) for d in diffs])].astype(np.int32)
            flat = np.concatenate(diffs) if diffs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int32()), pa.array(nc, pa.int32()), pa.array(linked, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names)

    schema = "centre binary, sig binary, x long, n int, nc int, linked boolean, diff array<long>"
    return materialize(spark, pairs.select("sig_l", "sig_r", "x", "sr", "sl").mapInArrow(run, schema), "near-differences")


def _sharing(diffs: DataFrame, label: DataFrame | None, percent: int) -> DataFrame:
    """centre, e, sig, x, n, comp, linked, d, first, rest: the elements by which members of one
    centre, in different components, can still be found to be similar.

    Sets x and y are similar if |x ^ y| <= f (|x| + |y|), f = (100 - percent) / (100 + percent).
    With dx = x ^ c and dy = y ^ c, |x ^ y| = |dx| + |dy| - 2 |dx & dy|, and
    |dy| > f (|y| + |c|) where y isn't linked with the centre. So dx and dy share more
    than (|dx| + f (|c| - |x|)) / 2 elements if y isn't linked with c, and at least
    (|dx| - f (|x| + |c|)) / 2 if it is. By the pigeonhole principle the rarest elements
    of dx, up to that many from the end, meet those of dy; elements of
    a single member meet none. Two members linked with the centre are in one component.
    """
    up, down = 100 + percent, 100 - percent
    diffs = _labelled(diffs, label)
    several = diffs.groupBy("centre").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("centre")
    diffs = diffs.join(several, "centre", "left_semi")
    each = diffs.select("centre", "sig", F.explode("diff").alias("e"))
    shared = each.groupBy("centre", "e").agg(F.count("*").alias("c")).where("c > 1")
    found = each.join(shared, ["centre", "e"]).groupBy("centre", "sig").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("es"))
    sized = found.join(diffs.select("centre", "sig", "x", "n", "nc", "linked", "comp", F.size("diff").cast("long").alias("d")), ["centre", "sig"])
    alone = F.expr("d - size(es)")
    short = F.expr(f"d - ({up}L * d + {down} * (nc - n)) div {2 * up}")
    most = F.expr(f"d - ({up}L * d - {down} * (nc + n) + {2 * up - 1}) div {2 * up} + 1")
    placed = sized.select("centre", "sig", "x", "n", "comp", "linked", short.alias("near"), "d", alone.alias("alone"), F.posexplode(F.slice("es", 1, F.greatest(F.when(F.col("linked"), short).otherwise(F.greatest(short, most)) - alone, F.lit(0)).cast("int"))).alias("at", "ce"))
    return placed.select("centre", F.col("ce.e").alias("e"), "sig", "x", "n", "comp", "linked", "d", (F.col("alone") + F.col("at") < F.col("near")).alias("first"), (F.col("d") - F.col("alone") - F.col("at")).alias("rest"))


def _small_groups(placed: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Pairs of members that share a placed element.

    Of an element that is the first they share, what follows in both must be enough
    for the number that the two sizes call for.
    """
    up, down = 100 + percent, 100 - percent
    placed = placed.join(small, ["centre", "e"], "left_semi")
    side = ["sig", "n", "comp", "linked", "d", "first", "rest"]
    x, y = (placed.select("centre", "e", *[F.col(c).alias(c + k) for c in side]) for k in "xy")
    near = x.where("NOT linkedx").join(y.where("firsty"), ["centre", "e"])
    enough = f"{2 * up}L * least(restx, resty) >= {up} * (dx + dy) - {down} * (nx + ny)"
    near = near.where(f"compx <> compy AND {enough} AND (linkedy OR firstx AND sigx < sigy) AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    return near.select(F.least("sigx", "sigy").alias("a"), F.greatest("sigx", "sigy").alias("b")).distinct()


def _labelled(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """``nodes`` (sig, ...) with ``comp``; a class without a label is a component by itself."""
    if label is None:
        return nodes.withColumn("comp", F.col("sig"))
    named = label.select(F.col("node").alias("sig"), F.col("comp").alias("own"))
    return nodes.join(named, "sig", "left").withColumn("comp", F.coalesce("own", "sig")).drop("own")


def _merge(spark: SparkSession, label: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """node, comp after further edges (a, b); the graph of the components so far is what is labelled."""
    if label is None:
        return components(spark, edges)
    ends = edges
    for c in "ab":
        ends = ends.join(label.select(F.col("node").alias(c), F.col("comp").alias("c" + c)), c, "left")
    new = components(spark, ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    if new is None:
        return label
    old = label.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return materialize(spark, old.unionByName(new.join(label, "node", "left_anti").select("node", "comp")), "near-labels")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, broadcast_rows: int = 500_000, detail: bool = False) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    With ``detail`` also ``h`` (xxhash64 of the text) and ``first``: whether the row's id
    and text are the ones that stand for the component, also where ids are repeated.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = materialize(spark, sketch(df, id_col, text_col, shingle), "near-sketch")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(spark, classes.withColumn("x", F.xxhash64("sig")), "near-classes")
    reps = rows.join(classes.select(F.col("sig").alias("s2"), "rep", "x"), F.expr("id = rep AND sig = s2")).select("x", "n", F.explode("bands").alias("key"))
    keys = reps.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    held = materialize(spark, reps.join(keys.select("key", "c"), "key"), "near-buckets")
    pop = held.groupBy("x").agg(F.first("n").alias("n"), F.sum(F.log2("c")).alias("pop"))
    nodes = materialize(spark, pop.join(classes.select("x", "sig", F.col("rep").alias("id")), "x"), "near-nodes")
    sets = _sets(spark, nodes, docs, shingle, broadcast_rows)
    members = held.select("key", "x").join(nodes.select("x", "n", "pop"), "x")
    label = _merge(spark, None, confirm(_best_centres(members, percent), sets, "centre", "x", percent))

    comp = _labelled(nodes, label).select("x", "comp")
    several = held.select("key", "x").join(comp, "x").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    stars = _stars(members.join(several, "key", "left_semi"), ["key"])
    while True:
        stars = materialize(spark, stars, "near-stars")
        if not stars.limit(1).count():
            break
        diffs = _differences(spark, stars, sets, percent)
        label = _merge(spark, label, diffs.where("linked").select(F.col("centre").alias("a"), F.col("sig").alias("b")))
        placed = materialize(spark, _sharing(diffs, label, percent), "near-placed")
        groups = placed.groupBy("centre", "e", "comp").agg(F.count("*").alias("k")).groupBy("centre", "e").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("same"))
        groups = groups.select("centre", "e", (F.col("c") * F.col("c") - F.col("same") > 2 * MOST * F.col("c")).alias("large")).where("c * c > same")
        pairs = materialize(spark, _small_groups(placed, groups.where("NOT large").select("centre", "e"), percent), "near-pairs")
        label = _merge(spark, label, confirm(pairs, sets, "a", "b", percent))
        large = placed.select("centre", "e", "x").join(groups.where("large").select("centre", "e"), ["centre", "e"])
        stars = _stars(large.join(nodes.select("x", "n", "pop"), "x"), ["centre", "e"])

    if label is None:
        named = classes.where("copies > 1").select("sig", F.col("rep").alias("cid"), F.col("sig").alias("stands"))
    else:
        known = _labelled(classes.select("sig", "rep", "copies"), label)
        least = label.join(classes.select(F.col("sig").alias("node"), "rep"), "node").groupBy("comp").agg(F.min(F.struct("rep", F.col("node").alias("sig"))).alias("least"))
        named = known.join(least, "comp", "left").where("copies > 1 OR least IS NOT NULL").select("sig", F.coalesce("least.rep", "rep").alias("cid"), F.coalesce("least.sig", "sig").alias("stands"))
    # a class of one row without links is its own component, so hot classes alone make the left side uneven, which is split
    out = rows.select("id", "h", "n", "sig").join(named.withColumnRenamed("sig", "of"), F.col("sig") == F.col("of"), "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("cid", "id"))
    same = F.coalesce(comp == F.col("id"), F.lit(True))
    extra = [F.col("h"), (same & F.coalesce(F.col("stands") == F.col("sig"), F.lit(True))).alias("first")] if detail else []
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), comp.alias("component_id"), same.alias("kept"), *extra)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)
