"""Toxicity by a factorization machine over hashed terms.

The score of a text is a logistic function of a bias, a weight per term and, for
every pair of its terms, the inner product of their factors, so that pairs of
terms (an insult with a mention of a group) count beyond the sum of both.
Trained on a bounded sample of labelled rows outside the held-out fold; of
these only hashed term lists come to the driver. A fifth of the sample, kept
from a first fit, tells where the cut between the labels lies, and the bias is
moved so that this cut is a score of 0.5.

Defined results: a null or empty text has no terms and gets the bias's score;
null ids belong to no fold and are not trained on; labels without a text and
texts without a label are not trained on; one output row per input row; without
labels of both kinds the score is the share of label 1; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import small_batches

@dataclass(frozen=True)
class Params:
    bits: int = 18
    factors: int = 4
    epochs: int = 16
    batch: int = 128
    rate: float = 20.0
    spread: float = 0.1
    l2: float = 1e-4
    least_rows: int = 10
    sample_rows: int = 12_000
    least_calibration: int = 30
    seed: int = 5


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factor: np.ndarray
    bits: int

    def margins(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _margins(self.bias, self.linear, self.factor, idx, off)[0]


class TermBucket(dict):
    """Bucket of a term (already masked to ``bits``), remembered up to a bound."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, term: bytes) -> int:
        h = xxhash.xxh32_intdigest(term) & self.mask
        if len(self) < 500_000 and len(term) <= 64:
            self[term] = h
        return h


_NOT_TERM = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_SPACED = bytes.maketrans(_NOT_TERM, b" " * len(_NOT_TERM))


def term_buckets(text: bytes, known: TermBucket) -> np.ndarray:
    """Distinct hashed terms (lower-cased runs of letters, digits and non-ASCII)."""
    terms = set(text.translate(_SPACED).lower().split())
    return np.unique(np.fromiter(map(known.__getitem__, terms), np.int64, len(terms)))


def _margins(bias, linear, factor, idx, off, scale=None):
    n = np.diff(off)
    x = np.repeat(1.0 / (np.sqrt(np.maximum(n, 1)) if scale is None else scale), n)
    row = np.repeat(np.arange(len(n)), n)
    lin = np.bincount(row, x * linear[idx], len(n))
    vx = factor[idx] * x[:, None]
    total = np.stack([np.bincount(row, vx[:, f], len(n)) for f in range(factor.shape[1])], 1)
    square = np.bincount(row, (vx * vx).sum(1), len(n))
    return bias + lin + 0.5 * ((total * total).sum(1) - square), (x, row, vx, total)


def train(idx: np.ndarray, off: np.ndarray, y: np.ndarray, p: Params) -> Machine:
    """Gradient steps on the logistic loss, in mini-batches of a fixed shuffle, shrinking to zero; classes weigh the same in sum."""
    dim, rng = 1 << p.bits, np.random.default_rng(p.seed)
    share = float(y.mean()) if len(y) else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < share < 1:
        return Machine(bias, np.zeros(dim, np.float32), np.zeros((dim, p.factors), np.float32), p.bits)
    # buckets of few rows teach nothing that holds elsewhere; the rest are numbered without gaps
    n = np.diff(off)
    common = np.bincount(idx, minlength=dim) >= p.least_rows
    use, column = common[idx], (np.cumsum(common) - 1).astype(np.int32)
    idx, off = column[idx[use]], np.r_[0, np.cumsum(use, dtype=np.int32)][off]
    width = int(common.sum())
    linear, factor = np.zeros(width), rng.normal(0, p.spread, (width, p.factors))
    scale = np.sqrt(np.maximum(n, 1))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    n = np.diff(off)
    steps, step = p.epochs * -(-len(y) // p.batch), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), p.batch):
            rows = order[s : s + p.batch]
            o = np.r_[0, np.cumsum(n[rows])]
            ids = idx[np.repeat(off[rows] - o[:-1], n[rows]) + np.arange(o[-1])]
            m, (x, row, vx, total) = _margins(bias, linear, factor, ids, o, scale[rows])
            err = weight[rows] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows])
            own = np.bincount(ids, minlength=width) > 0
            e = err[row] * x
            inner = total[row] - vx
            d_lin = np.bincount(ids, e, width)[own] / len(rows) + p.l2 * linear[own]
            d_fac = np.stack([np.bincount(ids, e * inner[:, f], width)[own] for f in range(p.factors)], 1) / len(rows) + p.l2 * factor[own]
            rate = p.rate * (1 - step / steps)
            linear[own] -= rate * d_lin
            factor[own] -= rate * d_fac
            bias -= 0.3 * float(err.mean())
            step += 1
    every, pairs = np.zeros(dim, np.float32), np.zeros((dim, p.factors), np.float32)
    every[common], pairs[common] = linear, factor
    return Machine(bias, every, pairs, p.bits)


def best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin that parts the labels with the greatest F1; of equals the one nearest 0."""
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(m) + 1) + hit[-1])
    ends = np.flatnonzero(np.r_[m[:-1] > m[1:], False])  # rows of the same margin aren't parted
    if not len(ends):
        return 0.0
    best = ends[f1[ends] >= f1[ends].max() - 1e-12]
    cuts = (m[best] + m[best + 1]) / 2
    return float(cuts[np.argmin(np.abs(cuts))])


def calibrated(idx: np.ndarray, off: np.ndarray, y: np.ndarray, p: Params) -> Machine:
    """A machine of all rows, its bias moved by the best cut that a machine of four fifths finds on the other fifth.

    With fewer than ``p.least_calibration`` rows of either label in that fifth the bias stays.
    """
    machine = train(idx, off, y, p)
    aside = np.arange(len(y)) % 5 == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < p.least_calibration:
        return machine
    of = np.repeat(aside, np.diff(off))
    ends = lambda part: np.r_[0, np.cumsum(np.diff(off)[part])]
    trial, put, at = train(idx[~of], ends(~aside), y[~aside], p), idx[of], ends(aside)
    rows = np.arange(len(at) - 1)
    # in blocks, as a row's terms take several arrays of their length
    margins = [trial.margins(put[at[b[0]] : at[b[-1] + 1]], at[b[0] : b[-1] + 2] - at[b[0]]) for b in np.split(rows, rows[256::256])]
    return Machine(machine.bias - best_cut(np.concatenate(margins), y[aside]), machine.linear, machine.factor, machine.bits)


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from at most ``p.sample_rows`` labelled rows (least digests of the id) outside fold 0."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(fold(F.col("id")) != 0).orderBy(F.md5(F.col("id").cast("string")), "id", "y").limit(p.sample_rows)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    picked = d.join(F.broadcast(rows), "id").select("id", "y", "t")
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches):
        known = TermBucket(p.bits)
        for b in batches:
            idx = [term_buckets(raw.as_py(), known) for raw in pc.fill_null(b.column(2), "").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.list_(pa.int32()))], ["id", "y", "idx"])

    got = picked.mapInArrow(run, f"id {id_type}, y int, idx array<int>").toPandas().sort_values("id", kind="stable")
    n = got["idx"].map(len).to_numpy(np.int64) if len(got) else np.empty(0, np.int64)
    idx = np.concatenate([np.asarray(x, np.int32) for x in got.pop("idx")]) if n.sum() else np.empty(0, np.int32)
    return calibrated(idx, np.r_[0, np.cumsum(n)], got["y"].to_numpy(np.float64), p)


def score_of(spark: SparkSession, text: Column, machine: Machine) -> Column:
    """The score of a text: only the texts go to Python and only the scores come back."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known = TermBucket(m.bits)
        for column in columns:
            raw = pc.fill_null(column, "").cast(pa.binary())
            margins = [np.empty(0)]
            for start in range(0, len(raw), 256):
                idx = [term_buckets(x.as_py(), known) for x in raw.slice(start, 256)]
                off = np.r_[0, np.cumsum([len(x) for x in idx])]
                margins.append(m.margins(np.concatenate(idx), off))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(margins), -30, 30))), pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``."""
    s = docs.select(F.col(id_col), score_of(docs.sparkSession, F.col(text_col), machine).alias("score"))
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))
    return s.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels))
