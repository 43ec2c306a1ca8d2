"""Quality rules as a short-circuit cascade.

Each rule reads a few lazily computed features of a text. On a bounded sample
every rule is evaluated in full to learn which documents it rejects and what
its features cost; rules are then ordered greedily by rejections per cost among
the documents that earlier rules let through, and the whole table is run
through the cascade, stopping at the first rule that rejects.

Defined results: a null text is an empty text, which fails ``min_words``; ties,
repeated rows and extra columns are carried through row by row (one output row
per input row); an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"


class Text:
    """Features of one text, each computed at most once and only when asked for."""

    def __init__(self, raw: bytes, n_chars: int):
        self.raw, self.n_chars = raw, n_chars

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.n_chars - (len(self.raw) - len(b"".join(self.words)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_digits(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"0123456789"))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur at least twice."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), np.int64, n)
        v = len(ids)
        pair = w[:-1] * v + w[1:]
        if v >= 1 << 20:  # keeps the code of a window within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        code = pair[:-1] * v + w[2:]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        if not same.any():
            return 0
        hot = np.zeros(n - 2, bool)
        hot[order[1:][same]] = True
        hot[order[:-1][same]] = True
        mark = np.zeros(n, bool)
        mark[:-2] |= hot
        mark[1:-1] |= hot
        mark[2:] |= hot
        return int(mark.sum())


@dataclass(frozen=True)
class Rule:
    """``fails`` tells whether a text is rejected."""

    name: str
    fails: Callable[[Text], bool]


def default_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_ratio: float = 0.3, word_len: tuple[float, float] = (2.0, 20.0), max_dup_line_pct: int = 50, max_digit_ratio: float = 0.5) -> list[Rule]:
    """The two base rules first, then symbol, word-length, line and digit rules."""
    return [
        Rule("min_words", lambda t: t.n_words < min_words),
        Rule("repeat_words", lambda t: 100 * t.n_repeat_words > max_repeat_pct * t.n_words),
        Rule("symbols", lambda t: t.n_symbols > max_symbol_ratio * t.n_words),
        Rule("word_length", lambda t: not word_len[0] * t.n_words <= t.word_chars <= word_len[1] * t.n_words),
        Rule("dup_lines", lambda t: 100 * t.n_dup_lines > max_dup_line_pct * len(t.lines)),
        Rule("digits", lambda t: t.n_digits > max_digit_ratio * max(1, t.n_chars)),
    ]


def _texts(column: pa.Array):
    column = pc.fill_null(column, "")
    chars = pc.utf8_length(column).to_pylist()
    for raw, n in zip(column.cast(pa.binary()), chars, strict=True):
        yield Text(raw.as_py(), n)


def plan_cascade(df: DataFrame, rules: list[Rule], text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 2000, n_rows: int | None = None) -> list[int]:
    """Order of the rules, from a hash sample of about ``sample_rows`` rows.

    Only one line per combination of failed rules comes to the driver.
    """
    n = df.count() if n_rows is None else n_rows
    if not n:
        return list(range(len(rules)))
    parts = 1_000_000
    keep = min(parts, max(1, -(-sample_rows * parts // n)))
    sample = df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)) < keep).select(F.col(text_col).alias("t"))

    def measure(batches):
        for b in batches:
            masks, costs = [], []
            for t in _texts(b.column(0)):
                mask, cost = 0, []
                for k, rule in enumerate(rules):
                    own = Text(t.raw, t.n_chars)
                    began = time.perf_counter_ns()
                    failed = rule.fails(own)
                    cost.append(time.perf_counter_ns() - began)
                    mask |= failed << k
                masks.append(mask)
                costs.append(cost)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(costs, pa.list_(pa.int64()))], ["mask", "ns"])

    out = sample.mapInArrow(measure, "mask long, ns array<long>")
    rows = out.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(F.col("ns")[k]).alias(f"c{k}") for k in range(len(rules))]).collect()
    return order_rules([(r["mask"], r["n"]) for r in rows], [sum(r[f"c{k}"] for r in rows) for k in range(len(rules))])


def order_rules(masks: list[tuple[int, int]], costs: list[float]) -> list[int]:
    """Greedy: next comes the rule that rejects most of what is left, per cost."""
    left, order = dict(masks), []
    while len(order) < len(costs):
        rest = [k for k in range(len(costs)) if k not in order]
        best = max(rest, key=lambda k: (sum(n for m, n in left.items() if m >> k & 1) / max(costs[k], 1), -costs[k], -k))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def quality_cascade(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 2000, order: list[int] | None = None) -> DataFrame:
    """Per row: id, counts, ``kept``, ``rejected_by`` (the first rule of the cascade
    that rejects, else null) and ``n_rules_run``."""
    rules = rules or default_rules()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    order = order or plan_cascade(docs, rules, "t", "id", sample_rows)
    chain = [rules[k] for k in order]
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for t in _texts(b.column(1)):
                hit = next((i for i, r in enumerate(chain) if r.fails(t)), None)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, hit is None, None if hit is None else chain[hit].name, len(chain) if hit is None else hit + 1))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *COUNTS, "kept", "rejected_by", "n_rules_run"])

    out = docs.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", kept boolean, rejected_by string, n_rules_run int")
    return out.withColumnRenamed("id", id_col)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest. ``rejected_by`` depends on measured costs, so it stays out."""
    out = quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *COUNTS, base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hot) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(t) AS n_chars
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.3::DOUBLE * n_words) AND word_chars >= 2.0::DOUBLE * n_words AND word_chars <= 20.0::DOUBLE * n_words
  AND NOT (100 * n_dup_lines > 50 * n_lines) AND NOT (n_digits > 0.5::DOUBLE * greatest(1, n_chars)) AS kept
FROM b
"""
