"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch become one
ragged array of symbol ids. In every round each still active sequence merges
all occurrences of its own lowest-ranked adjacent pair, all sequences at once;
a sequence without a mergeable pair leaves. The symbols that survive are
counted per pre-token and summed per text.

A merge can only create pairs of higher rank than its own (their vocabulary
entry came later), so merging all occurrences of the lowest pair at once, left
to right without overlap, gives the same symbols as merging one by one.

Defined results: a null text is an empty text of 0 tokens; one output row per
input row, whatever repeats; an empty table gives an empty table. An added
token of the vocabulary found inside a text counts as one token, as the library
does by default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where visible, else the next free code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of the merge table: sorted pair keys with rank and merged id. Its size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    key = (left << 32) | right
    order = np.argsort(key)
    return {
        "key": key[order],
        "rank": order.astype(np.int64),
        "merged": np.array([vocab[a + b] for a, b in merges], np.int64)[order],
        "byte": np.array([vocab[s] for s in byte_symbols()], np.int64),
        "added": [t["content"] for t in spec["added_tokens"]],
    }


class Counter:
    """Counts tokens of texts; remembers the counts of short pre-tokens, up to a bound."""

    def __init__(self, vocabulary: dict, remember: int = 300_000):
        self.v, self.remember, self.known = vocabulary, remember, {}
        self.split = regex.compile(PATTERN).findall
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary["added"], key=len, reverse=True)))) if vocabulary["added"] else None

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.v["key"], key), len(self.v["key"]) - 1)
        hit = self.v["key"][at] == key
        return np.where(hit, self.v["rank"][at], NO_RANK), self.v["merged"][at]

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Number of surviving symbols of each (non-empty) byte string."""
        out = np.array([len(w) for w in words], np.int64)
        if not words:
            return out
        sym = self.v["byte"][np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), out)
        rank, merged = self._pairs(sym, seq)
        while True:
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]) if len(seq) else np.empty(0, np.int64)
            if not len(first):
                return out
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            done = low == NO_RANK
            if done.any():
                out[seq[first[done]]] = size[done]
                keep = ~np.repeat(done, size)
                sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
                low, size = low[~done], size[~done]
                if not len(sym):
                    return out
            hit = np.flatnonzero(rank == np.repeat(low, size))
            run = np.r_[0, np.flatnonzero(np.diff(hit) != 1) + 1]  # of overlapping hits (aaa), every second one merges
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[place % 2 == 0]
            sym[hit] = merged[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # where merged symbols stand afterwards
            sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
            touched = np.unique(np.r_[now, now[now > 0] - 1])
            touched, last = touched[touched + 1 < len(sym)], touched[touched + 1 >= len(sym)]
            r, m = self._look_up(sym[touched], sym[touched + 1])
            rank[touched] = np.where(seq[touched] == seq[touched + 1], r, NO_RANK)
            merged[touched] = m
            rank[last] = NO_RANK

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
        r, m = self._look_up(sym[:-1], sym[1:])
        rank[:-1] = np.where(seq[1:] == seq[:-1], r, NO_RANK)
        merged[:-1] = m
        return rank, merged

    def count(self, texts: list[str], group_bytes: int = 1 << 22) -> list[int]:
        """Token counts; pre-tokens are merged in groups of about ``group_bytes``."""
        out, start = [], 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= group_bytes):
                held += len(texts[end])
                end += 1
            out += self._group(texts[start:end])
            start = end
        return out

    def _group(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for t in texts:
            n = 0
            if self.added and (parts := self.added.split(t)) and len(parts) > 1:
                n = len(parts) - 1
                cut.append([w for p in parts for w in self.split(p)])
            else:
                cut.append(self.split(t))
            extra.append(n)
        known = self.known
        new = list({w for c in cut for w in c if w not in known})
        counts = self.merge([w.encode() for w in new])
        if len(known) > self.remember:
            known.clear()
            new_known = {w for c in cut for w in c} - set(new)
            again = list(new_known)
            known.update(zip(again, self.merge([w.encode() for w in again]).tolist(), strict=True))
        known.update(zip(new, counts.tolist(), strict=True))
        out = [n + sum(map(known.__getitem__, c)) for c, n in zip(cut, extra, strict=True)]
        for w in new:
            if len(w) > 64:
                known.pop(w, None)
        return out


def token_counts(df: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens``, ``over_limit``. The vocabulary is read on the driver and broadcast (about 1 MB)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = docs.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = np.array(counter.count(text.to_pylist()), np.int64)
            size = pc.binary_length(text.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
