r"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>role\ntext</s>\n``. Control strings inside roles and texts
(``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash behind their first
character, and one that already has backslashes there gets one more, so that
escaping is reversible and no control string survives inside a text.

Turns are shuffled by conversation and sorted within their partition; each
Arrow batch is assembled at once: segment lengths, cumulative offsets and
scatter indices in numpy, headers and contents copied into one preallocated
buffer. A conversation that spans batches comes out as several chunks, so no
conversation is ever held whole.

Defined results: null texts and roles are empty; turns are ordered by turn,
role and text with nulls first, and repeated turns all stay; rows of a null
conversation form one conversation; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, SEP, TAIL = b"<s>", b"\n", b"</s>\n"
CONTROL = r"(<|\[)(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"(<|\[)\\(\\*/?(?:s>|INST\]))")
CHUNK_BYTES = 8 << 20
FORMATTED = "conv_id {id}, chunk long, formatted string, loss_start array<long>, loss_end array<long>"


def _escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(text, ""), CONTROL, r"\1\\\2")


def _escape_role(role: pa.Array) -> pa.Array:
    role = pc.replace_substring(pc.fill_null(role, ""), "\\", "\\\\")
    return pc.replace_substring_regex(pc.replace_substring(role, "\n", "\\n"), CONTROL, r"\1\\\2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contiguous bytes and offsets of a string array."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, where each turn starts (n + 1), and where its text starts and ends."""
    n = len(role)
    (rb, ro), (tb, to) = _bytes_of(role), _bytes_of(text)
    rl, tl = np.diff(ro), np.diff(to)
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 1], size[:, 2], size[:, 3], size[:, 4] = len(HEAD), rl, len(SEP), tl, len(TAIL)
    end = np.cumsum(size.ravel()).reshape(n, 5)
    begin = end - size
    out = np.empty(int(end[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, SEP), (4, TAIL)):
        out[begin[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for data, off, length, to_ in ((rb, ro, rl, begin[:, 1]), (tb, to, tl, begin[:, 3])):
        if len(data) > CHUNK_BYTES:  # a huge text: plain slices instead of as many indices
            for a, b, at in zip(off[:-1], off[1:], to_, strict=True):
                out[at : at + b - a] = data[a:b]
        elif len(data):
            out[np.arange(len(data)) + np.repeat(to_ - off[:-1], length)] = data
    return out, np.r_[begin[:, 0], len(out)], begin[:, 3], end[:, 3]


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted chunks of each conversation with the byte spans of its loss mask (assistant texts).

    Chunks of a conversation follow each other in one partition, numbered from 0.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        last, chunk = object(), 0
        for b in batches:
            role, text = _escape_role(b.column(1)), _escape(b.column(2))
            weight = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 32) if len(b) else np.empty(0)
            start = 0
            while start < len(b):
                done = weight[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(weight, done + CHUNK_BYTES, side="right")))
                out, at, text_from, text_to = assemble(role[start:stop], text[start:stop])
                ids = b.column(0)[start:stop].to_pylist()
                heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                chunk_no = []
                for i in heads:
                    chunk = chunk + 1 if (i == 0 and ids[0] == last) else 0
                    chunk_no.append(chunk)
                last = ids[-1]
                edges = np.r_[heads, len(ids)]
                cuts = at[edges]
                speaks = pc.equal(role[start:stop], "assistant").to_numpy(zero_copy_only=False).astype(bool)
                who = np.flatnonzero(speaks)
                owner = np.searchsorted(edges, who, side="right") - 1
                counts = np.searchsorted(who, edges).astype(np.int32)
                formatted = pa.StringArray.from_buffers(len(heads), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out))
                spans = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x[who] - cuts[owner])) for x in (text_from, text_to)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in heads], b.column(0).type), pa.array(chunk_no, pa.int64()), formatted, *spans], ["conv_id", "chunk", "formatted", "loss_start", "loss_end"])
                start = stop

    return rows.mapInArrow(run, FORMATTED.format(id=id_type))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted chunk."""
    turns = []
    for t in formatted.split(TAIL.decode())[:-1]:
        role, text = t.removeprefix(HEAD.decode()).split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted chunks as ``format_chats`` orders them."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state = None
        kinds = None

        def rows(done):
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            kinds = [b.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for conv, chunk, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk == 0:
                    if state:
                        done.append(_closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for i, j in zip(start, end, strict=True):
                    said = unescape(raw[i:j].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield rows(done)
        if state:
            yield rows([_closed(state)])

    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(own)))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS tl,
  length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS rl FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(3 + rl + 1 + tl + 5)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
