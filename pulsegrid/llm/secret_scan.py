r"""Secret scans by multipart credential linking, in DataFrame expressions only.

Base kinds (assignments, access identifiers, long hex strings) are secrets by
themselves. Weak kinds (account identifiers, bare 40-character strings,
endpoints) are reported only if parts of complementary roles lie near them in
the same scope, a block of text between blank lines: an account identifier
next to a secret, a bare string next to an identifier, an endpoint next to both.

The interval join of a document's parts is a sweep over its parts in order of
position, once forwards and once backwards, which carries the furthest end (or
least start) of each role's parts; no pairs are made and nothing is shuffled.

Defined results: a null text is an empty text without spans; one output row per
input row; positions are code points, ends exclusive; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import let

ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ACCOUNT = r"""(?i:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
BLOB = r"[A-Za-z0-9+/=]{40,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+"""
BLANK = r"\n[\x20\x09\x0D]*\n"

#: name, pattern, role (0 identifier, 1 secret, 2 endpoint, 3 scope limit), weak, filter on the match
KINDS = [
    ("assign", ASSIGN, 1, False, lambda m: F.char_length(F.regexp_replace(m, "^" + ASSIGN_HEAD, "")) >= 8),
    ("access", ACCESS, 0, False, lambda m: F.char_length(m) >= 16),
    ("hex", HEX, 1, False, lambda m: F.lit(True)),
    ("account", ACCOUNT, 0, True, lambda m: F.lit(True)),
    ("blob", BLOB, 1, True, lambda m: (F.char_length(m) == 40) & m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    ("endpoint", ENDPOINT, 2, True, lambda m: F.lit(True)),
    ("blank", BLANK, 3, False, lambda m: F.lit(True)),
]
BASE = ("assign", "access", "hex")
PART = "array<struct<start:int,k:int,end:int,role:int,weak:boolean>>"


#: Running results are put together in blocks of so many, so that long arrays aren't copied for each element.
BLOCK = 128


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """``emit(state, x)`` for each element, the state running along: an array of ``kind``."""

    def within(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, start, lambda t, x: F.struct(step(t["state"], x).alias("state"), F.concat(t["out"], F.array(emit(t["state"], x))).alias("out")))

    def across(s: Column, block: Column) -> Column:
        return let(within(block, s["state"]), lambda v: F.struct(v["state"].alias("state"), F.concat(s["out"], v["out"]).alias("out")))

    def blocks(whole: Column) -> Column:
        n = F.greatest(F.floor((F.size(whole) - 1) / BLOCK), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(whole, k * BLOCK + 1, BLOCK))
        return F.aggregate(cut, F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), across, lambda s: s["out"])

    return let(items, blocks)


def spans_of(text: Column, k: int) -> Column:
    """Matches of kind ``k`` as parts; lengths of the pieces between matches give the positions."""
    _, pattern, role, weak, passes = KINDS[k]

    def emit(at: Column, pm: Column) -> Column:
        begin = at + F.char_length(pm["p"])
        part = F.struct(begin.alias("start"), F.lit(k).alias("k"), (begin + F.char_length(pm["m"])).alias("end"), F.lit(role).alias("role"), F.lit(weak).alias("weak"))
        return F.when(passes(pm["m"]), part)

    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    found = scan(zipped, F.lit(0), lambda at, pm: at + F.char_length(pm["p"]) + F.char_length(pm["m"]), emit, PART[6:-1])
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast(PART))


def _none() -> Column:
    return F.lit(None).cast("int")


def _sweep(parts: Column, reach: int, forwards: bool) -> Column:
    """For each part of an ordered array: is an identifier, a secret within reach before it in its scope?

    The state is the furthest end (backwards: the least start) of the parts of each role.
    """

    def near(p: Column, at: Column) -> Column:
        gap = (p["start"] - at) if forwards else (at - p["end"])
        return F.coalesce(gap <= reach, F.lit(False))

    def step(s: Column, p: Column) -> Column:
        own, blank = (p["end"] if forwards else p["start"]), p["role"] == 3
        best = F.greatest if forwards else F.least
        return F.struct(*[F.when(blank, _none()).when(p["role"] == role, best(s[c], own)).otherwise(s[c]).alias(c) for role, c in ((0, "i"), (1, "s"))])

    return scan(parts, F.struct(_none().alias("i"), _none().alias("s")), step, lambda s, p: F.struct(near(p, s["i"]).alias("i"), near(p, s["s"]).alias("s")), "struct<i:boolean,s:boolean>")


def _linked(parts: Column, reach: int) -> Column:
    """Strong parts and the weak ones that complementary parts support."""

    def choose(p: Column) -> Column:
        def keep(z: Column) -> Column:
            i, s = z["f"]["i"] | z["b"]["i"], z["f"]["s"] | z["b"]["s"]
            fits = F.when(z["p"]["role"] == 0, s).when(z["p"]["role"] == 1, i).otherwise(i & s)
            return (z["p"]["role"] != 3) & (~z["p"]["weak"] | fits)

        back = F.reverse(_sweep(F.reverse(p), reach, False))
        seen = F.zip_with(_sweep(p, reach, True), back, lambda f, b: F.struct(f.alias("f"), b.alias("b")))
        zipped = F.zip_with(p, seen, lambda x, z: F.struct(x.alias("p"), z["f"].alias("f"), z["b"].alias("b")))
        return F.transform(F.filter(zipped, keep), lambda z: z["p"])

    return let(parts, choose)


def _apart(parts: Column) -> Column:
    """Strong parts, and the weak parts that overlap none of them; ``parts`` is ordered (strong ones first at one place).

    The furthest end of the strong parts before, and the least start of those after, tell.
    """

    def covered(p: Column, forwards: bool) -> Column:
        best = F.greatest if forwards else F.least

        def step(s: Column, x: Column) -> Column:
            return F.when(x["weak"], s).otherwise(best(s, x["end"] if forwards else x["start"]))

        def emit(s: Column, x: Column) -> Column:
            return F.coalesce(x["weak"] & ((s > x["start"]) if forwards else (s < x["end"])), F.lit(False))

        return scan(p if forwards else F.reverse(p), _none(), step, emit, "boolean")

    def choose(p: Column) -> Column:
        over = F.zip_with(covered(p, True), F.reverse(covered(p, False)), lambda f, b: f | b)
        zipped = F.zip_with(p, over, lambda x, o: F.struct(x.alias("p"), o.alias("o")))
        return F.transform(F.filter(zipped, lambda z: ~z["o"]), lambda z: z["p"])

    return let(parts, choose)


def find_secrets(text: Column, reach: int = 300) -> Column:
    """Array of parts ``(start, k, end, role, weak)`` of a text, in order; ``k`` indexes ``KINDS``."""

    def parts(t: Column) -> Column:
        base = F.concat(*[spans_of(t, k) for k in range(3)])

        def whole(b: Column) -> Column:
            weak = F.concat(*[spans_of(t, k) for k in (3, 4, 5)])
            return let(weak, lambda w: F.when(F.size(w) == 0, F.array_sort(b)).otherwise(_linked(F.array_sort(F.concat(_apart(F.array_sort(F.concat(b, w))), spans_of(t, 6))), reach)))

        return let(base, whole)

    return let(text, parts)


def as_text(parts: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.element_at(names, p["k"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", reach: int = 300) -> DataFrame:
    """Per row: id and ``parts``, all reported spans."""
    return df.select(F.col(id_col), find_secrets(F.coalesce(F.col(text_col), F.lit("")), reach).alias("parts"))


def mask_secrets(text: Column, parts: Column, mark: str = "[SECRET]") -> Column:
    """The text with every reported span (overlaps joined) replaced by a mark."""

    def build(t: Column) -> Column:
        def emit(at: Column, p: Column) -> Column:
            return F.when(p["start"] >= at, F.concat(F.substring(t, at + 1, p["start"] - at), F.lit(mark))).otherwise("")

        kept = scan(parts, F.lit(0), lambda at, p: F.greatest(at, p["end"]), emit, "string")
        last = F.array_max(F.transform(parts, lambda p: p["end"]))
        return F.concat(F.array_join(kept, ""), F.substring(t, last + 1, F.char_length(t)))

    return F.when(F.size(parts) == 0, text).otherwise(let(text, build))


def _count(parts: Column, k: int) -> Column:
    return F.size(F.filter(parts, lambda x: x["k"] == k)).cast("long")


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(p: Column) -> Column:
        base = F.filter(p, lambda x: x["k"] < 3)
        count = [_count(p, k).alias(f"n_{BASE[k]}") for k in range(3)]
        return F.struct(*count, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(p).alias("spans"))

    out = found.select("doc_id", let(F.col("parts"), digest).alias("d"))
    return out.select("doc_id", "d.*")


_SPAN_SQL = """SELECT rid, {k} AS k, '{name}' AS kind, {role} AS role, {weak} AS weak, s AS start_, s + length(m) AS end_ FROM (
  SELECT rid, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM (SELECT rid, regexp_split_to_array(t, '{p}') AS ps, regexp_extract_all(t, '{p}', 0) AS ms FROM d WHERE regexp_matches(t, '{p}'))) WHERE {keep}"""


def _oracle() -> str:
    keep = {
        "assign": "length(regexp_replace(m, '^" + ASSIGN_HEAD.replace("'", "''") + "', '')) >= 8",
        "access": "length(m) >= 16",
        "blob": "length(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    parts = [_SPAN_SQL.format(k=k, name=n, role=r, weak=str(w).lower(), p=p.replace("'", "''"), keep=keep.get(n, "true")) for k, (n, p, r, w, _) in enumerate(KINDS)]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
p AS (SELECT * FROM raw r WHERE NOT (weak AND EXISTS (SELECT 1 FROM raw b WHERE b.rid = r.rid AND b.k < 3 AND b.start_ < r.end_ AND r.start_ < b.end_))),
z AS (SELECT *, count(*) FILTER (role = 3) OVER (PARTITION BY rid ORDER BY start_, k, end_ ROWS UNBOUNDED PRECEDING) AS block, row_number() OVER (PARTITION BY rid ORDER BY start_, k, end_) AS n FROM p),
near AS (SELECT z.rid, z.n,
  bool_or(o.role = 0) AS has_i, bool_or(o.role = 1) AS has_s FROM z JOIN z o ON o.rid = z.rid AND o.block = z.block AND o.n <> z.n AND o.role < 3
  AND ((o.n < z.n AND z.start_ - o.end_ <= 300) OR (o.n > z.n AND o.start_ - z.end_ <= 300)) WHERE z.weak GROUP BY ALL),
kept AS (SELECT z.* FROM z LEFT JOIN near USING (rid, n) WHERE role < 3 AND (NOT weak OR CASE role WHEN 0 THEN has_s WHEN 1 THEN has_i ELSE has_i AND has_s END)),
f AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
  string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, k) FILTER (k < 3) AS b, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, k) AS s FROM kept GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN f USING (rid)"""


OP6_SQL = _oracle()
