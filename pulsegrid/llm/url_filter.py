"""URL filter: host and path rules first, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Everything runs as DataFrame expressions; only the learned weights, a list of
fixed length, come to the driver.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the model's verdict on no n-grams (the prior, which is allow); one
output row per input row, repeated rows and null ids included; other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import logistic
from pulsegrid.llm.common import ascii_lower, let

DIM = 8192
#: (verdict, host, path); a rule is written host + path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Words of host names by label, from which the small training table is built, and words that both kinds of hosts use.
BLOCKED = (
    "casino poker slots jackpot betting bets gambling roulette lottery blackjack bingo odds wager spins "
    "ads adserver banner popup tracker tracking pixel clicks analytics-beacon doubleclick affiliate sponsor-ads "
    "spam seo backlinks linkfarm win prize giveaway winner sweepstake "
    "cheap pills viagra cialis pharmacy-rx steroids dietpills adult porn xxx sex cams escort nude "
    "loans payday cash-advance credit-fix phish login-verify account-verify malware keygen crack serial warez torrent botnet trojan"
).split()
ALLOWED = (
    "library science school news herald garden recipes weather museum art university press health travel music books history forum photo code math "
    "language council sport nature film kids railway village harbor mountain bakery bird river reader other station thought another winter island house "
    "theory thinking nation within earth truth thorough thanks "
    "notation ontology theater strength orchard kitchen hospital church theatre orchestra archive journal lecture chemistry physics biology geology stars "
    "painting poetry novel drama dance cycling sailing hiking running chess knitting pottery carpentry engineering software kernel compiler network "
    "parliament court ministry embassy police fire-brigade insurance bank accounting lawyer dentist clinic nursing gardening seeds bees horses "
    "cathedral castle bridge harbour airport metro tram bicycle winery cheese coffee tea bread pasta fishing forest lake valley"
).split()
SHARED = "best free top my online the super real go daily world club 24 pro".split()
PATHS = ["/en/1234", "/de/77.html", "/fr/5/", "/es/901?page=2", "/index.html", "/"]
HOSTS = ["{}.example.com", "www.{}.example.org", "blog.{}.example.net", "m.{}.example.com", "{}.org", "www.{}.com", "{}.net"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)


def _grams(text: Column, mark: str, n: int) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(p) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(p, i, F.lit(n)))))


def url_buckets(host: Column, path: Column, dim: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    grams = [_grams(t, f"{m}{n}:", n) for t, m in ((host, "h"), (path, "p")) for n in sizes]
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(logistic.buckets(F.concat(*grams), dim))


def labelled_urls(parts: tuple[int, ...] = (0, 1, 2, 3, 4)) -> list[tuple[str, int, int]]:
    """(url, label, part): each word alone, before and after a shared word, and joined with two words of its label.

    ``parts`` selects from five: hosts are dealt over them by number, so that those of one part can be held out.
    """
    rows = []
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for k, word in enumerate(words):
            n = len(words)
            others = [words[(k + 1) % n], words[(3 * k + 7) % n], SHARED[k % len(SHARED)], SHARED[(k + 5) % len(SHARED)]]
            stems = [word, f"{word}-{others[0]}", f"{others[1]}{word}", f"{others[2]}-{word}", f"{word}{others[3]}"]
            for j, stem in enumerate(stems):
                rows.append((f"https://{HOSTS[(k + j) % len(HOSTS)].format(stem)}{PATHS[(k + 2 * j) % len(PATHS)]}", label, (k + 3 * j) % 5))
    return [r for r in rows if r[2] in parts]


def as_table(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y, _ in rows) + " AS t(url, label)")


def train(spark: SparkSession, dim: int = DIM, reg: float = 0.0001, labelled: DataFrame | None = None) -> logistic.Linear:
    """Fit on ``labelled`` (url, label), a small table, or on the table of this module."""
    host, path = host_path(F.col("url"))
    rows = labelled if labelled is not None else as_table(spark, labelled_urls())
    rows = rows.select(F.col("label"), host.alias("host"), path.alias("path"))
    return logistic.fit(rows.select("label", url_buckets(F.col("host"), F.col("path"), dim).alias("idx")), dim, reg)


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as a struct of text and verdict, or null."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    cases = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in rules]
    out = [F.when(c, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for c, (v, h, p) in zip(cases, rules, strict=True)]
    return F.coalesce(*out) if out else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_filter(df: DataFrame, url_col: str = "url", id_col: str = "page_id", rules=None, model: logistic.Linear | None = None, dim: int = DIM, threshold: float = 0.45) -> DataFrame:
    """Per row: id, host, path, rule (or null), verdict and the model's block probability.

    ``threshold`` was chosen on one held-out part of the training table: the highest of a few without a false block.
    """
    model = model or train(df.sparkSession, dim)
    host, path = host_path(F.col(url_col))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.select("*", url_buckets(F.col("host"), F.col("path"), dim).alias("idx"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    score = 1.0 / (1.0 + F.exp(-F.get(logistic.margins(model, F.col("idx")), F.lit(0))))
    verdict = F.coalesce(F.col("r.verdict"), F.when(score >= threshold, "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), score.alias("block_score"))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
