"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents; the last returns the mix: a row per document
taken, with the number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, mixing, near_dedup, secret_scan, toxicity
from pulsegrid.llm.common import materialize

#: SQL can't express the learned scores of the first stage; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 stay, row by row.

    A null or empty text has the score of no terms; without labels of both kinds all have the
    same score; repeated rows get the same verdict; no documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    machine = toxicity.fit(docs, labels)
    return docs.where(toxicity.score_of(spark, F.col("text"), machine) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the least id (and, among texts of
    one id, of the least digest).

    Rows are told apart by id and text, so texts that share an id are judged apart; rows that repeat
    both are copies too, of which one stays. Rows with a null id are never linked and all stay, as do
    distinct documents without words. No documents give none.
    """
    h = F.xxhash64("text")
    found = near_dedup.near_duplicates(docs, detail=True)
    found = materialize(spark, found.where("doc_id IS NOT NULL").select("doc_id", "h", "first"), "stage-found")
    gone = found.where("NOT first").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (h == gone["gone_h"]), "left_anti")
    again = found.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("h").alias("again_h"))
    on = (F.col("doc_id") == F.col("again_id")) & (h == F.col("again_h"))
    once = kept.join(again, on, "left_anti")
    # rows that repeat id and text are few beside the rest, and only they are shuffled as a whole
    first = kept.join(again, on, "left_semi").withColumn("_text_digest", h).dropDuplicates(["doc_id", "_text_digest"]).drop("_text_digest")
    return once.unionByName(first).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that holds eight words running of any benchmark item goes; items of fewer words remove none.

    Null and empty texts stay, repeated rows and null ids are judged by their own text; an empty
    table on either side removes nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    hit = decontam.hits(keyed, items).where(F.col("last") - F.col("first") >= decontam.SPAN).select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_h"]), "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans give way to a mark, and ``n_chars`` follows; every row stays, null and empty texts as they are."""
    spans = "_secret_spans"
    found = docs.withColumn(spans, secret_scan.find_secrets(F.coalesce(F.col("text"), F.lit(""))))
    masked = found.withColumn("text", secret_scan.mask_secrets(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once; those without words are never taken, repeated rows are separate documents."""
    return mixing.weighted_fair_mix(docs, mixing.n_words(F.col("text"))).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
