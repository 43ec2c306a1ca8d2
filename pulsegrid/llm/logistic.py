"""Sparse logistic regression with Spark's own solver, scored by SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import let


@dataclass(frozen=True)
class Linear:
    """One weight list and intercept per class (one entry if binary)."""

    weights: list[list[float]]
    intercepts: list[float]


def buckets(grams: Column, dim: int) -> Column:
    """Distinct hash buckets of an array of strings."""
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int")))


def scale(idx: Column) -> Column:
    return 1.0 / F.sqrt(F.greatest(F.size(idx), F.lit(1)).cast("double"))


def fit(train: DataFrame, dim: int, reg: float, max_iter: int = 60) -> Linear:
    """``train`` has ``idx`` (distinct buckets) and ``label`` (0, 1, ...); it is a small table."""
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="terms", outputCol="counts")
    terms = train.select(F.col("label").cast("double").alias("label"), F.col("idx").cast("array<string>").alias("terms"))
    # (distinct buckets have counts of 1, so dividing by the length is what ``scale`` does)
    rows = Normalizer(inputCol="counts", outputCol="features").transform(counts.transform(terms)).select("label", "features").coalesce(1).cache()
    try:
        model = LogisticRegression(regParam=reg, maxIter=max_iter, standardization=False).fit(rows)
    finally:
        rows.unpersist()
    if model.numClasses == 2:
        return Linear([model.coefficients.toArray().tolist()], [float(model.intercept)])
    return Linear(model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())


def literal(values: list[float]) -> Column:
    """A constant array, folded into one literal when the query is planned."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def margins(model: Linear, idx: Column) -> Column:
    """Array of one linear score per weight list; the weights are literals of a fixed length.

    Each array is bound once; buckets that training never saw have no weight and are left out of the sums.
    """
    seen = [float(any(w[k] for w in model.weights)) for k in range(len(model.weights[0]))]
    used = literal(seen)

    def scores(full: Column) -> Column:
        def of(own: Column) -> Column:
            return F.array(*[F.lit(b) + sum_of(literal(w), own) * scale(full) for w, b in zip(model.weights, model.intercepts, strict=True)])

        return let(F.filter(full, lambda i: F.element_at(used, i + 1) > 0), of)

    return let(idx, scores)


def sum_of(table: Column, idx: Column) -> Column:
    return F.aggregate(idx, F.lit(0.0), lambda s, i: s + F.element_at(table, i + 1))
