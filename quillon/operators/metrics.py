"""Effectiveness of rankings: precision, recall and average precision, as window and aggregate functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 100


def judged(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """rankings: qid, rank, doc; judgments: qid, relevant (an array). One row for each query and ranked document, and one
    without a rank for queries that found nothing. rel says whether the document is relevant, n_rel how many there are."""
    wanted = judgments.select("qid", F.array_distinct("relevant").alias("relevant"))
    x = wanted.join(rankings.select("qid", "rank", "doc"), "qid", "left")
    return x.select("qid", "rank", "doc", F.coalesce(F.array_contains("relevant", F.col("doc")), F.lit(False)).cast("int").alias("rel"), F.size("relevant").alias("n_rel"))


def _among(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))


def precision_at(k: int) -> Column:
    return F.lit(0.0) if k == 0 else _among(k) / F.lit(float(k))


def recall_at(k: int) -> Column:
    n = F.max("n_rel")
    return F.when(n == 0, 0.0).otherwise(_among(k) / n)


def average_precision() -> Column:
    n = F.max("n_rel")
    return F.when(n == 0, 0.0).otherwise(F.coalesce(F.sum(F.col("rel") * F.col("hits") / F.col("rank")), F.lit(0.0)) / n)


def query_metrics(rankings: DataFrame, judgments: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(qid, p5, p10, r10, ap) of every judged query."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = judged(rankings.where(F.col("rank") <= depth), judgments).withColumn("hits", F.sum("rel").over(upto))
    return x.groupBy("qid").agg(precision_at(5).alias("p5"), precision_at(10).alias("p10"), recall_at(10).alias("r10"), average_precision().alias("ap"))


def model_metrics(by_model: dict[str, DataFrame], judgments: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(model, p5, p10, r10, map): means over the judged queries, of which there must be some."""
    if judgments.isEmpty():
        raise ValueError("there are no judgments")
    out = None
    for name, rankings in by_model.items():
        x = query_metrics(rankings, judgments, depth).agg(*[F.avg(c).alias("map" if c == "ap" else c) for c in ("p5", "p10", "r10", "ap")]).select(F.lit(name).alias("model"), "*")
        out = x if out is None else out.union(x)
    return out
