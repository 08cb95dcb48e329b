"""What a corpus holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """One row: documents, those with several sources, the range of years, the mean length of abstracts."""
    year = F.when(F.col("year") != 0, F.col("year"))
    return corpus.agg(
        F.count("*").alias("documents"),
        F.sum((F.size("sources") > 1).cast("long")).alias("in_several_sources"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.coalesce(F.avg(F.length("abstract")), F.lit(0.0)).alias("mean_abstract"),
    )


def source_counts(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("documents"))


def top_categories(corpus: DataFrame, k: int = 6) -> DataFrame:
    counts = corpus.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("documents"))
    return counts.orderBy(F.desc("documents"), "category").limit(k)
