"""Search over a corpus by any model, with the records of the hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.boolean import boolean_search
from quillon.operators.index import Index, build_index
from quillon.operators.ranking import bm25_scores, bm25_search, ranked, tfidf_scores, tfidf_search


@dataclass(frozen=True)
class Engine:
    """corpus: records with doc_ord; index: its index, or that of a query's terms; then norms_of gives the norms. search() plans a query; nothing is computed before an action."""

    corpus: DataFrame
    index: Index
    norms_of: Callable[[], DataFrame] | None = None

    @classmethod
    def over(cls, corpus: DataFrame) -> Engine:
        corpus = corpus.persist()
        return cls(corpus, build_index(corpus).persist())

    @classmethod
    def read(cls, spark: SparkSession, corpus: str, index: str) -> Engine:
        return cls(spark.read.parquet(corpus), Index.read(spark, index))

    @cached_property
    def norms(self) -> DataFrame:
        return (self.norms_of or self.index.stored_norms)().persist()

    @property
    def models(self) -> dict[str, Callable[[str, int], DataFrame]]:
        return {
            "bm25": lambda q, k: bm25_search(self.index, q, k),
            "tfidf": lambda q, k: tfidf_search(self.index, q, k, self.norms),
            "boolean": lambda q, k: boolean_search(self.index, q, k),
        }

    def search(self, query: str, model: str = "bm25", k: int = 10) -> DataFrame:
        """doc_ord, the record's columns, rank, score and total, in the order of ranks."""
        return self.corpus.join(F.broadcast(self.models[model](query, k)), "doc_ord").orderBy("rank")  # k rows

    def rankings(self, model: str, queries: dict[int, str], k: int) -> DataFrame:
        """(qid, rank, doc_ord) of the best k of each query. A ranked model answers all queries by one plan."""
        if model != "boolean":
            scores = bm25_scores(self.index, queries) if model == "bm25" else tfidf_scores(self.index, queries, self.norms)
            return ranked(scores, k).select("qid", "rank", "doc_ord")
        parts = [boolean_search(self.index, q, k).select(F.lit(qid).cast("long").alias("qid"), "rank", "doc_ord") for qid, q in queries.items()]
        return reduce(DataFrame.union, parts)

    def statistics(self) -> dict[str, float]:
        row = self.index.corpus_stats.crossJoin(self.index.vocabulary_size()).first()
        return {"documents": row["n"], "terms": row["terms"], "mean_length": row["avgdl"]}


def card(query: str) -> list[Column]:
    """What a page shows of a hit."""
    top = F.max("score").over(_all())
    return [
        F.col("rank"),
        tx.highlight(_escaped("title"), query).alias("title"),
        F.when(F.col("url").rlike("(?i)^(https?://|[^:/?#]*$)"), F.col("url")).otherwise("").alias("url"),  # no other scheme becomes a link
        tx.author_line("authors").alias("authors"),
        tx.highlight(_escaped(tx.truncate("abstract", 230)), query).alias("snippet"),
        F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise("n.d.").alias("year"),
        tx.truncate("venue", 48).alias("venue"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.when(F.col("citation_count") > 0, F.concat(F.lit("cited "), F.format_number("citation_count", 0))).otherwise("").alias("cited"),
        F.col("score"),
        F.when(top > 0, 100 * F.col("score") / top).otherwise(0.0).alias("bar"),
        F.col("total"),
    ]


def _all() -> WindowSpec:
    return Window.partitionBy()  # of one page of hits


def _escaped(c: Column | str) -> Column:
    out = tx.or_empty(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out
