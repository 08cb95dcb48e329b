"""Ranked retrieval: BM25 and TF-IDF cosine, for one query or for a batch.

A query's terms are a small table that is broadcast against the postings, so only their postings are read; one aggregate by
(query, document) follows. Scores are rounded to ten places before they order anything, so that the order in which Spark
adds does not decide ties; ties go to the smaller document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.analyzer import analyze
from quillon.operators.index import Index

K1, B = 1.5, 0.75


def query_terms(index: Index, queries: Mapping[int, str]) -> DataFrame:
    """(qid, term, qtf) of queries by number."""
    rows = [(int(q), t, n) for q, text in queries.items() for t, n in Counter(analyze(text, index.remove_stopwords, index.stem)).items()]
    return index.spark.createDataFrame(rows, "qid long, term string, qtf long")


def _matched(index: Index, queries: Mapping[int, str]) -> DataFrame:
    """Postings of the queries' terms with df, n and avgdl. Unknown terms fall away."""
    wanted = query_terms(index, queries)
    names = sorted({r["term"] for r in wanted.collect()})  # the driver's own words
    stats = index.term_stats.where(F.col("term").isin(names)).join(F.broadcast(wanted), "term")
    return index.postings.where(F.col("term").isin(names)).join(F.broadcast(stats), "term").crossJoin(F.broadcast(index.corpus_stats))


def bm25_scores(index: Index, queries: Mapping[int, str], k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_ord, score) of all documents with a term of the query."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    mean = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    return _matched(index, queries).groupBy("qid", "doc_ord").agg(F.round(F.sum(part), 10).alias("score"))


def tfidf_scores(index: Index, queries: Mapping[int, str], norms: DataFrame | None = None) -> DataFrame:
    """(qid, doc_ord, score): cosines. Terms of every document carry nothing, and documents of nothing else do not match."""
    idf = F.log10(F.col("n") / F.col("df"))
    x = _matched(index, queries).withColumns({"qw": (1 + F.log10("qtf")) * idf, "dw": (1 + F.log10("tf")) * idf}).where(idf != 0)
    dots = x.groupBy("qid", "doc_ord").agg(F.sum(F.col("qw") * F.col("dw")).alias("dot"))
    lengths = x.select("qid", "term", "qw").distinct().groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    norms = (index.doc_norms() if norms is None else norms).where("norm > 0")
    return dots.join(F.broadcast(lengths), "qid").join(norms, "doc_ord").select("qid", "doc_ord", F.round(F.col("dot") / (F.col("qnorm") * F.col("norm")), 10).alias("score"))


def ranked(scores: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, doc_ord, score, total): the best k of each query, and how many there were."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_ord")
    totals = scores.groupBy("qid").agg(F.count("*").alias("total"))
    top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # a group limit runs before the shuffle
    return top.join(F.broadcast(totals), "qid").select("qid", F.col("rank").cast("long").alias("rank"), "doc_ord", "score", "total")


def bm25_search(index: Index, query: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(rank, doc_ord, score, total) of one query."""
    return ranked(bm25_scores(index, {0: query}, k1, b), k).drop("qid")


def tfidf_search(index: Index, query: str, k: int = 10, norms: DataFrame | None = None) -> DataFrame:
    return ranked(tfidf_scores(index, {0: query}, norms), k).drop("qid")
