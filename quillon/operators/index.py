"""The inverted index as tables.

documents: doc_ord (the place of a document, a long), title, abstract. From it: postings(term, doc_ord, tf, dl), doc_stats
(doc_ord, dl), term_stats(term, df), corpus_stats(n, avgdl) and doc_norms(doc_ord, norm). A document's length is the size of its
array of words, so it needs no aggregate: it goes along with the words through the one that counts them. Texts are dealt out by document before they are
taken apart, so what is shuffled is the text and not its words; stems are made in the array of words. Postings carry the length,
so ranked queries need no join with doc_stats; written out, they are range-partitioned and sorted by term and document, so that
a query's terms prune files and row groups and a frequent term is split. seek() is an index of some terms only, which one pass over the texts makes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.analyzer import stemmed_all
from quillon.functions.text import document_text, tokenize, without_stopwords
from quillon.operators.graph import Scratch


COMMON = 100_000  # terms at most whose df is broadcast


def _words(docs: DataFrame, text: Column | None, remove_stopwords: bool, stem: bool = False) -> DataFrame:
    """(doc_ord, words)."""
    words = tokenize(document_text("title", "abstract") if text is None else text)
    words = without_stopwords(words) if remove_stopwords else words
    return docs.select("doc_ord", (stemmed_all(words) if stem else words).alias("words"))


def term_counts(docs: DataFrame, text: Column | None = None, remove_stopwords: bool = True, stem: bool = True) -> DataFrame:
    """(doc_ord, term, tf, dl): how often each document has each term, and how many terms it has."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if stem:  # before they are dealt out: behind a Python function Spark no longer knows where a document is
        told = _words(docs, text, remove_stopwords, True).select("doc_ord", F.array_join("words", " ").alias("text"))
        words = F.filter(F.split("text", " "), lambda w: w != "")
    else:
        told, words = docs.select("doc_ord", (document_text("title", "abstract") if text is None else text).alias("text")), tokenize("text")
        words = without_stopwords(words) if remove_stopwords else words
    dealt = told.repartition(parts, "doc_ord").select("doc_ord", words.alias("words"))  # the aggregate needs no other shuffle
    each = dealt.select("doc_ord", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy("doc_ord", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def with_df(counts: DataFrame, stats: DataFrame, least: int = 1) -> DataFrame:
    """counts with the df of each term, without terms of a smaller df than `least`. stats: term, df and what else is to come along.

    The terms that hold more than 1/COMMON of all counts are COMMON at most and are broadcast; only counts of other terms are shuffled. counts and stats are read twice and had better be stored.
    """
    limit = stats.agg((F.sum("df") / COMMON).alias("_limit"))
    told = stats.where(F.col("df") >= least).crossJoin(F.broadcast(limit))
    common = F.broadcast(told.where("df > _limit").select(*stats.columns))
    near = counts.join(common, "term")
    far = counts.join(common.select("term"), "term", "left_anti").join(told.where("df <= _limit").select(*stats.columns), "term")
    return near.unionByName(far)


@dataclass(frozen=True)
class Index:
    """Tables of an index; all are lazy unless they were read from a folder or persisted."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    remove_stopwords: bool = True
    stem: bool = True
    folder: str | None = None

    TABLES = ("postings", "doc_stats", "term_stats", "corpus_stats")

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def doc_norms(self) -> DataFrame:
        """(doc_ord, norm): the length of each document's vector of (1 + log10 tf) * log10(N / df)."""
        weights = with_df(self.postings, self.term_stats).crossJoin(F.broadcast(self.corpus_stats.select("n")))
        w = (1 + F.log10("tf")) * F.log10(F.col("n") / F.col("df"))
        return weights.groupBy("doc_ord").agg(F.sqrt(F.sum(w * w)).alias("norm"))

    def stored_norms(self) -> DataFrame:
        """The norms that write() stored, of an index that was read from a folder; else computed."""
        return self.spark.read.parquet(f"{self.folder}/doc_norms") if self.folder else self.doc_norms()

    def vocabulary_size(self) -> DataFrame:
        return self.term_stats.agg(F.count("*").alias("terms"))

    def top_terms(self, k: int = 10) -> DataFrame:
        return self.term_stats.orderBy(F.desc("df"), "term").limit(k)

    def persist(self) -> Index:
        return Index(*[getattr(self, t).persist() for t in self.TABLES], self.remove_stopwords, self.stem)

    def write(self, folder: str) -> Index:
        """Writes the tables and reads them; what is counted from postings is counted from the written ones."""
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
        put(self.postings.repartitionByRange("term", "doc_ord").sortWithinPartitions("term", "doc_ord"), "postings")
        put(self.doc_stats, "doc_stats")
        read = self.spark.read.parquet
        put(_term_stats(read(f"{folder}/postings")), "term_stats")
        put(_corpus_stats(read(f"{folder}/doc_stats")), "corpus_stats")
        out = Index.read(self.spark, folder, self.remove_stopwords, self.stem)
        put(out.doc_norms(), "doc_norms")
        return out

    @classmethod
    def read(cls, spark: SparkSession, folder: str, remove_stopwords: bool = True, stem: bool = True) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in cls.TABLES], remove_stopwords, stem, folder)


def _term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _corpus_stats(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build_index(docs: DataFrame, remove_stopwords: bool = True, stem: bool = True, text: Column | None = None) -> Index:
    """The index of documents with doc_ord, title and abstract. Documents without a term count in n and avgdl."""
    postings = term_counts(docs, text, remove_stopwords, stem).select("term", "doc_ord", "tf", "dl")
    doc_stats = _words(docs, text, remove_stopwords).select("doc_ord", F.size("words").cast("long").alias("dl"))
    return Index(postings, doc_stats, _term_stats(postings), _corpus_stats(doc_stats), remove_stopwords, stem)


def counted_index(docs: DataFrame, scratch: Scratch, remove_stopwords: bool = True, stem: bool = True, text: Column | None = None) -> Index:
    """build_index() with postings and term_stats stored as they come: for what reads them all."""
    built = build_index(docs, remove_stopwords, stem, text)
    postings = scratch.keep(built.postings)
    return Index(postings, built.doc_stats, scratch.keep(_term_stats(postings)), built.corpus_stats, remove_stopwords, stem)


def seek(docs: DataFrame, names: list[str], scratch: Scratch, remove_stopwords: bool = True, stem: bool = True, text: Column | None = None) -> Index:
    """The index of all documents, but of these terms only: what queries of them read. One pass over the texts leaves a slim row for each document."""
    words = _words(docs, text, remove_stopwords, stem)
    found = F.filter("words", lambda w: w.isin(*names)) if names else F.array().cast("array<string>")
    slim = scratch.keep(words.select("doc_ord", F.size("words").cast("long").alias("dl"), found.alias("found")))
    postings = slim.select("doc_ord", "dl", F.explode("found").alias("term")).groupBy("term", "doc_ord").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    doc_stats = slim.select("doc_ord", "dl")
    return Index(postings, doc_stats, _term_stats(postings), _corpus_stats(doc_stats), remove_stopwords, stem)
