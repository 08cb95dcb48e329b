"""Reading and writing: JSON lines, judgments, and the two forms of paper records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import clean_whitespace, id_from_url, null_if_empty, year_of
from quillon.operators.merge import RECORD

_TEXT, _WORDS = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ATOM_ENTRY = _struct(id=_TEXT, title=_TEXT, summary=_TEXT, published=_TEXT, author=T.ArrayType(_struct(name=_TEXT)), category=T.ArrayType(_struct(_term=_TEXT)))
SCHOLAR_RECORD = _struct(
    paperId=_TEXT, title=_TEXT, abstract=_TEXT, year=T.IntegerType(), authors=T.ArrayType(_struct(authorId=_TEXT, name=_TEXT)), externalIds=_struct(ArXiv=_TEXT, DOI=_TEXT),
    url=_TEXT, citationCount=T.LongType(), fieldsOfStudy=_WORDS, venue=_TEXT,
)
JUDGMENTS = _struct(query=_TEXT, relevant=_WORDS)
CORPUS = T.StructType([T.StructField("doc_id", T.StringType()), *RECORD.fields])
MIN_ABSTRACT = 100


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line fails the read."""
    reader = spark.read.option("mode", "FAILFAST").option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replaces what is there; nulls are written, so that each line has all keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, relevant) of a JSON array; qid numbers the queries in the order of the file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(JUDGMENTS)).alias("all"))
    return whole.select(F.posexplode("all").alias("qid", "j")).select(F.col("qid").cast("long").alias("qid"), "j.query", "j.relevant")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """The entries of Atom files."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)


def atom_entries(pages: DataFrame, text: str = "page") -> DataFrame:
    """The entries of Atom feeds that a column holds."""
    feed = F.from_xml(F.col(text), T.StructType([T.StructField("entry", T.ArrayType(ATOM_ENTRY))]))
    return pages.select(*[c for c in pages.columns if c != text], F.posexplode(feed["entry"]).alias("n", "e")).select("*", "e.*").drop("e")


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ("ord",) if c in df.columns]


def atom_records(entries: DataFrame) -> DataFrame:
    """Paper records of Atom entries: those that have an id of a paper, a title and an abstract. A column ord goes along."""
    x = entries.select(
        *_carried(entries),
        id_from_url("id").alias("arxiv_id"),
        F.col("id").alias("_id"),
        clean_whitespace("title").alias("title"),
        clean_whitespace("summary").alias("abstract"),
        F.transform(F.coalesce("author", F.array().cast("array<struct<name: string>>")), lambda a: F.coalesce(a["name"], F.lit(""))).alias("authors"),
        year_of("published").alias("year"),
        F.transform(F.coalesce("category", F.array().cast("array<struct<_term: string>>")), lambda c: F.coalesce(c["_term"], F.lit(""))).alias("categories"),
    )
    x = x.where(F.contains("_id", F.lit("/abs/")) & (F.col("title") != "") & (F.col("abstract") != ""))
    return x.drop("_id").withColumns({"url": F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"), "source": F.lit("arxiv")})


def scholar_records(raw: DataFrame, min_abstract: int = MIN_ABSTRACT) -> DataFrame:
    """Paper records of the second API's objects: those that have a title and a long enough abstract. A column ord goes along."""
    names = F.coalesce("authors", F.array().cast("array<struct<authorId: string, name: string>>"))
    x = raw.select(
        *_carried(raw),
        F.col("paperId").alias("s2_id"),
        F.col("externalIds.ArXiv").alias("arxiv_id"),
        null_if_empty(F.lower("externalIds.DOI")).alias("doi"),
        clean_whitespace("title").alias("title"),
        clean_whitespace("abstract").alias("abstract"),
        F.transform(names, lambda a: F.coalesce(a["name"], F.lit(""))).alias("authors"),
        "year",
        null_if_empty("venue").alias("venue"),
        F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("fields_of_study"),
        F.col("citationCount").alias("citation_count"),
        "url",
    )
    return x.where((F.col("title") != "") & (F.length("abstract") >= min_abstract)).withColumn("source", F.lit("semantic_scholar"))

