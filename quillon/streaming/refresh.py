"""Keeping a corpus up to date from a stream of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.merge import MIN_ABSTRACT, RECORD, merge_records


def refresh_corpus(spark: SparkSession, incoming: str, corpus: str, checkpoint: str, min_abstract: int = MIN_ABSTRACT, **trigger: object) -> StreamingQuery:
    """Merges JSON-line files of records, as they arrive, into the corpus in a folder of versions.

    The corpus comes first in each merge, so its documents keep their values, and new records join or follow them. Each
    batch writes the folder version=<batch> whole before it counts, so a batch that runs again writes the same version.
    """
    stream = spark.readStream.schema(T.StructType([*RECORD.fields, T.StructField("ord", T.LongType())])).json(incoming)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("ord", F.coalesce("ord", F.xxhash64("arxiv_id", "s2_id", "doi", "title").bitwiseAND(F.lit((1 << 40) - 1))) + (1 << 41))
        old = latest(batch.sparkSession, corpus, number)
        every = new if old is None else old.withColumn("ord", F.col("doc_ord")).drop("doc_ord", "doc_id").unionByName(new, allowMissingColumns=True)
        merge_records(every, min_abstract).write.mode("overwrite").parquet(f"{corpus}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, corpus: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a corpus, or the newest before a batch; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(corpus)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = sorted(int(n.removeprefix("version=")) for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("version="))
    found = [n for n in found if (before is None or n < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{corpus}/version={n}/_SUCCESS"))]
    return spark.read.parquet(f"{corpus}/version={found[-1]}") if found else None

