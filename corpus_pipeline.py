"""Training data out of the documents, in stages that are each written and read again.

STAGES: (name, function), each function from (spark, docs, sf_dir) to a DataFrame. All but the last return the columns of
docs. The stages learn, iterate or sample, which SQL cannot express, so ORACLE_SQL is None and tests hold run() against a
brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, linededup, mixing, quality, simhash
from quillon.llm.common import shared_folder, table

STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing_to_target_weights", mixing.stage),
]

ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result goes as Parquet to the shared folder and is read again as the next stage's docs.

    A result is deleted once the next one stands.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, function) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        function(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            _delete(spark, before)
        before = here
    return docs
