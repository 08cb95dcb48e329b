"""What the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import Scratch, components, cut, delete_folder, salted_join, shared_folder

__all__ = ["Scratch", "bounded", "components", "counted", "cut", "delete_folder", "give_back", "salted_join", "shared_folder", "sifted", "table", "with_types"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """For what goes on to Python: batches end at some bytes, not only at a number of rows, so very long texts come few at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def give_back() -> None:
    """Returns what a Python worker has freed to the system, at the end of a batch: workers live on, and would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def counted(df: DataFrame, key: str) -> DataFrame:
    """(key, n): how often each key stands, as salted_join() wants it."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def sifted(df: DataFrame, hashed: str, ids: DataFrame, bits: int | None = None, mark: str = "maybe") -> DataFrame:
    """Adds a flag that is true for every row whose `hashed`, a 64-bit hash, is among ids (one column) and false for most others.

    A prefilter for joins: the ids become a bitmap of 2^bits bits, which is broadcast. Its size follows the number of ids (16 bits each,
    8 KB to 128 MB); what more ids than 10^8 let through by chance the join after it removes.
    """
    if bits is None:
        bits = min(30, max(16, (16 * ids.count()).bit_length()))
    at = lambda c: F.pmod(c, F.lit(1 << bits))
    h = at(F.col(ids.columns[0]))
    maps = ids.select(F.floor(h / 32768).cast("int").alias("_b"), (h % 32768).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    x = df.withColumn("_h", at(F.col(hashed))).withColumn("_k", F.floor(F.col("_h") / 32768).cast("int"))
    x = x.join(F.broadcast(maps), F.col("_k") == F.col("_b"), "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(_m, cast((_h % 32768) div 8 as int) + 1, 1)), 16, 10) as int), cast(_h % 8 as int)) & 1")
    return x.withColumn(mark, F.coalesce(bit == 1, F.lit(False))).drop("_h", "_k", "_b", "_m")


def with_types(df: DataFrame, **types: str) -> DataFrame:
    """Only these columns, cast to these types; whatever else the table holds, also under clashing names, is left out."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in types.items()])
