"""Tables that cut lineage, joins on skewed keys, and connected components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where none is set and Spark runs on one machine, as in tests, a folder of that machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder, so a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they survive lost executors, are read by column, and go when they are dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.kept)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan in use reads any more."""
        for table, path in self.kept:
            if any(table is t for t in tables):
                delete_folder(self.spark, path)


def salted_join(big: DataFrame, small: DataFrame, key: str, counts: DataFrame, how: str = "inner", share: int = 1000, floor: int = 500) -> DataFrame:
    """Joins big with small, in which each key stands once, on a key that may be the same in many rows of big.

    counts: key, n, how often it stands there. At most `share` keys can have more than 1/share of all rows; only these come to the driver.
    They are salted: their rows of big are dealt out by a hash of the row, their row of small is repeated as often.
    """
    most = F.greatest(F.col("_all") / share, F.lit(floor))
    heavy = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_salts"))
    found = heavy.collect()
    if not found:
        return big.join(small, key, how)
    told = F.broadcast(big.sparkSession.createDataFrame(found, heavy.schema))
    others = [c for c in big.columns if c != key]
    left = big.join(told, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    right = small.join(told, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", node_type: str = "long", scratch: Scratch | None = None) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two columns of nodes. Returns (node, root), root being the smallest node of the component; nodes in no edge
    between different nodes are absent. Every step is an aggregate and a join of at most the edges, salted where a centre has many of them; the driver sees two numbers a round.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(a).cast(node_type).alias("u"), F.col(b).cast(node_type).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, before = scratch.keep(e.distinct()), None
    few = e.sparkSession.sparkContext.defaultParallelism

    def star(x: DataFrame) -> DataFrame:
        """x with m, the least neighbour of u."""
        least = x.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return salted_join(x, least.select("u", "m"), "u", least.select("u", "n"))

    while not e.isEmpty():
        parts = max(few, before[0] // 250_000) if before else None  # a small graph is not written as many small files
        compact = lambda x: x.coalesce(parts) if parts else x  # noqa: E731, B023
        both = star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = scratch.keep(compact(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()))
        centres = large.groupBy("u").agg(F.min("v").alias("v"))
        small = scratch.keep(compact(star(large).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(centres).distinct()))
        scratch.drop(e, large)
        e = small
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
