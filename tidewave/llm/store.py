"""Cutting lineage with tables in the shared checkpoint folder, and connected components on top of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset and all is one process (tests, local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tidewave_folder", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewave-")
        spark._tidewave_folder = folder
    return folder.rstrip("/")


#: Spark deletes a query's shuffle files when it ends, not when the driver's memory is next collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost no earlier stage again, and its shuffles need no disk any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewave/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() returned; nothing may read them any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._tidewave_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that cut() has written; results that still read them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidewave")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: rows (node, root), root the smallest node.

    Every node that an edge names gets a row.  Nulls are dropped, self-loops and repeated edges are harmless.
    Minima are pre-aggregated before the shuffle, and no node's neighbours are gathered, so a star of any
    size is spread over many tasks.  Nothing but one changed-edges count per round reaches the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # large star: neighbours above u hang on the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = cut(small)
        # a forest of stars: no node that hangs on another has two roots or is a root itself
        seen = new.groupBy("u").agg(F.count("*").alias("n"))
        bad = seen.where("n > 1").limit(1).unionByName(seen.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1))
        e = new
        if not bad.head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
