"""Cutting lineage through the folder that the cluster shares, for plans that loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a file of a cut table.
FILE_ROWS = 100_000
#: Edges up to which a round of ``components`` broadcasts the nodes (two numbers each).
BROADCAST_EDGES = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set in the context.

    Where none is named, a local session gets one of its own; on a cluster, where no machine's folder is shared, this raises.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if path or held.isDefined():
        return path or held.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a shared store with all that is in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a shared store when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, computed once and kept in the shared folder.

    A table of about ``rows`` small rows is gathered into as many files as FILE_ROWS asks for.
    """
    spark = df.sparkSession
    sc, path = spark.sparkContext, shared_dir(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
        delete_at_end(spark, sc._jsc.sc().getCheckpointDir().get())
    return (df if rows is None else df.repartition(1 + rows // FILE_ROWS)).checkpoint(eager=True)


def components(edges: DataFrame, rows: int | None = None, most: int = 50) -> DataFrame:
    """``node, component`` (the least node reachable) of all ends of ``lo, hi`` edges, by alternating large and small stars.

    Each round is two aggregations and joins; rounds grow with the logarithm of the longest path. Every round is cut. ``rows`` is about how many
    edges there are. Raises where the components have not settled after ``most`` rounds.
    """
    # A hub's edges would all meet in one task. While there are few edges their nodes are broadcast and edges stay where they are; more are
    # joined by a shuffle, where adaptive execution splits what a hub makes large.
    near = lambda df: F.broadcast(df) if count <= BROADCAST_EDGES else df
    now = cut(edges.select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).where("u <> v").distinct(), rows)
    mark, count = None, now.count()
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, rows)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark, count = new, new[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
