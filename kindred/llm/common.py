"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch to Python.  Bounds a worker's memory where texts are long.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    The folder is the one that the session's ``spark.checkpoint.dir`` names; only
    where that is unset and all runs on one machine, a folder of our own is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of our own, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="kindred-")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    It learns of them when the driver's heap is collected, which between short jobs may be late.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole_row() -> Column:
    """All columns of a row as one struct ``row``; ``select("row.*")`` has them back, whatever their names."""
    return F.struct("*").alias("row")


def spread(df: DataFrame) -> DataFrame:
    """The same rows in no known partitioning.

    A join against an aggregate of one of its sides would reuse the aggregate's
    partitioning, and then a key with many rows can't be split at run time; after this it can.
    """
    return df.hint("rebalance")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, followed by as many underscores as it takes to be none of ``taken``, case aside."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.when(
        F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)
    ).otherwise(
        F.size(F.split(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    ).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list by alternating star contraction.

    Returns ``node, root`` for every node of an edge, ``root`` being the smallest
    node of its component.  Each round is two aggregations; large stars are
    aggregated map-side, and no node's neighbours are ever gathered in one place.
    Null ends and self loops are ignored; an empty edge list gives no rows.
    """
    e = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    # every node points to a smaller one, or to itself if it is a root
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e)
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u points to the least of u's neighbourhood
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = up.where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = down.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(down)
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
        del both, low, up, least, down
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    parts = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return parts.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
