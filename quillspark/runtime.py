"""What every operator needs from the session: cut lineage, and the package on the executors."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Run `df` once into the checkpoint folder all executors share, and go on from those files.

    The folder is the session's spark.checkpoint.dir. Only a local[*] session without that setting gets
    a folder of its own; on a cluster a missing setting is an error, as no machine-local folder would do.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        sc.setCheckpointDir(folder)
    # The plan's shuffle files go as soon as its rows are written; what reads them later reads the checkpoint.
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        done = df.select("*").checkpoint(eager=True)
    finally:
        conf.set(_CLEAN, before)
    if time.monotonic() - getattr(sc, "_quillspark_collected", 0.0) > 1:
        free(df.sparkSession)
    return done


def free(spark: SparkSession) -> None:
    """Let go of the files of plans nothing refers to any more: they are removed only after the driver's collector ran.

    Worth calling before a large step, once the tables that went before are deleted.
    """
    gc.collect()  # tables in cycles of Python objects hold their plans too
    sc = spark.sparkContext
    sc._jvm.System.gc()
    sc._quillspark_collected = time.monotonic()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-ship-"), "quillspark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillspark", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._quillspark_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """`df`, materialized, with a broadcast hint if it is counted to have at most `most_rows` narrow rows; else left to a shuffle join."""
    return df.hint("broadcast") if df.count() <= most_rows else df


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """`df` with each row's place from 0 in a total order. Rows are dealt out by ranges, so no task sees all of them; the driver
    gets a count a partition."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    first, at = [], 0
    for part, size in sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect()):
        first += [F.lit(part), F.lit(at).cast("long")]
        at += size
    place = F.create_map(*first)[F.col("_part")] + F.col("_row") if first else F.lit(0).cast("long")
    return rows.withColumn(name, place).drop("_part", "_row")
