"""Session helpers: settings the library reads, and where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A window group larger than this is split over several tasks.
HOT_ROWS_KEY = "spark.apexline.hotRows"
HOT_ROWS_DEFAULT = 2_000_000


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one of our own only locally."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        # Only where everything runs in one process; gone when it ends.
        shared = tempfile.mkdtemp(prefix="apexline-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """As cut, but Spark forgets the size and the constraints that it derived for df.

    A checkpoint keeps them, and a join's size is the product of its sides'. In a loop that joins what it cut before,
    the product's digits grow threefold a step, until they fill the driver's memory. Without a size a table counts as
    large until Spark has shuffled it and knows.
    """
    spark, kept = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
