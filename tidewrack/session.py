"""Sessions: settings for large tables, and workers that can import this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For large clusters; sizes are per task, so they hold at any scale.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def importable(spark: SparkSession) -> SparkSession:
    """Python workers that start from now on find this package where the driver has found it.

    This is enough where executors see the same folders or images; elsewhere, ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, known]) if known else root
    return spark


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, qualified by its file system: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewrack-checkpoints-")
    if not current.isDefined():
        context.setCheckpointDir(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    said = place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + said.removeprefix("file:") if said.startswith("file:/") and not said.startswith("file://") else said


def shared_subdir(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A table with less than this for each core is dealt out before work on its texts.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, as it comes from its files, dealt over all cores; larger ones as they are.

    A file is read by row groups, and a small table may be one of them, so that a single core would do all the work on its
    texts. The rows are dealt by a seeded random number: unlike a round robin, no filter is moved to the scan across it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, F.rand(1)) if 1 < cores and size < cores * SPREAD_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared checkpoint folder from then on: a lost executor costs tasks, not results."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
