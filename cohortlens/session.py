"""Session construction and lineage cutting.

On a cluster the shared checkpoint folder comes from ``spark.checkpoint.dir``
(set by whoever runs the cluster).  Only a local-mode session without one
(tests, the local bench) gets a scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cohortlens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Wide projections generate methods above HotSpot's 8 KB JIT limit;
        # without this flag they would run in the bytecode interpreter.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder, or None when none is configured.

    A local-mode session without one gets a fresh scratch folder (this is the
    test/bench case); a cluster session without one returns None so callers
    fall back to ``persist`` instead of writing to a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        base = os.environ.get("TMPDIR", "/tmp")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=base))
        return sc.getCheckpointDir()
    return None


def drop_stored(df: DataFrame) -> None:
    """Delete the folders that ``materialize`` wrote for ``df`` (nothing else)."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = checkpoint_dir(spark)
    for folder_of_files in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder and "/cohortlens/" in folder_of_files:
            path = jvm.org.apache.hadoop.fs.Path(folder_of_files)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str = "layer", reliable: bool = True) -> DataFrame:
    """Compute ``df`` once and reuse it.

    With a checkpoint folder the result is written there as parquet and read
    back: it survives executor loss, cuts the lineage, is computed exactly
    once (``DataFrame.checkpoint`` would run the plan twice unless it were
    also persisted) and later scans get column pruning and pushed filters.
    Without one the frame is persisted to memory and disk; lost blocks are
    recomputed from lineage.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark) if reliable else None
    if folder:
        path = f"{folder.rstrip('/')}/cohortlens/{name}-{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out
