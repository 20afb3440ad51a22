"""Sinks: table writes, staged publish, report CSVs, data dictionary, views,
write-time layout (S6-S11)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> DataFrame:
    """Write, then confirm the load by re-reading the row count (V3).

    Returns one row (rows_written, rows_read_back, confirmed).  The written count
    is observed by the write itself (``Observation``), so the source is not run a
    second time; the other one is read from storage.
    """
    written = observed_write(df, path, fmt, mode, partition_by)
    return load_confirmation(written, df.sparkSession.read.format(fmt).load(path))


def observed_write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: Sequence[str] | None = None) -> int:
    """Write ``df`` and return how many rows the write saw."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return seen.get["rows"]


def load_confirmation(written: int, loaded: DataFrame) -> DataFrame:
    """V3: (rows_written, rows_read_back, confirmed); ``written`` is what the write observed."""
    return (loaded.agg(F.count(F.lit(1)).alias("rows_read_back"))
            .select(F.lit(written).cast("long").alias("rows_written"), "rows_read_back")
            .withColumn("confirmed", F.col("rows_written") == F.col("rows_read_back")))


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
               batch_size: int = 1000, truncate: bool = True, num_partitions: int | None = None) -> None:
    """S6 against a database: overwrite keeping the table definition
    (``truncate``) with batched inserts; parallelism = ``num_partitions``."""
    out = df.coalesce(num_partitions) if num_partitions else df
    (out.write.mode("overwrite").option("truncate", str(truncate).lower())
     .option("batchsize", str(batch_size)).jdbc(url, table, properties=dict(properties or {})))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def staged_publish(df: DataFrame, target: str, audit: Callable[[DataFrame], DataFrame] | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """Write to a staging folder, audit the staged copy, then publish.

    Readers of ``target`` never see a half-written table: the data lands in
    ``<target>.staging-<id>`` first; only if the audit passes is the old target
    moved aside and the staging folder renamed into place.  Both renames are
    checked: if the second one fails the old target is put back and the call
    raises.  Between the two renames (metadata operations on HDFS-like stores) the
    path is missing for a moment; readers that must not see that should read
    through a view that is replaced after publishing.  The replaced table is
    deleted at the end, a rejected staging folder before raising.  Returns the
    audit report.
    """
    spark = df.sparkSession
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    written = observed_write(df, staging, fmt)
    staged = spark.read.format(fmt).load(staging)
    report = audit(staged) if audit is not None else load_confirmation(written, staged)
    from ..operators.audit import enforce
    fs, tgt, jvm = _fs(spark, target)
    new = jvm.org.apache.hadoop.fs.Path(staging)
    try:
        enforce(report, "passed" if "passed" in report.columns else "confirmed")
    except ValueError:
        fs.delete(new, True)
        raise
    # The report is a handful of check rows; keep it as data because the
    # staging folder it was computed from is about to be renamed.
    report = spark.createDataFrame(report.collect(), report.schema)
    old = None
    if fs.exists(tgt):
        old = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.previous-{uuid.uuid4().hex}")
        if not _rename(fs, tgt, old):
            raise OSError(f"{target} could not be moved aside; it is unchanged")
    if not _rename(fs, new, tgt):
        if old is not None and not _rename(fs, old, tgt):
            raise OSError(f"publishing failed and the old table is left at {old.toString()}")
        raise OSError(f"{staging} could not be published; {target} is as before")
    if old is not None:
        fs.delete(old, True)
    return report


def publish_version(df: DataFrame, target: str, audit: Callable[[DataFrame], DataFrame] | None = None,
                    fmt: str = "parquet", keep: int = 2) -> DataFrame:
    """S7 without a gap: a new version beside the old ones, published by a pointer.

    The rows go to ``<target>/versions/<id>``; if the audit of that copy passes, an empty
    file ``<target>/pointers/<number>.<id>`` publishes it.  Creating a file is one atomic
    step on any Hadoop file system, so ``read_published`` finds the old version whole or the
    new one whole, and no folder is ever renamed.  Of two publishers with the same number
    the larger id counts as the newer.  The ``keep`` newest versions stay for readers that
    began earlier; older ones lose their pointer first and are then deleted.  A rejected
    version is deleted before raising.  Returns the audit report.
    """
    from ..operators.audit import enforce
    if keep < 1:
        raise ValueError("keep must be at least 1")
    spark, root = df.sparkSession, target.rstrip("/")
    version = uuid.uuid4().hex
    fs, pointers, jvm = _fs(spark, f"{root}/pointers")
    data = f"{root}/versions/{version}"
    written = observed_write(df, data, fmt)
    staged = spark.read.format(fmt).load(data)
    report = audit(staged) if audit is not None else load_confirmation(written, staged)
    try:
        enforce(report, "passed" if "passed" in report.columns else "confirmed")
    except ValueError:
        fs.delete(jvm.org.apache.hadoop.fs.Path(data), True)
        raise
    fs.mkdirs(pointers)
    names = _pointers(spark, root)
    number = int(names[-1].split(".")[0]) + 1 if names else 0
    name = f"{number:012d}.{version}"
    if not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{name}")):
        raise OSError(f"{target} could not be pointed at {version}; it is as before")
    for old in sorted([*names, name])[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{old}"), False)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{old.split('.')[1]}"), True)
    return report


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers, oldest first (``keep`` of them and those being replaced)."""
    fs, folder, _ = _fs(spark, f"{root}/pointers")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def published_versions(spark: SparkSession, target: str) -> list[str]:
    """Folders of the published versions, oldest first."""
    root = target.rstrip("/")
    return [f"{root}/versions/{name.split('.')[1]}" for name in _pointers(spark, root)]


def read_published(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """The newest version of a table written by ``publish_version``."""
    versions = published_versions(spark, target)
    if not versions:
        raise FileNotFoundError(f"no published version of {target}")
    return spark.read.format(fmt).load(versions[-1])


def _rename(fs, source, target) -> bool:
    return bool(fs.rename(source, target))


def write_report_csv(report: DataFrame, path: str) -> None:
    """A report-size frame as one CSV file with a header; white space in values is kept."""
    (report.coalesce(1).write.mode("overwrite").option("header", "true")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


def data_dictionary(df: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """(column, spark_type, description, non_null) of a table.

    The descriptions are also attached to the schema as column comments
    (``with_comments``); non-null counts come from one aggregate.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("spark_type"),
                     F.lit(descriptions.get(f.name)).cast("string").alias("description"),
                     F.col(f"n{i}").alias("non_null"))
            for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*rows)))


def with_comments(df: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """Attach descriptions as ``comment`` metadata on the columns."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": descriptions[c]}) if c in descriptions
                       else F.col(c) for c in df.columns])


def register_view(df: DataFrame, name: str, global_view: bool = False) -> DataFrame:
    """Create or replace a named view."""
    (df.createOrReplaceGlobalTempView if global_view else df.createOrReplaceTempView)(name)
    return df


def drop_view(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)


def write_layout(df: DataFrame, path: str, entity: str, order: Sequence[str],
                 partitions: int | None = None) -> None:
    """Write clustered by entity and sorted by (entity, order) so later
    per-entity windows read co-located, sorted files and parquet min/max
    statistics skip row groups on entity and key predicates."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, F.col(entity)).sortWithinPartitions(entity, *order)
     .write.mode("overwrite").parquet(path))


def save_bucketed(df: DataFrame, table: str, entity: str, order: Sequence[str], buckets: int,
                  path: str | None = None, files: int = 4) -> None:
    """S11 with a catalog: bucketed table, each file sorted by (entity, order); joins and
    windows on ``entity`` then read without a shuffle.

    Rows are dealt to tasks by bucket and a slice of the row's hash, so a bucket is written
    by at most ``files`` tasks, as files of its own each, and a hot entity by as many.  A
    ``path`` makes the table an external one.
    """
    bucket = F.pmod(F.hash(F.col(entity)), F.lit(buckets))
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in (entity, *order)]), F.lit(files))
    dealt = df.repartition(buckets * files, bucket, piece)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, entity).sortBy(entity, *order)
    (writer.option("path", path) if path else writer).saveAsTable(table)
