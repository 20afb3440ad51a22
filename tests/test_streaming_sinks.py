import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE


def _raw(spark):
    from cohortlens.sources.adapter import raw_encounters
    return raw_encounters(spark, SMOKE)


def test_stream_import_equals_batch_row_rules(spark):
    from cohortlens.sources.adapter import raw_schema
    from cohortlens.streaming import ingest_raw_files, row_rules
    work = tempfile.mkdtemp(prefix="cohortlens-stream-")
    src = os.path.join(work, "incoming")
    raw = _raw(spark)
    keep_spaces = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw.filter(F.col("encounter_id") % 2 == 0).coalesce(1).write.options(**keep_spaces).csv(src + "/a")
    raw.filter(F.col("encounter_id") % 2 == 1).coalesce(1).write.options(**keep_spaces).csv(src + "/b")
    q = ingest_raw_files(spark, src + "/*", os.path.join(work, "bronze"), os.path.join(work, "ckpt"),
                         raw_schema(), fmt="csv")
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(work, "bronze"))
    exp = row_rules(raw)
    assert got.count() == raw.count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_staged_publish_and_layout(spark):
    from cohortlens.operators.audit import pre_export_audit
    from cohortlens.sources import sinks as S
    work = tempfile.mkdtemp(prefix="cohortlens-sink-")
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"),
                                 F.lit("NO").alias("t"), (F.col("id") % 2).cast("int").alias("x_flag"))
    target = os.path.join(work, "table")
    rep = S.staged_publish(df, target, lambda st: pre_export_audit(st, "k", "t", ["NO"], []))
    assert all(r.passed for r in rep.collect())
    assert spark.read.parquet(target).count() == 100
    S.staged_publish(df.limit(10), target)          # republish replaces the table
    assert spark.read.parquet(target).count() == 10
    S.write_layout(df, os.path.join(work, "layout"), "g", ["k"], partitions=3)
    back = spark.read.parquet(os.path.join(work, "layout"))
    assert back.count() == 100
    per_file = back.groupBy(F.input_file_name()).agg(F.countDistinct("g").alias("n")).collect()
    assert sum(r.n for r in per_file) == 7          # every entity lives in exactly one file


def test_failed_audit_blocks_publish(spark):
    import pytest

    from cohortlens.operators.audit import pre_export_audit
    from cohortlens.sources import sinks as S
    work = tempfile.mkdtemp(prefix="cohortlens-sink-")
    df = spark.range(5).select(F.col("id").alias("k"), F.lit("?").alias("t"))
    with pytest.raises(ValueError):
        S.staged_publish(df, os.path.join(work, "t"), lambda st: pre_export_audit(st, "k", "t", ["NO"], []))
    assert not os.path.exists(os.path.join(work, "t"))


def test_run_pipeline_writes_reports_and_clean_table(spark):
    from cohortlens.plans.pipeline import run_pipeline
    from cohortlens.session import materialize
    work = tempfile.mkdtemp(prefix="cohortlens-run-")
    raw = materialize(_raw(spark), "raw-test")
    paths = run_pipeline(raw, work)
    assert spark.read.parquet(paths["clean_table"]).count() == raw.dropDuplicates().count()
    kpi = spark.read.option("header", "true").csv(paths["kpi_overall"]).collect()
    assert len(kpi) == 1 and int(kpi[0]["total_encounters"]) > 0
    assert spark.read.option("header", "true").csv(paths["test_battery"]).count() == 7
    assert spark.read.option("header", "true").csv(paths["e14_encounter_tier"]).count() == 4


def test_csv_import_with_explicit_schema_keeps_codes_as_text(spark):
    from cohortlens.sources.adapter import raw_schema
    from cohortlens.sources.readers import read_raw
    work = tempfile.mkdtemp(prefix="cohortlens-csv-")
    raw = _raw(spark)
    (raw.coalesce(2).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(work + "/raw"))
    back = read_raw(spark, work + "/raw", raw_schema(), fmt="csv")
    assert back.schema == raw_schema()
    assert back.count() == raw.count()
    # codes such as '6.0' survive as text; sentinels stay '?'
    assert back.filter(F.col("admission_type_id").endswith(".0")).count() > 0
    assert back.exceptAll(raw).count() == 0


def test_failed_rename_restores_the_old_table(spark, monkeypatch):
    import pytest

    from cohortlens.sources import sinks as S
    work = tempfile.mkdtemp(prefix="cohortlens-sink-")
    target = os.path.join(work, "table")
    S.staged_publish(spark.range(20).toDF("k"), target)
    real, calls = S._rename, []

    def second_fails(fs, source, to):
        calls.append(to)
        return False if len(calls) == 2 else real(fs, source, to)
    monkeypatch.setattr(S, "_rename", second_fails)
    with pytest.raises(OSError):
        S.staged_publish(spark.range(5).toDF("k"), target)
    assert spark.read.parquet(target).count() == 20
    assert not [x for x in os.listdir(work) if ".previous-" in x]


def test_written_count_comes_from_the_write(spark):
    from cohortlens.sources import sinks as S
    work = tempfile.mkdtemp(prefix="cohortlens-sink-")
    row = S.write_table(spark.range(33).toDF("k"), os.path.join(work, "t")).first()
    assert (row.rows_written, row.rows_read_back, row.confirmed) == (33, 33, True)


def test_changed_input_folder_gives_new_layers(spark):
    import shutil

    from conftest import SMOKE
    from cohortlens.plans.pipeline import build_layers, drop_layers
    work = tempfile.mkdtemp(prefix="cohortlens-input-")
    for name in ("orders", "lineitem", "customer", "nation", "region", "supplier", "part"):
        shutil.copyfile(f"{SMOKE}/{name}.parquet", f"{work}/{name}.parquet")
    before = build_layers(spark, work).raw.count()
    assert build_layers(spark, work) is build_layers(spark, work)
    half = spark.read.parquet(f"{SMOKE}/orders.parquet").limit(100)
    half.toPandas().to_parquet(f"{work}/orders.parquet", coerce_timestamps="us")
    after = build_layers(spark, work).raw.count()
    assert 0 < after < before
    drop_layers(spark, work)


def test_versions_are_published_without_a_gap(spark, monkeypatch):
    import pytest

    from cohortlens.sources import sinks as S
    target = os.path.join(tempfile.mkdtemp(prefix="cohortlens-versions-"), "table")
    with pytest.raises(FileNotFoundError):
        S.read_published(spark, target)
    S.publish_version(spark.range(20).toDF("k"), target)
    early, seen = S.read_published(spark, target), []
    real = S.observed_write

    def watched(df, *args):        # while the next version is being written the old one is read
        seen.append(S.read_published(spark, target).count())
        n = real(df, *args)
        seen.append(S.read_published(spark, target).count())
        return n
    monkeypatch.setattr(S, "observed_write", watched)
    S.publish_version(spark.range(7).toDF("k"), target)
    assert seen == [20, 20] and S.read_published(spark, target).count() == 7 and early.count() == 20
    with pytest.raises(ValueError):      # a rejected version is neither seen nor left behind
        S.publish_version(spark.range(3).toDF("k"), target, lambda t: t.agg(F.lit(False).alias("passed"), F.lit("x").alias("check")))
    assert S.read_published(spark, target).count() == 7
    S.publish_version(spark.range(5).toDF("k"), target)
    assert [spark.read.parquet(v).count() for v in S.published_versions(spark, target)] == [7, 5]
    assert len(os.listdir(os.path.join(target, "versions"))) == 2
    with pytest.raises(ValueError):
        S.publish_version(spark.range(1).toDF("k"), target, keep=0)
