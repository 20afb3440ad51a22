"""Incremental raw-file import (S5 as a stream).

The analysed project has no streaming workload: no event time, watermark,
window or state.  What does arrive over time is raw extract files, which the
batch pipeline imports in bulk.  This module imports them incrementally with
Structured Streaming: a file source picks up new files, only the stateless
row-level rules run on each micro-batch, and a checkpointed file sink appends
to the bronze table exactly once per file.

Rules that need the whole population (de-duplication, IQR fences, per-patient
sequencing, every aggregate) deliberately stay in the batch pipeline, which
reads the table this stream maintains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..operators import clean as CL

MISSING_POLICY = dict(
    presence_flags={"weight": "weight_available"},
    fills={**{c: C.UNKNOWN for c in C.FILL_UNKNOWN_COLS}, **{c: "None" for c in C.FILL_NONE_COLS}},
    missing_flags={"diag_1": "diag_1_missing_flag"},
)


def row_rules(df: DataFrame, schema: C.EncounterSchema = C.ENCOUNTERS) -> DataFrame:
    """The stateless cleaning rules (C1, C3-C7), valid per micro-batch."""
    df = CL.replace_sentinel(df, schema.sentinel)
    df = CL.treat_missing(df, **MISSING_POLICY)
    df = CL.correct_dtypes(df, schema.id_cols, schema.numeric_cols)
    df = CL.standardize_text(df, upper_cols=[schema.target], rename=schema.rename_map)
    df = CL.flag_invalid(df, "gender", schema.valid_gender, "gender_invalid_flag")
    return CL.flag_codes(df, "discharge_disposition_id", schema.expired_dispositions,
                         "expired_or_hospice_flag")


def ingest_raw_files(spark: SparkSession, source_dir: str, target_dir: str, checkpoint: str,
                     schema: T.StructType, fmt: str = "csv", available_now: bool = True,
                     max_files_per_trigger: int | None = None, **options) -> StreamingQuery:
    """Start the incremental import; returns the running query.

    ``available_now`` processes every file present and stops (a scheduled
    batch-style run); otherwise the query keeps polling for new files.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
        # Raw text is kept exactly as delivered; stripping is a cleaning rule.
        options.setdefault("ignoreLeadingWhiteSpace", "false")
        options.setdefault("ignoreTrailingWhiteSpace", "false")
    if max_files_per_trigger:
        options["maxFilesPerTrigger"] = str(max_files_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = row_rules(reader.load(source_dir))
    writer = (rows.writeStream.format("parquet").option("path", target_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
