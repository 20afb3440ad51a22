"""Entry A: raw -> clean (silver) -> features -> sequenced base view.

The order of the steps matters and follows the analysed pipeline: sentinels
become NULL before the missing-value policy; codes are normalised before the
code-list flag; text is standardised before vocabulary checks; outlier fences
are computed on the full population, before exclusions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import clean as CL
from ..operators.encounters import encounter_base, valid_encounters
from ..operators.features import engineer_features
from ..session import drop_stored, materialize
from ..sources.adapter import raw_encounters
from ..sources.sinks import save_bucketed

MISSING_POLICY = dict(
    presence_flags={"weight": "weight_available"},
    fills={**{c: C.UNKNOWN for c in C.FILL_UNKNOWN_COLS}, **{c: "None" for c in C.FILL_NONE_COLS}},
    missing_flags={"diag_1": "diag_1_missing_flag"},
)


def clean_encounters(raw: DataFrame, schema: C.EncounterSchema = C.ENCOUNTERS,
                     multiplier: float = 1.5, cached: list | None = None) -> tuple[DataFrame, DataFrame]:
    """C1-C9 then F1-F5; returns (clean table, outlier report).

    The de-duplicated rows feed three readers here (the key-conflict count, the
    outlier fences and the row pass) and several reports.  When ``cached`` is a
    list they are written once to the checkpoint folder and the stored frame is
    appended, so the de-duplication shuffle runs once.
    """
    df = CL.replace_sentinel(raw, schema.sentinel)
    if cached is not None:
        df = materialize(CL.drop_exact_duplicates(df, key=schema.primary_key), "deduplicated")
        cached.append(df)
    else:
        df = df.dropDuplicates()
    df = CL.flag_key_conflicts(df, schema.primary_key)
    df = CL.treat_missing(df, **MISSING_POLICY)
    df = CL.correct_dtypes(df, schema.id_cols, schema.numeric_cols)
    df = CL.standardize_text(df, upper_cols=[schema.target], rename=schema.rename_map)
    df = CL.flag_invalid(df, "gender", schema.valid_gender, "gender_invalid_flag")
    df = CL.flag_codes(df, "discharge_disposition_id", schema.expired_dispositions,
                       "expired_or_hospice_flag")
    df, report = CL.flag_iqr_outliers(df, schema.numeric_cols, multiplier)
    df = engineer_features(df, schema.medication_cols_clean,
                           polypharmacy_threshold=schema.polypharmacy_threshold)
    return df, report


@dataclass
class Layers:
    raw: DataFrame
    clean: DataFrame
    outliers: DataFrame
    base: DataFrame
    deduplicated: DataFrame | None = None
    _cube: DataFrame | None = None

    @property
    def cube(self) -> DataFrame:
        """Every segment family of the base view, aggregated once (small)."""
        if self._cube is None:
            from .cube import encounter_cube
            self._cube = encounter_cube(self.base).persist(StorageLevel.MEMORY_AND_DISK)
        return self._cube


_CACHE: dict[tuple, Layers] = {}


def layers_from_raw(raw: DataFrame, materialized: bool = True) -> Layers:
    """Clean and sequence a stored raw encounter table.

    The clean table is written once to the checkpoint folder (or persisted
    when none is configured); the base view is computed from it once and
    written as well.  Reports read the columns they need from storage: keeping
    the whole view in memory cost more than the scans it saved.
    """
    cached: list = []
    clean, outliers = clean_encounters(raw, cached=cached if materialized else None)
    if materialized:
        clean = materialize(clean, "clean")
        # The outlier report stays lazy: only the C9 report reads it, and it
        # recomputes from the stored raw table when asked.
    base = encounter_base(clean)
    if materialized:
        base = materialize(base, "base")
    kept = cached[0] if cached else CL.replace_sentinel(raw, C.ENCOUNTERS.sentinel).dropDuplicates()
    return Layers(raw, clean, outliers, base, kept)


def bucketed_base(clean: DataFrame, table: str, path: str, buckets: int | None = None,
                  schema: C.EncounterSchema = C.ENCOUNTERS) -> DataFrame:
    """B0 over a table bucketed by entity (S11): the sequencing windows (W1-W3) read whole
    entities from their buckets, so the view needs no shuffle, however often it is computed.

    The valid rows are shuffled once, when ``table`` is written to ``path``.  Entities that
    are hot by ``sequence``'s measure are still cut into slices.
    """
    spark = clean.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    save_bucketed(valid_encounters(clean), table, schema.entity_key, [schema.primary_key], buckets, path=path)
    return encounter_base(spark.table(table), exclusions=())


def build_layers(spark: SparkSession, sf_dir: str, materialized: bool = True) -> Layers:
    """Layers of the driver dataset in ``sf_dir`` (through the encounter
    adapter), built once per session, directory and state of its files.

    New files under the same path are seen: the key holds the input files'
    names, sizes and times, and the layers of the older state are released.
    """
    key = (spark.sparkContext.applicationId, sf_dir, materialized)
    state = input_state(spark, sf_dir)
    hit = _CACHE.get(key)
    if hit is not None and hit[0] == state:
        return hit[1]
    if hit is not None:
        release_layers(hit[1])
    raw = raw_encounters(spark, sf_dir)
    if materialized:
        # The derived raw table is stored once, like the raw table of a warehouse.
        raw = materialize(raw, "raw")
    layers = layers_from_raw(raw, materialized)
    _CACHE[key] = (state, layers)
    return layers


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """(name, size, time) of the adapter's input files, through Spark's file systems."""
    from ..sources.adapter import TABLES
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(sorted(out))


def release_layers(layers: Layers) -> None:
    """Give back the cached frames of layers that are no longer read."""
    for frame in (layers.base, layers._cube):
        if frame is not None:
            frame.unpersist()


def drop_layers(spark: SparkSession, sf_dir: str) -> None:
    """Forget the layers of ``sf_dir``: release what is cached and delete their stored tables."""
    for materialized in (True, False):
        hit = _CACHE.pop((spark.sparkContext.applicationId, sf_dir, materialized), None)
        if hit is not None:
            release_layers(hit[1])
            if materialized:
                for frame in (hit[1].raw, hit[1].deduplicated, hit[1].clean, hit[1].base):
                    drop_stored(frame)


def run_reports(actions: dict, threads: int = 8) -> dict[str, float]:
    """Run independent report actions concurrently; returns seconds per action.

    The reports are small jobs over the same cached layers, so their cost is
    mostly scheduling; submitting them from several driver threads lets the
    scheduler interleave them on the cluster.  Each action is a callable that
    triggers one job (collect, write).
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    def timed(item):
        name, action = item
        t = time.perf_counter()
        action()
        return name, time.perf_counter() - t

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return dict(pool.map(timed, actions.items()))


def run_pipeline(raw: DataFrame, out_dir: str) -> dict[str, str]:
    """Entry A end to end on a stored raw table.

    profile reports -> clean + features -> pre-export audit -> staged publish
    of the clean table -> base view -> KPI / EDA reports -> test battery.
    Reports are small and written as one CSV each; the clean table is
    published as parquet.  Returns {output name: path}.
    """
    from ..operators import audit as V
    from ..operators import profile as P
    from ..sources import sinks as S
    from . import battery, cube

    schema = C.ENCOUNTERS
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}

    pending: dict = {}

    def report(name: str, df: DataFrame) -> None:
        paths[name] = f"{out}/reports/{name}"
        pending[name] = lambda: S.write_report_csv(df, paths[name])

    report("profile_structure", P.profile_structure(raw))
    report("profile_sentinels", P.sentinel_counts(raw, schema.sentinel))
    report("profile_cardinality", P.profile_cardinality(raw, schema.categorical_cols))
    report("profile_numeric", P.profile_numerics(raw, schema.numeric_cols))

    run_reports(pending)
    pending.clear()
    layers = layers_from_raw(raw)
    layers.cube.count()  # build the shared segment totals once, before the reports
    report("outliers", layers.outliers)
    features = ("num_active_medications", "any_medication_change", "age_midpoint",
                "total_prior_visits", "polypharmacy_flag", "weight_available")

    def audit(staged: DataFrame) -> DataFrame:
        return V.pre_export_audit(staged, schema.primary_key, schema.target, schema.valid_target,
                                  features, schema.sentinel)
    paths["clean_table"] = f"{out}/clean_table"
    report("pre_export_audit", S.staged_publish(layers.clean, paths["clean_table"], audit))

    from .kpi import kpi_high_risk_segments, kpi_los_by_readmission, kpi_overall, kpi_repeat_patients
    report("kpi_overall", kpi_overall(layers.base))
    report("kpi_los_by_readmission", kpi_los_by_readmission(layers.base))
    report("kpi_high_risk_segments", kpi_high_risk_segments(layers.base))
    report("kpi_repeat_patients", kpi_repeat_patients(layers.base))
    for name, fn in cube.CUBE_QUERIES.items():
        report(name, fn(layers.cube))
    report("test_battery", battery.battery(layers.base))
    run_reports(pending)
    return paths
