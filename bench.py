"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

  base_build        raw -> clean (written) -> base view (persisted), cold
  k*/e*             every KPI view and EDA query on the persisted base (warm)
  kpi_eda_warm      sum of the above (one query at a time)
  kpi_eda_batch     the same reports submitted together from several driver
                    threads (run_reports), as a report refresh runs them
  kpi_eda_recompute the same suite with the base view recomputed from the
                    clean table for every query (no persist) -- a diagnostic
                    comparison, reported but not part of the headline value
  profile           structure, sentinel, cardinality and numeric profiles
  battery           the seven-test battery with p-values

value = base_build + base_count + kpi_eda_batch + profile + battery (the
pipeline as it runs: layers built once, the reports on top of them).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from cohortlens.operators.encounters import encounter_base
    from cohortlens.plans import registry
    from cohortlens.plans.pipeline import build_layers
    from cohortlens.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 4), app_name="cohortlens-bench")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    layers = timed("base_build", lambda: build_layers(spark, sf_dir))
    timed("base_count", lambda: layers.base.count())

    suite = [k for k in registry.QUERIES if re.match(r"^(k\d|e\d)", k)]
    for name in suite:
        timed(name, lambda n=name: registry.QUERIES[n](spark, sf_dir).collect())
    times["kpi_eda_warm"] = round(sum(times[n] for n in suite), 3)

    # The same reports submitted together, as a report refresh runs them.
    from cohortlens.plans.pipeline import run_reports
    actions = {n: (lambda n=n: registry.QUERIES[n](spark, sf_dir).collect()) for n in suite}
    # The refresh builds the shared segment totals itself.
    if layers._cube is not None:
        layers._cube.unpersist()
        layers._cube = None
    timed("kpi_eda_batch", lambda: run_reports(actions, threads=cpus))

    from cohortlens.plans import eda, kpi
    fns = list(registry.K_FN.values()) + list(registry.E_FN.values()) + [kpi.kpi_view_row_counts]
    assert eda is not None

    def recompute():
        for fn in fns:
            fn(encounter_base(layers.clean)).collect()
    timed("kpi_eda_recompute", recompute)

    def profile():
        for n in ("q1_structure_profile", "q2_sentinel_report", "q3_cardinality_top10", "q4_numeric_profile"):
            registry.QUERIES[n](spark, sf_dir).collect()
    timed("profile", profile)
    timed("battery", lambda: registry.QUERIES["h5_test_battery"](spark, sf_dir).collect())

    total = round(times["base_build"] + times["base_count"] + times["kpi_eda_batch"]
                  + times["profile"] + times["battery"], 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
