"""Every report served from the one-pass segment totals equals its direct query."""

import pytest

from conftest import SMOKE


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def layers(spark):
    from cohortlens.plans.pipeline import build_layers
    return build_layers(spark, SMOKE)


DIRECT = {
    "k2_diagnosis": "kpi.kpi_by_diagnosis", "k3_disposition": "kpi.kpi_by_disposition",
    "k5_age_prior_inpatient": "kpi.kpi_by_age", "k6_specialty": "kpi.kpi_by_specialty",
    "e1_target_distribution": "eda.target_distribution", "e4_race": "eda.rate_by_race",
    "e5_utilisation_by_outcome": "eda.utilisation_by_outcome", "e6_los_band": "eda.rate_by_los_band",
    "e7_diagnosis": "eda.rate_by_diagnosis", "e8_top_specialties": "eda.top_specialties",
    "e9_admission_source": "eda.rate_by_admission_source",
    "e12_change_x_diabetes_med": "eda.change_by_diabetes_med", "e13_polypharmacy": "eda.rate_by_polypharmacy",
    "e14_encounter_tier": "eda.rate_by_encounter_tier", "e15_repeat_vs_first": "eda.repeat_vs_first",
    "e17_age_volume_rate": "eda.age_volume_and_rate", "d4_share_vs_events": "eda.share_vs_events",
    "d5_tier_steps": "eda.tier_steps",
}


@pytest.mark.parametrize("name", sorted(DIRECT))
def test_cube_report_equals_direct(layers, name):
    import importlib

    from cohortlens.plans.cube import CUBE_QUERIES
    mod, fn = DIRECT[name].split(".")
    direct = getattr(importlib.import_module(f"cohortlens.plans.{mod}"), fn)(layers.base)
    assert _rows(CUBE_QUERIES[name](layers.cube)) == _rows(direct)


@pytest.mark.parametrize("column", ["age", "gender", "insulin", "A1Cresult", "num_active_medications"])
def test_cube_rate_by_equals_direct(layers, column):
    from cohortlens.plans import cube, eda
    assert _rows(cube.rate_by(layers.cube, column)) == _rows(eda.rate_by(layers.base, column))


def test_cube_baselines_equal_direct(layers):
    from cohortlens.operators.distributions import rate_by_value_vs_baseline
    from cohortlens.plans import cube, eda
    assert _rows(cube.segments_vs_baseline(layers.cube, "gender")) == \
        _rows(eda.segments_vs_baseline(layers.base, "gender"))
    assert _rows(cube.active_meds_vs_baseline(layers.cube)) == \
        _rows(rate_by_value_vs_baseline(layers.base, "num_active_medications", "led_to_30day_readmission"))
