"""Hand values of the KPI formulas."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.kpi import with_true_efficiency

COLUMNS = ("model string, hashrate_th double, power_w double, voltage_v double, operating_mode string, "
           "ambient_temperature_c double")
SPEC = 234 / (3510 * 1.2)


def te(spark, *rows):
    return with_true_efficiency(spark.createDataFrame(rows, COLUMNS)).collect()


def test_at_spec_and_modes(spark):
    normal, shutdown, idle, unknown = te(
        spark,
        ("Pro", 234.0, 3510.0, 0.38, "Normal", 20.0), ("Pro", 234.0, 3510.0, 0.38, "Shutdown", 20.0),
        ("Pro", 234.0, 3510.0, 0.38, "Idle", 20.0), ("Pro", 234.0, 3510.0, 0.38, "Turbo", 20.0))
    assert normal.te_base == pytest.approx(SPEC) == pytest.approx(unknown.te_base)
    assert normal.te_health == pytest.approx(SPEC)
    assert shutdown.te_base == 0 and idle.te_base == 0


def test_voltage_penalty_is_symmetric_and_clipped(spark):
    high, low, extreme = te(
        spark, *[("Pro", 234.0, 3510.0, v, "Normal", 20.0) for v in (0.456, 0.304, 5.0)])
    assert high.te_base == pytest.approx(SPEC * 0.9) == pytest.approx(low.te_base)
    assert 0 <= extreme.te_base < 0.1 * SPEC


def test_ambient_penalty(spark):
    at, hot, cold = te(spark, *[("Pro", 234.0, 3510.0, 0.38, "Normal", a) for a in (25.0, 45.0, 10.0)])
    assert at.te_adjusted == pytest.approx(SPEC) == pytest.approx(cold.te_adjusted)
    assert hot.te_adjusted == pytest.approx(SPEC * 0.84)


def test_power_zero_or_negative(spark):
    assert [r.te_base for r in te(spark, *[("Pro", 234.0, p, 0.38, "Normal", 20.0) for p in (0.0, -5.0)])] == [0, 0]


def test_half_hashrate_and_models(spark):
    rows = te(
        spark, ("Pro", 117.0, 3510.0, 0.38, "Normal", 20.0),
        *[(m, 100.0, 3000.0, 0.4, "Normal", 20.0) for m in ("Pro", "M56S", "M63", "XP", "Antminer S19 XP")])
    assert rows[0].te_health < 0.6 * rows[0].te_adjusted
    assert [r.voltage_default_v for r in rows[1:]] == [0.38, 0.40, 0.36, 0.42, 0.42]


def test_unknown_model_has_no_realization(spark):
    row, = te(spark, ("Other", 100.0, 3000.0, 0.4, "Normal", 20.0))
    assert row.hashrate_realization == 0 and row.hashrate_nameplate_th is None


def test_missing_reading_stays_missing(spark):
    from fleetlens.operators.clean import clamp_bounds
    row = clamp_bounds(spark.createDataFrame([(None, 999.0)], "temperature_c double, power_w double")).first()
    assert row.temperature_c is None and row.power_w == 999.0


def test_ensemble_without_error_is_the_classifier_score(spark):
    from fleetlens.functions.scores import ensemble_score
    df = spark.createDataFrame([(0.4, None), (0.4, 0.9)], "p double, e double")
    a, b = [r.s for r in df.select(ensemble_score(F.col("p"), F.col("e"), 0.3).alias("s")).collect()]
    assert a == 0.4 and b == pytest.approx(0.65 * 0.4 + 0.35 * 1.0)
