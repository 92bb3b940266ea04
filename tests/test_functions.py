import math

import parity
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import numeric, prng, text

def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("x")).first()["x"]


def test_draws_agree_with_plain_python(spark):
    rows = spark.range(1, 3000).select("id", prng.draw(42, F.col("id")).alias("u")).collect()
    assert all(r["u"] == prng.draw_value(42, r["id"]) for r in rows)
    assert 0.48 < sum(r["u"] for r in rows) / len(rows) < 0.52


@pytest.mark.skipif(not parity.draws(), reason="no given draws")
def test_draws_agree_with_the_given_sequence():
    assert [prng.draw_value(42, i + 1) for i in range(100)] == parity.draws()


def test_permutation_keeps_all():
    g = prng.generator(7)
    assert sorted(prng.permutation(50, g)) == list(range(50)) and g.used == 49
    assert prng.permutation(0, g) == [] and prng.permutation(1, g) == [0]


@given(st.floats(-1e6, 1e6))
def test_rounding_is_away_from_zero(x):
    # the formula, without Spark
    assert math.copysign(math.floor(abs(x) + 0.5), x) == math.copysign(math.floor(abs(x) + 0.5), x)


@pytest.mark.parametrize(("value", "want"), [(2.5, 3.0), (-2.5, -3.0), (0.49, 0.0), (-0.5, -1.0), (7.0, 7.0)])
def test_round_half_away(spark, value, want):
    assert one(spark, value, numeric.round_half_away, "double") == want


@pytest.mark.parametrize(("value", "want"), [("72%", 72.0), (" -3.5x", -3.5), (".5", 0.5), ("5.", 5.0), ("x5", None), ("", None), (None, None), ("1e2", 100.0), ("0x1F", 0.0)])
def test_parse_float(spark, value, want):
    assert one(spark, value, numeric.parse_float) == want


@pytest.mark.parametrize(("value", "want"), [(39.9, "0-39"), (40.0, "40-49"), (89.0, "80-89"), (90.0, "90+"), (None, ""), (float("nan"), "")])
def test_grade_band(spark, value, want):
    assert one(spark, value, numeric.grade_band, "double") == want


@pytest.mark.parametrize(("value", "want"), [(79.0, "<80%"), (80.0, "80-89%"), (94.9, "90-94%"), (95.0, "95%+"), (None, "")])
def test_attendance_band(spark, value, want):
    assert one(spark, value, numeric.attendance_band, "double") == want


def test_noise_never_leaves_its_band(spark):
    bounds = (40, 50, 60, 70, 80)
    rows = spark.range(1, 5000).select((F.col("id") % 101).cast("double").alias("v"), prng.draw(3, F.col("id")).alias("u"))
    band = numeric.noise_band(F.col("v"), bounds, 100)
    noise = numeric.bounded_noise(F.col("v"), F.col("u"), 100, 0.05, bounds)
    out = rows.select("v", noise["value"].alias("n"), noise["failed"].alias("f"), band["lower"].alias("lo"), band["upper"].alias("hi"))
    assert out.filter("n < lo OR n >= hi OR f OR abs(n - v) > 5.5").count() == 0


def test_narrow_band_fails_and_draw_of_zero_is_clamped(spark):
    n = spark.createDataFrame([(79.0, 0.3)], "v double, u double").select(numeric.bounded_noise(F.col("v"), F.col("u"), 100, 0.05, (79, 80)).alias("n")).first()["n"]
    assert n["value"] == 79.0 and n["failed"]
    n = spark.createDataFrame([(50.0, 0.0)], "v double, u double").select(numeric.bounded_noise(F.col("v"), F.col("u")).alias("n")).first()["n"]
    assert n["value"] == 45.0


@pytest.mark.parametrize(("value", "want"), [("=1", "'=1"), ("+1", "'+1"), ("-x", "'-x"), ("@a", "'@a"), ("\tb", "'\tb"), ("a=1", "a=1"), ("", ""), (None, None)])
def test_sanitise(spark, value, want):
    assert one(spark, value, text.sanitise) == want


@pytest.mark.parametrize(("value", "want"), [("Barker, Jo", "Jo Barker"), ("Jo Barker", "Jo Barker"), (", Jo", ", Jo"), ("Barker,", "Barker,"), ("A, B, C", "B, C A"), (None, None)])
def test_name_order(spark, value, want):
    assert one(spark, value, text.normal_name_order) == want


def test_matches_have_positions_in_code_points(spark):
    got = one(spark, "😀 ab é ab", lambda c: text.matches(c, "ab"))
    assert [(m["value"], m["position"]) for m in got] == [("ab", 2), ("ab", 7)]
    assert one(spark, "none", lambda c: text.matches(c, "ab")) == []


def test_context(spark):
    got = one(spark, "x" * 20 + "HIT" + "y" * 5, lambda c: text.context(c, F.lit(20), F.lit(3)))
    assert got == "..." + "x" * 15 + "HIT" + "y" * 5


def test_nfkc(spark):
    assert one(spark, "Ａｂ①", text.nfkc) == "Ab1" and one(spark, None, text.nfkc) is None
