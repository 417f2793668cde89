import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.functions import numeric as N
from slicewise.functions import pixels as P
from slicewise.functions import text as T
from slicewise import constants as K


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("Medical Ward", "ER"), ("General Surgery", "ER"), ("neuro icu 2", "Neurology"), (" Neuro ICU ", "Neuro ICU"),
    ("", "Unknown"), (None, "Unknown"), ("   ", ""), ("o'neil annex 3rd", "O'Neil Annex 3Rd"), ("MED/SURG", "Med/Surg"),
    ("ambulatory", "Outpatient"), ("main\tlot", "Main\tLot"),
])
def test_location(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw_department string")
    assert T.with_location(df).first()["location"] == want
    assert df.select(T.location(F.col("raw_department")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("path, want", [
    ("a/ID_00ff.dcm", "ID_00ff"), ("1.2.840.77.dcm", "ID_77"), ("ct-5-abc.dcm", "ID_abc"), ("im_9.dcm", "ID_9"),
    ("x.y_7.z!.dcm", "x_y_7_z_"), ("scan 1(x).dcm", "scan_1_x_"), ("dir.a/plain", "plain"),
])
def test_image_id(spark, path, want):
    assert one(spark, T.image_id(F.lit(path))) == want


@pytest.mark.parametrize("raw, want", [("20240230", "2024-02-30"), ("2024023", ""), ("2024023a", ""), (None, "")])
def test_compact_date(spark, raw, want):
    assert one(spark, T.compact_date(F.lit(raw).cast("string"))) == want


def test_compact_datetime(spark):
    def at(d, t):
        return one(spark, T.compact_datetime(F.lit(d), F.lit(t)))
    assert at("20240131", "235959.5") == "2024-01-31T23:59:59"
    assert at("20240131", "2359") == "2024-01-31"
    assert at("bad", "235959") == ""
    assert one(spark, T.calendar_date(F.lit("20240230"))) is None
    assert one(spark, T.calendar_date(F.lit("20240229"))) == dt.date(2024, 2, 29)


def test_numbers_scores_and_priors(spark):
    assert one(spark, T.number_or(F.lit(""), 99.0)) == 99.0
    assert one(spark, T.number_or(F.lit("x"), 99.0)) == 99.0
    assert one(spark, T.number_or(F.lit("5d"), 99.0)) == 99.0
    assert one(spark, T.number_or(F.lit(" 1.25 "), 99.0)) == 1.25
    assert one(spark, T.description_score(F.lit("AXIAL HEAD W/O"))) == 3
    assert one(spark, T.description_score(F.lit("CTA head 3D recon"))) == 1 - 6
    got = [one(spark, T.indication_prior(F.lit(t))) for t in (*K.CLASS_INDICATIONS.values(), "seizure")]
    assert got == [0.08, 0.10, 0.06, 0.05, 0.15, 0.02, 0.05]


def test_report_sections(spark):
    text = "ß intro report body paragraph:  Straße ok \nImpression bullet point: one\n"
    assert one(spark, T.report_section(F.lit(text), "body")) == "Straße ok"
    assert one(spark, T.report_section(F.lit(text), "bullet")) == "one"
    flipped = "IMPRESSION BULLET POINT: b REPORT BODY PARAGRAPH: a"
    assert one(spark, T.report_section(F.lit(flipped), "body")) == "a"
    assert one(spark, T.report_section(F.lit("none"), "body")) == ""


def test_display(spark):
    assert one(spark, T.fixed(F.lit(62.5), 0)) == "62"
    assert one(spark, T.fixed(F.lit(None).cast("double"), 2)) is None
    assert one(spark, T.percent(F.lit(0.1234))) == "12.3%"
    assert one(spark, T.signed_mm(F.lit(12.5))) == "+12.5 mm"
    assert one(spark, T.signed_mm(F.lit(-3.0))) == "-3.0 mm"
    assert one(spark, T.clock(F.lit(3725.9))) == "1:02:05"
    assert one(spark, T.prevalence_text(F.lit(None).cast("double"), 10)) == "<10 studies"
    assert one(spark, T.trailing_number(F.lit("CASE-CT-42"))) == 42


def test_half_precision(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.random(3000), 2.0 ** -rng.uniform(0, 26, 3000), [0.0, 1.0, 0.5, 2.0**-14, 2.0**-24, 3e-8]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", N.half(F.col("v")).alias("h"))
    for r in df.collect():
        assert r["h"] == float(np.float16(r["v"])), r


def test_windows(spark):
    def at(v, name):
        return one(spark, P.window(F.array(F.lit(v)), *K.WINDOWS[name]))[0]
    assert at(65.0, "medium") == pytest.approx(0.6625)
    assert at(37.0, "medium") == pytest.approx(0.5925)
    assert at(65.0, "narrow") == pytest.approx(0.405, abs=5e-4)
    assert at(85.0, "narrow") == pytest.approx(0.881, abs=5e-4)
    assert at(37.0, "narrow") == 0.0


@pytest.mark.parametrize("hu, bits, shape, want", [
    ([-100.0, 50.0, 60.0, 900.0], 16, (2, 2), None), ([201.0, 300.0, 900.0, 2000.0], 16, (2, 2), "all_above_200"),
    ([0.0, 400.0, 1.0, 2.0], 16, (2, 2), "unconverted_range"), ([0.0, 5000.0, 1.0, 2.0], 16, (2, 2), "intercept_not_applied"),
    ([-5.0, -1.0, -2.0, -3.0], 16, (2, 2), "no_tissue"), ([-5.0, 90.0, 1.0, 2.0], 12, (2, 2), "unsupported_bits"),
    ([-5.0, 90.0, 1.0], 16, (2, 2), "not_two_dimensional"), ([-5.0, 0.0, 1.0, 4500.0], 32, (4, 1), None),
])
def test_reject_rule(spark, hu, bits, shape, want):
    rule = P.reject_rule(F.array(*[F.lit(v) for v in hu]), F.lit(bits), F.lit(shape[0]), F.lit(shape[1]))
    assert one(spark, rule) == want


def test_to_hu(spark):
    def at(kind, slope, intercept):
        return one(spark, P.to_hu(F.array(F.lit(10.0)), F.lit(kind), F.lit(slope).cast("double"), F.lit(intercept).cast("double")))[0]
    assert at("int16", 2.0, None) == 20.0
    assert at("uint16", None, -100.0) == -90.0
    assert at("uint16", None, None) == -1014.0
    assert at("float32", None, None) == 10.0
    assert at("int16", None, None) == 10.0


def test_decimals_equal_python(spark):
    """Fixed decimals and rounded values follow the exact binary value, halves to even."""
    values = [i / 10_000 for i in range(10_001)] + [i / 128 for i in range(-300, 300)] + [0.35, 2.125, 12345678.125, -0.04, 1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    out = rows.select("v", N.decimals(F.col("v") * 100, 1).alias("p"), N.decimals(F.col("v"), 2).alias("d"), N.decimals(F.col("v"), 0).alias("w"),
                      N.round_even(F.col("v"), 2).alias("r2"), N.round_even(F.col("v"), 6).alias("r6")).collect()
    for r in out:
        assert (r.p, r.d, r.w) == (f"{r.v * 100:.1f}", f"{r.v:.2f}", f"{r.v:.0f}"), r.v
        assert (r.r2, r.r6) == (round(r.v, 2), round(r.v, 6)), r.v
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert [r.d for r in odd.select(N.decimals(F.col("v"), 2).alias("d")).collect()] == ["inf", "-inf", "nan", None]


def test_a_lone_five_beyond_the_last_place(spark):
    """0.0005 lies above its decimal half, 5e-07 below: both follow the binary value."""
    cases = [(sign * float(f"5e-{d + 1}"), d) for d in range(8) for sign in (1, -1)]
    for v, d in cases:
        shown, rounded = (one(spark, f(F.lit(v), d)) for f in (N.decimals, N.round_even))
        assert shown == f"{v:.{d}f}" and rounded == float(f"{v:.{d}f}")
