import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.operators import encodings, geometry, imaging, report, scores
from slicewise.functions import packed
from slicewise.functions import pixels as P


def blocks(spark, arrays):
    rows = [(f"ID_{i}", a.shape[0], a.shape[1], [float(v) for v in a.ravel()]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id string, h int, w int, image_norm array<double>")


def corner(a, size):
    """Corner-aligned bilinear interpolation, pixel by pixel."""
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            y, x = i * (a.shape[0] - 1) / (size - 1), j * (a.shape[1] - 1) / (size - 1)
            out[i, j] = sample(a, y, x)
    return out


def half_pixel(a, size):
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            y = max((i + 0.5) * a.shape[0] / size - 0.5, 0)
            x = max((j + 0.5) * a.shape[1] / size - 0.5, 0)
            out[i, j] = sample(a, y, x)
    return out


def sample(a, y, x):
    y0, x0 = min(int(y), a.shape[0] - 1), min(int(x), a.shape[1] - 1)
    y1, x1 = min(y0 + 1, a.shape[0] - 1), min(x0 + 1, a.shape[1] - 1)
    fy, fx = min(y - y0, 1), min(x - x0, 1)
    return (a[y0, x0] * (1 - fy) * (1 - fx) + a[y1, x0] * fy * (1 - fx) + a[y0, x1] * (1 - fy) * fx + a[y1, x1] * fy * fx)


@pytest.mark.parametrize("mode, rule", [("corner", corner), ("half_pixel", half_pixel)])
@pytest.mark.parametrize("size", [3, 8, 13])
def test_resize(spark, mode, rule, size):
    rng = np.random.default_rng(1)
    arrays = [rng.random((8, 8)), rng.random((5, 11)), rng.random((20, 7))]
    got = imaging.resize(blocks(spark, arrays), size, mode).orderBy("image_id").collect()
    for r, a in zip(got, arrays):
        assert (r["h"], r["w"]) == (size, size)
        np.testing.assert_allclose(np.reshape(r["image_norm"], (size, size)), rule(a, size), atol=1e-12)


def test_augment_is_repeatable_and_keeps_pixels(spark):
    rng = np.random.default_rng(2)
    df = blocks(spark, [rng.random((4, 6)) * 0.9 + 0.05 for _ in range(40)])
    a = {(r["image_id"], r["copy"]): r for r in imaging.augment(df, 3).collect()}
    b = {(r["image_id"], r["copy"]): r for r in imaging.augment(df.repartition(5), 3).collect()}
    assert len(a) == 120 and a == b
    assert {r["turns"] for r in a.values()} == {0, 1, 2, 3} and {r["flip"] for r in a.values()} == {True, False}
    for r in a.values():
        assert abs(r["shift"]) <= 0.04 and {r["h"], r["w"]} == {4, 6}
        assert (r["h"] == 6) == (r["turns"] % 2 == 1)
    plain = {r["image_id"]: r["image_norm"] for r in df.collect()}
    for (image, _), r in a.items():
        np.testing.assert_allclose(sorted(r["image_norm"]), sorted(np.clip(np.array(plain[image]) + r["shift"], 0, 1)), atol=1e-12)


def test_windows_agree_with_expressions(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([([float(np.float32(v)) for v in rng.uniform(-1200, 3500, 50)],) for _ in range(5)], "hu array<double>")
    got = imaging.windows_once(df, half=False).collect()
    want = df.select(*[P.window(F.col("hu"), *w).alias(n) for n, w in K.WINDOWS.items()]).collect()
    for g, e in zip(got, want):
        for n in K.WINDOWS:
            np.testing.assert_allclose(g[f"hu_{n}"], e[n], atol=1e-5)
            assert 0 <= min(g[f"hu_{n}"]) and max(g[f"hu_{n}"]) <= 1
    single = df.select(imaging.window_arrow(F.col("hu"), -200.0, 200.0).alias("x")).first()["x"]
    np.testing.assert_allclose(single, np.float16(want[0]["medium"]), atol=1e-3)


def test_encoding_statistics(spark):
    rng = random.Random(4)
    data = [[rng.choice([rng.uniform(-900, 900), rng.uniform(28, 42), rng.uniform(50, 80)]) for _ in range(120)] for _ in range(6)]
    data.append([30.0, 60.0, 30.5, 60.5])
    df = spark.createDataFrame([(d,) for d in data], "hu array<double>")
    usable = encodings.usable_blocks(df, min_pixels=3)
    assert usable.count() == 6
    counts = encodings.value_counts(usable)
    got = {(r["scheme"], r["tissue"]): r for r in encodings.encoding_stats(counts).collect()}
    overlap = {r["scheme"]: r["overlap"] for r in encodings.encoding_overlap(counts).collect()}
    for scheme, params in encodings.SCHEMES.items():
        values = {}
        for tissue, (lo, hi) in {"gray": K.GRAY_HU, "blood": K.BLOOD_HU}.items():
            out = []
            for d in data[:6]:
                a = np.array(d)
                e = (a - a.min()) / (a.max() - a.min()) if params is None else np.clip((a - params[0]) / (params[1] - params[0]), 0, 1)
                out.append(e[(a >= lo) & (a <= hi)].astype(np.float16).astype(np.float64))
            values[tissue] = v = np.concatenate(out)
            r = got[scheme, tissue]
            assert r["n_pixels"] == len(v)
            assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(), abs=1e-12)
            assert r["median"] == pytest.approx(np.median(v))
        lo, hi = min(v.min() for v in values.values()), max(v.max() for v in values.values())
        hist = [np.histogram(v, bins=np.linspace(lo, hi, 301))[0] / len(v) for v in values.values()]
        assert overlap[scheme] == pytest.approx(np.minimum(*hist).sum(), abs=0.03)
    wide = {r["scheme"]: r for r in encodings.tissue_separation(counts).collect()}
    assert wide["narrow"]["gray_std"] == 0.0 and wide["narrow"]["delta_mean"] > wide["medium"]["delta_mean"]


def test_equal_samples_overlap_fully(spark):
    counts = spark.createDataFrame([("x", "gray", 0.5, 3), ("x", "blood", 0.5, 2)], "scheme string, tissue string, value double, n long")
    assert encodings.encoding_overlap(counts).first()["overlap"] == 1.0


def test_guarded_reports_failures(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [])], "image_id string, values array<double>")

    def make():
        return lambda v: [v[0] * 2]

    got = {r["image_id"]: r for r in imaging.guarded(df, make, "values", result="out").collect()}
    assert got["a"]["out"] == [2.0] and got["a"]["status"] == "ok"
    assert got["b"]["out"] is None and got["b"]["status"] == "error" and "index" in got["b"]["message"]


def test_scoring(spark):
    rng = np.random.default_rng(5)
    weights, bias = rng.normal(size=(12, 6)), rng.normal(size=6)
    arrays = [rng.random((3, 4)) for _ in range(70)]
    got = scores.score_batches(blocks(spark, arrays), scores.linear_scorer(weights, bias), (3, 4), batch_size=16).collect()
    for r in got:
        a = arrays[int(r["image_id"][3:])]
        np.testing.assert_allclose([r[f"p_{c}"] for c in K.CLASSES], 1 / (1 + np.exp(-(a.ravel() @ weights + bias))))


def test_geometry(spark):
    rows = [("s", [0.0, 1.0, 9.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0.4, 0.5], 3.0, 1), ("s", [0.0, 0.0, 5.0], [0.0, 1.0, 0.0, -1.0, 0.0, 0.0], [0.7, 0.8], 3.0, 2),
            ("s", [0.0, 3.0, 7.5], None, None, None, 3), ("one", [1.0, 2.0, 3.0], None, None, None, 1), ("none", None, None, None, 2.0, 4)]
    df = spark.createDataFrame(rows, "study_uid string, image_position array<double>, image_orientation array<double>, "
                                     "pixel_spacing array<double>, slice_thickness double, instance_number int")
    got = {r["study_uid"]: np.reshape(r["affine"], (4, 4)) for r in geometry.series_affine(df, tie=("instance_number",)).collect()}
    np.testing.assert_allclose(got["s"], [[-0.7, 0, 0, 0], [0, 0.8, 3, 0], [0, 0, 2.5, 5], [0, 0, 0, 1]])
    np.testing.assert_allclose(got["one"], [[0, 1, 0, 1], [1, 0, 0, 2], [0, 0, 5, 3], [0, 0, 0, 1]])
    np.testing.assert_allclose(got["none"], [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]])


def test_report_items(spark):
    base = {"study_uid": "s", "slice_count": 30, "overall_positive": True, "dominant_key": "subdural", "dominant_class": "subdural hematoma",
            "ppv": 0.7432, "npv": 0.989, "prevalence": 0.145, "pain_index": 0.35, "tp": 136, "fn": 9, "fp": 47, "tn": 808,
            "lr_positive": 17.18, "lr_negative": 0.0635, "indication": "Fall", "first_hot": 3, "last_hot": 5}
    base |= {f"prob_{c}": 0.9 if c in ("subdural", "any") else 0.1 for c in K.CLASSES}
    base |= {f"positive_{c}": c in ("subdural", "any") for c in K.CLASSES}
    negative = base | {"study_uid": "n", "overall_positive": False, "dominant_class": "", "dominant_key": "", "first_hot": None, "last_hot": None}
    df = spark.createDataFrame([base, negative])
    hot = spark.createDataFrame([("s", [(3, 12.5, "1.2.3", "subdural", 0.9), (5, -2.0, "", "any", 0.875)])],
                                "study_uid string, hot_slices array<struct<slice_index:int,slice_z_mm:double,sop_uid:string,dominant_class:string,prob:double>>")
    items = report.report_items(df.join(hot, "study_uid", "left"), 0.94, 0.9453, 0.9864).orderBy("ord").collect()
    pos, neg = [r for r in items if r["study_uid"] == "s"], [r for r in items if r["study_uid"] == "n"]
    assert [r["section"] for r in pos] == ["method"] * 4 + ["finding"] * 7 + ["key_images"] * 4 + ["performance"] * 11 + ["disclaimer"]
    assert "key_images" not in {r["section"] for r in neg} and len(neg) == 23
    assert pos[4]["text"] == "POSITIVE — subdural hematoma" and neg[4]["text"] == "NEGATIVE"
    assert pos[12]["type"] == "IMAGE" and pos[12]["code"] == "1.2.3"
    assert pos[13]["text"] == "Slice 3 | z=+12.5 mm | Subdural hematoma | score 90.0%"
    assert pos[14]["text"] == "Slice 5 | z=-2.0 mm | Any intracranial hemorrhage | score 87.5%"
    table = next(r for r in pos if r["meaning"] == "Confusion Matrix")["text"]
    assert "  True ICH            136             9   (TP=136, FN=9)" in table
    assert [r["number"] for r in pos if r["type"] == "NUM"] == [0.94, 0.9453, 0.9864, 0.7432, 0.989]
    text = report.report_text(df, 0.94, 0.9453).collect()
    assert "POSITIVE for suspected subdural hematoma (model probability 90%; Sens 94%, Spec 95%; PPV 74.3% at 14% local prevalence)." in text[0]["paragraph"]
    assert "Most prominent finding at slice 4–6." in text[0]["paragraph"]
    assert text[1]["bullet"].startswith("• No ICH detected by AI screening (NPV 98.9% at 14% prevalence).")


def test_pixel_counts_leave_a_task_as_one_vector(spark):
    """Counts per half-precision code against a plain loop; rows into the shuffle are codes, not pixels."""
    import numpy as np

    from slicewise import constants as K
    from slicewise.operators import encodings

    rng = np.random.default_rng(3)
    blocks = [list(map(float, rng.uniform(-50, 120, 4000))) for _ in range(6)] + [[30.0] * 50, [], None, [None, 40.0, float("nan"), 70.0], [30.0, 30.5, 60.0]]
    frame = spark.createDataFrame([(b,) for b in blocks], "hu array<double>").repartition(2)
    want = {}
    for b in blocks:
        seen = [v for v in b or [] if v is not None and v == v]
        for v in seen:
            for tissue, (low, high) in encodings.TISSUES:
                if low <= v <= high:
                    for scheme, params in encodings.SCHEMES.items():
                        lo, hi = (min(seen), max(seen)) if params is None else params
                        if params is None and hi - lo < 1:
                            continue
                        key = (scheme, tissue, float(np.float16(min(1.0, max(0.0, (v - lo) / (hi - lo))))))
                        want[key] = want.get(key, 0) + 1
    counts = encodings.value_counts(frame)
    assert {(r.scheme, r.tissue, r.value): r.n for r in counts.collect()} == want
    assert "Explode" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert K.GRAY_HU[0] < K.BLOOD_HU[0]


def test_packing_round_trip(spark):
    every = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)
    every = every[np.isfinite(every)]  # all finite halves
    odd = [0.1, 1 / 3, 65519.9, 65520.0, -1e9, 2.0**-25, 3 * 2.0**-25, float("nan"), float("inf")]
    rows = [("all", every.tolist()), ("odd", odd), ("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "image_id string, image_norm array<double>")
    once = df.select("image_id", packed.pack(F.col("image_norm")).alias("b"))
    got = {r["image_id"]: r for r in once.select("*", packed.unpack(F.col("b")).alias("v"), packed.pack(packed.unpack(F.col("b"))).alias("again")).collect()}
    assert got["all"]["v"] == every.tolist() and len(got["all"]["b"]) == 2 * len(every)
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got["odd"]["v"], np.array(odd).astype(np.float16).astype(np.float32))
    assert got["none"]["b"] is None and got["none"]["v"] is None and got["empty"]["v"] == []
    assert all(r["again"] == r["b"] for r in got.values())


@pytest.mark.parametrize("mode", ["corner", "half_pixel"])
def test_packed_steps_equal_the_steps_on_arrays(spark, mode):
    rng = np.random.default_rng(5)
    exact = [rng.random(shape).astype(np.float16).astype(np.float64) for shape in ((8, 8), (5, 11), (20, 7), (1, 1))]
    df = blocks(spark, exact)
    tight = df.withColumn("image_half", packed.pack(F.col("image_norm"))).drop("image_norm")
    for plain, small in ((imaging.resize(df, 6, mode), imaging.resize(tight, 6, mode, "image_half")),
                         (imaging.augment(df, 3), imaging.augment(tight, 3, column="image_half"))):
        assert small.filter(~packed.fits(F.col("image_half"), F.col("h"), F.col("w"))).count() == 0
        key = lambda r: (r["image_id"], r["copy"] if "copy" in r else 0)
        want = {key(r): packed.to_bytes(r["image_norm"]) for r in map(lambda r: r.asDict(), plain.collect())}
        assert {key(r): bytes(r["image_half"]) for r in map(lambda r: r.asDict(), small.collect())} == want


def test_report_items_index_and_rank_the_slices_once(spark):
    """The hot range and the list of hot slices come from one pass."""
    from slicewise.plans import queries

    plan = queries.QUERIES["report_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 2
