import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.operators import labels, scores, splits


def long(spark, rows):
    return spark.createDataFrame(rows, "ID string, Label int, ord int")


def test_duplicate_rules(spark):
    rows = [("ID_a_any", None, 0), ("ID_a_any", 1, 1), ("ID_a_any", 0, 2), ("ID_a_subdural", 1, 3), ("ID_b_any", 1, 4)]
    def at(keep):
        return {r["image_id"]: r for r in labels.labels_wide(long(spark, rows), keep).collect()}
    assert at("first")["ID_a"]["any"] == 0 and at("first")["ID_a"]["epidural"] == 0
    assert at("first_non_null")["ID_a"]["any"] == 1 and at("first_non_null")["ID_a"]["epidural"] is None
    assert at("last")["ID_a"]["any"] == 0 and at("last")["ID_b"]["subdural"] is None
    only_b = labels.labels_wide(long(spark, rows), available=spark.createDataFrame([("ID_b",)], "image_id string"))
    assert [r["image_id"] for r in only_b.collect()] == ["ID_b"]


def test_study_labels(spark):
    rows = [("s1", 0, 1, 0, 0, 1, 1), ("s1", 0, 0, 0, 0, 0, 0), ("s2", 0, 0, 0, 0, 0, 0), ("s3", None, None, None, None, None, None),
            ("s4", 0, 0, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "study_uid string, " + ", ".join(f"`{c}` int" for c in K.CLASSES))
    got = {r["study_uid"]: r for r in labels.study_labels(df, labelled=F.col("any").isNotNull()).collect()}
    assert got["s1"]["dominant_class"] == "subdural" and got["s1"]["n_labelled"] == 2
    assert got["s2"]["dominant_class"] == "" and not got["s2"]["study_positive"]
    assert got["s3"]["n_labelled"] == 0 and got["s3"]["any"] == 0
    assert got["s4"]["study_positive"] and got["s4"]["dominant_class"] == ""


def greedy(rows):
    got, used = {}, set()
    for r in rows:
        if r["name"] in used:
            continue
        for cls, code in K.VOTE_CODES.items():
            if cls not in got and sum(int(r[f"{x}:{code}"] or 0) for x in K.READERS) >= 2:
                got[cls] = r["name"]
                used.add(r["name"])
                break
    return got


@pytest.mark.parametrize("seed", range(6))
def test_greedy_votes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        row = {"ord": i, "name": f"n{rng.randrange(12)}"}
        for code in (*K.VOTE_CODES.values(), K.ANY_CODE):
            hit = rng.random() < 0.12
            for reader in K.READERS:
                row[f"{reader}:{code}"] = "1" if hit and rng.random() < 0.9 else rng.choice(["0", "", None])
        rows.append(row)
    df = spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows],
                               "ord long, name string, " + ", ".join(f"`{k}` string" for k in list(rows[0])[2:]))
    assert {r["class"]: r["name"] for r in labels.votes_greedy(df).collect()} == greedy(rows)
    clean, seen = [], set()
    for r in rows:
        if r["name"] not in seen and all(int(r[f"{x}:{K.ANY_CODE}"] or 0) == 0 for x in K.READERS):
            clean.append(r["name"])
            seen.add(r["name"])
    assert [r["name"] for r in labels.votes_negative(df, 4).orderBy("ord").collect()] == clean[:4]


def wide(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"ID_{i:04d}", *[int(rng.random() < 0.15) for _ in K.CLASSES]) for i in range(n)]
    return spark.createDataFrame(rows, "image_id string, " + ", ".join(f"`{c}` int" for c in K.CLASSES))


def test_split_two_strata(spark):
    w = wide(spark)
    got = splits.split_two(w, 0.2).collect()
    assert len(got) == 400 and len({r["image_id"] for r in got}) == 400
    groups = {}
    for r in got:
        groups.setdefault(r["signature"], []).append(r["split"])
    for members in groups.values():
        n_val = members.count("val")
        assert n_val == (max(1, round(len(members) * 0.2)) if len(members) >= 2 else 0)
    again = splits.split_two(w.repartition(7), 0.2).collect()
    assert {(r[0], r["split"]) for r in got} == {(r[0], r["split"]) for r in again}


@pytest.mark.parametrize("n_test", [0, 1, 37, 60, 200])
def test_split_three_sizes(spark, n_test):
    got = splits.split_three(wide(spark), n_test).collect()
    assert len(got) == 400 == len({r["image_id"] for r in got})
    assert sum(r["split"] == "test" for r in got) == n_test
    assert {"train", "val"} <= {r["split"] for r in got}


def test_weighted_draws_balance(spark):
    w = wide(spark, 600, 2)
    got = splits.weighted_draws(w)
    assert got.count() == 600
    share = got.agg(F.avg("any")).first()[0]
    assert 0.4 < share < 0.6
    assert got.join(w, "image_id", "left_anti").count() == 0
    truth = {r["image_id"]: r["any"] for r in w.collect()}
    assert all(truth[r["image_id"]] == r["any"] for r in got.collect())


@pytest.mark.parametrize("k", [1, 3, 7, 30])
def test_even_subsample(spark, k):
    sizes = [1, 2, 3, 7, 8, 29, 30, 31, 64, 97, 110]
    rows = [(n, i) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int")
    got = {}
    for r in splits.even_subsample(df, k, ["g"], ["i"], ranges=5).collect():
        got.setdefault(r["g"], set()).add(r["i"])
    for n in sizes:
        want = {int(i * (n / k)) for i in range(k)} if n > k else set(range(n))
        assert got[n] == want, n
    assert splits.even_subsample(df, 0, ["g"], ["i"]).count() == len(rows)


def test_even_grid_inverts_for_all_sizes(spark):
    df = spark.range(1, 260).select(F.col("id").alias("n")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for k in (7, 30, 49):
        got = {}
        for r in df.filter(splits._on_even_grid(F.col("pos"), F.col("n"), k)).collect():
            got.setdefault(r["n"], set()).add(r["pos"])
        for n in range(k + 1, 260):
            assert got[n] == {int(i * (n / k)) for i in range(k)}


def test_spaced_picks(spark):
    sizes = [1, 4, 6, 10, 33, 120]
    df = spark.createDataFrame([(str(n), i, float(i)) for n in sizes for i in range(n)], "study_uid string, slice_index long, z_mm double")
    for k in (1, 6):
        got = {}
        for r in splits.spaced_picks(df, k).collect():
            got.setdefault(int(r["study_uid"]), {})[r["pick"]] = r["slice_index"]
        for n in sizes:
            assert [got[n][i] for i in range(k)] == list(np.linspace(n // 5, 4 * n // 5, k, dtype=int))


def test_cohort(spark):
    rows = [("a", "subdural", True, 9), ("b", "subdural", True, 30), ("c", "epidural", True, 25), ("d", "", True, 40),
            ("e", "subdural", True, 29), ("f", "", False, 22), ("g", "", False, 33), ("h", "", False, 3)]
    df = spark.createDataFrame([(u, c, p, n, n) for u, c, p, n in rows],
                               "study_uid string, dominant_class string, study_positive boolean, n_slices long, n_labelled long")
    def pick(n_pos):
        got = splits.cohort(df, n_pos, 1).collect()
        return {r["study_uid"] for r in got if r["group"] == "positive"}, {r["study_uid"] for r in got if r["group"] == "negative"}
    assert pick(3) == ({"b", "c", "d"}, {"g"})
    assert pick(1) == ({"b"}, {"g"})
    assert pick(9) == ({"b", "c", "d", "e"}, {"g"})


def slices(spark, rows):
    return spark.createDataFrame(rows, "study_uid string, z_mm double, path string, " + ", ".join(f"p_{c} double" for c in K.CLASSES))


def test_study_scores(spark):
    got = {r["study_uid"]: r for r in scores.study_scores(slices(spark, [
        ("tie", 1.0, "a", 0.70001, 0.70004, 0.1, 0.1, 0.1, 0.9),
        ("below", 1.0, "a", 0.1, 0.1, 0.1, 0.1, 0.1, 0.49999),
        ("alone", 1.0, "a", 0.1, 0.1, 0.1, 0.1, 0.1, 0.5),
        ("odd", 1.0, "a", 0.1, 0.1, 0.1, 0.1, 0.8, 0.4)])).collect()}
    assert got["tie"]["dominant_key"] == "epidural"  # equal once rounded
    assert got["below"]["prob_any"] == 0.5 and not got["below"]["overall_positive"]
    assert got["alone"]["dominant_class"] == K.UNDETERMINED
    assert got["odd"]["dominant_class"] == "subdural hematoma" and not got["odd"]["overall_positive"]


def test_slice_index_and_hot_slices(spark):
    low = [0.1] * 5
    rows = [("s", z, f"f{i}", *low, p) for i, (z, p) in enumerate([(5.0, 0.6), (None, 0.9), (7.0, 0.7), (5.0, 0.8), (-1.0, 0.2)])]
    rows.append(("s", 9.0, "f9", 0.95, 0.1, 0.1, 0.1, 0.1, 0.9))
    indexed = scores.slice_index(slices(spark, rows))
    order = {r["path"]: r["slice_index"] for r in indexed.collect()}
    assert order == {"f9": 0, "f2": 1, "f0": 2, "f3": 3, "f1": 4, "f4": 5}
    hot = {r["slice_index"]: (r["dominant_class"], r["prob"]) for r in scores.hot_slices(indexed).collect()}
    assert hot == {0: ("epidural", 0.95), 4: ("any", 0.9), 3: ("any", 0.8)}


def test_slice_index_of_unreadable_positions(spark):
    df = spark.createDataFrame([("s", 0.0, "a", True), ("s", 1.5, "b", False), ("s", 0.0, "c", True)],
                               "study_uid string, z_mm double, path string, bad boolean")
    got = {r["path"]: r["slice_index"] for r in scores.slice_index(df, read_error="bad").collect()}
    assert got == {"c": 0, "b": 1, "a": 2}


def test_hot_study_is_split(spark):
    rng = random.Random(3)
    rows = [("big" if i % 3 == 0 else f"s{i % 40}", float(rng.randrange(30)), f"f{i:05d}", *[0.2] * 6) for i in range(900)]
    a = scores.slice_index(slices(spark, rows)).collect()
    b = scores.slice_index(slices(spark, rows), ranges=5).collect()
    assert {(r["path"], r["slice_index"]) for r in a} == {(r["path"], r["slice_index"]) for r in b}


def test_find_slice(spark):
    df = spark.createDataFrame([("s", "u1", 0, "p1"), ("s", "u2", 1, "p2"), ("s", "", 2, "p3"), ("s", "", 3, "p4")], "study_uid string, sop_uid string, file_index int, path string")
    asked = spark.createDataFrame([("s", "u2", 0), ("s", "zz", 1), ("s", "zz", 9), ("s", "", 0)], "study_uid string, sop_uid string, slice_index int")
    assert {(r["sop_uid"], r["slice_index"]): r["path"] for r in scores.find_slice(asked, df).collect()} == {
        ("u2", 0): "p2", ("zz", 1): "p2", ("zz", 9): None, ("", 0): "p1"}
