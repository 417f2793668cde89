"""The ordered scans: hot groups must give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from slicewise.functions.numeric import score_bucket
from slicewise.operators.ordered import scan, scan_by_bucket


def rows(seed=3, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.4 else None if rng.random() < 0.05 else f"g{rng.randrange(60)}"
        out.append((group, rng.randrange(50), i, rng.randrange(-5, 9)))
    return out


def brute(data):
    want = {}
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    for g, members in groups.items():
        members.sort(key=lambda r: (-r[1], r[2]))
        total, top = 0, None
        for pos, r in enumerate(members):
            total += r[3]
            want[r[2]] = (pos, len(members), total, top)
            top = r[3] if top is None else max(top, r[3])
    return want


@pytest.mark.parametrize("ranges", [None, 6, 40])
def test_scan_splits_hot_groups(spark, ranges):
    data = rows()
    df = spark.createDataFrame(data, "g string, a int, i int, v int").repartition(5)
    got = scan(df, ["g"], [F.desc("a"), F.col("i")], position="pos", size="n", sums={"s": F.col("v")},
               max_before={"m": F.col("v")}, ranges=ranges).collect()
    assert len(got) == len(data)
    assert {r["i"]: (r["pos"], r["n"], r["s"], r["m"]) for r in got} == brute(data)


def test_scan_without_keys(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 37) % 503)
    got = {r["k"]: r["pos"] for r in scan(df, [], [F.col("k")], position="pos", ranges=12).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_one_huge_group_with_equal_and_null_keys(spark):
    data = [(None, None if i % 3 == 0 else 7, i, 1) for i in range(700)]
    df = spark.createDataFrame(data, "g string, a int, i int, v int").repartition(4)
    got = {r["i"]: r["pos"] for r in scan(df, ["g"], [F.desc("a"), F.col("i")], position="pos", ranges=9).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, r[2]))
    assert got == {r[2]: k for k, r in enumerate(order)}


def test_no_job_while_the_plan_is_built(spark):
    df = spark.createDataFrame(rows(), "g string, a int, i int, v int")
    spark.sparkContext.setJobGroup("plan", "building a plan")
    scan(df, ["g"], [F.desc("a"), F.col("i")], position="pos")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)


def test_scan_by_bucket(spark):
    data = rows(8)
    df = spark.createDataFrame(data, "g string, a int, i int, v int")
    got = scan_by_bucket(df, ["g"], -F.floor(F.col("a") / 7), [F.desc("a"), F.col("i")],
                         position="pos", size="n", sums={"s": F.col("v")}).collect()
    assert {r["i"]: (r["pos"], r["n"], r["s"]) for r in got} == {k: v[:3] for k, v in brute(data).items()}


def test_score_bucket_never_decreases(spark):
    rng = random.Random(1)
    values = sorted([0.0, 1.0, 0.5, 0.25, 0.125, 1e-30, 1e-45, 5e-324, 1 - 2**-53, 0.49999999999999994]
                    + [rng.random() for _ in range(2000)] + [2.0 ** -rng.uniform(0, 80) for _ in range(2000)]
                    + [1 - 2.0 ** -rng.uniform(0, 52) for _ in range(2000)])
    df = spark.createDataFrame([(v,) for v in values], "p double").select("p", score_bucket(F.col("p")).alias("b"))
    got = [r["b"] for r in sorted(df.collect(), key=lambda r: r["p"])]
    assert got == sorted(got)
    assert 0 <= got[0] and got[-1] <= 300 * 1024
