import math
import random

import pytest
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions.numeric import rates
from slicewise.operators import bayes, evaluation

# class: positives of 200,000, sensitivity, specificity, PPV, NPV, LR+, LR-
PUBLISHED = {
    "any": (28989, 0.940012, 0.945273, 0.744352, 0.989357, 17.1762, 0.063461),
}


def long(spark, rows):
    return spark.createDataFrame(rows, "class string, p double, y int")


def brute(pairs):
    pos = [p for p, y in pairs if y]
    neg = [p for p, y in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    best, thr = 0.0, math.inf
    for t in sorted({p for p, _ in pairs}, reverse=True):
        j = sum(p >= t for p in pos) / len(pos) - sum(p >= t for p in neg) / len(neg)
        if j > best:
            best, thr = j, t
    return auc, thr


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = {c: [(round(rng.random() ** 2 if rng.random() < 0.6 else rng.random(), 2), int(rng.random() < 0.3)) for _ in range(200)]
            for c in ("a", "b")}
    got = {r["class"]: r for r in evaluation.class_metrics(
        long(spark, [(c, p, y) for c, v in data.items() for p, y in v]), style="training").collect()}
    for c, pairs in data.items():
        auc, thr = brute(pairs)
        assert got[c]["auc"] == pytest.approx(auc, abs=1e-12)
        assert got[c]["threshold"] == thr
        tp = sum(p >= thr and y for p, y in pairs)
        fp = sum(p >= thr and not y for p, y in pairs)
        assert got[c]["ppv"] == pytest.approx(tp / (tp + fp))


def test_symmetry(spark):
    rng = random.Random(6)
    rows = [("a", rng.random(), int(rng.random() < 0.4)) for _ in range(300)]
    auc = evaluation.class_metrics(long(spark, rows)).first()["auc"]
    flipped = evaluation.class_metrics(long(spark, [(c, 1 - p, y) for c, p, y in rows])).first()["auc"]
    assert auc + flipped == pytest.approx(1.0, abs=2e-6)


def test_no_gain_means_no_positive_call(spark):
    r = evaluation.class_metrics(long(spark, [("a", 0.1, 1), ("a", 0.9, 0), ("a", 0.8, 0)])).first()
    assert r["threshold"] == math.inf and r["sensitivity"] == 0.0 and r["specificity"] == 1.0
    assert r["lr_positive"] == math.inf


def test_perfect_class_has_infinite_ratio(spark):
    r = evaluation.class_metrics(long(spark, [("a", 0.9, 1), ("a", 0.1, 0)])).first()
    assert (r["auc"], r["threshold"], r["lr_positive"]) == (1.0, 0.9, math.inf)


def test_single_label_class(spark):
    rows = [("a", 0.9, 0), ("a", 0.1, 0), ("b", 0.9, 1), ("b", 0.1, 0)]
    assert [r["class"] for r in evaluation.class_metrics(long(spark, rows)).collect()] == ["b"]
    a = {r["class"]: r for r in evaluation.class_metrics(long(spark, rows), style="training").collect()}["a"]
    assert (a["auc"], a["ppv"], a["lr_positive"], a["threshold"]) == (0.5, 0.0, 1.0, 0.5)
    mean = evaluation.mean_auc(evaluation.class_metrics(long(spark, rows), style="training")).first()
    assert mean["mean_auc"] == 0.75


def test_published_rates_follow_from_counts(spark):
    for n_pos, sens, spec, ppv, npv, lrp, lrn in PUBLISHED.values():
        tp, tn = round(n_pos * sens), round((200_000 - n_pos) * spec)
        row = spark.createDataFrame([(tp, 200_000 - n_pos - tn, n_pos - tp, tn)], "tp long, fp long, fn long, tn long")
        got = row.select(*[c.alias(k) for k, c in rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items()]).first()
        assert got["ppv"] == pytest.approx(ppv, abs=2e-6) and got["npv"] == pytest.approx(npv, abs=2e-6)
        assert got["lr_positive"] == pytest.approx(lrp, abs=1e-3) and got["lr_negative"] == pytest.approx(lrn, abs=2e-6)


def wide(spark, rows):
    names = [f"p_{c}" for c in K.CLASSES] + [f"y_{c}" for c in K.CLASSES]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n[0] == 'p' else 'int'}" for n in names))


def test_finite_rows(spark):
    ok = [0.5] * 6 + [0] * 6
    bad = [[v] + ok[1:] for v in (float("nan"), float("inf"), float("-inf"), None)]
    assert evaluation.finite_rows(wide(spark, [ok, *bad])).count() == 1


def test_log_loss(spark):
    rng = random.Random(7)
    rows = [[rng.choice([0.0, 1.0, rng.random()]) for _ in range(6)] + [int(rng.random() < 0.5) for _ in range(6)] for _ in range(50)]
    got = {r["class"]: r["loss"] for r in evaluation.log_loss(wide(spark, rows)).collect()}
    want = []
    for k, c in enumerate(K.CLASSES):
        terms = []
        for r in rows:
            p = min(max(r[k], 1e-15), 1 - 1e-15)
            terms.append(-(r[6 + k] * math.log(p) + (1 - r[6 + k]) * math.log(1 - p)))
        want.append(sum(terms) / len(terms))
        assert got[c] == pytest.approx(want[-1])
    assert got["weighted"] == pytest.approx((sum(want) + want[-1]) / 7)
    points = evaluation.score_points(evaluation.long_scores(wide(spark, rows)))
    assert {r["class"]: pytest.approx(r["loss"]) for r in evaluation.loss_of_points(points).collect()} == {
        c: got[c] for c in K.CLASSES}


def test_focal_loss(spark):
    rng = random.Random(8)
    rows = [[rng.uniform(-40, 40) for _ in range(6)] + [int(rng.random() < 0.5) for _ in range(6)] for _ in range(20)]
    df = wide(spark, rows)
    df = df.select(*[F.col(f"p_{c}").alias(f"x_{c}") for c in K.CLASSES], *[f"y_{c}" for c in K.CLASSES])
    alpha = {c: 0.2 + k / 10 for k, c in enumerate(K.CLASSES)}
    total = 0.0
    for r in rows:
        for k, c in enumerate(K.CLASSES):
            t = r[6 + k] * 0.9 + 0.05
            p = 1 / (1 + math.exp(-r[k]))
            bce = max(r[k], 0) - r[k] * t + math.log1p(math.exp(-abs(r[k])))
            total += (1 - (p * t + (1 - p) * (1 - t))) ** 2 * (alpha[c] * t + (1 - alpha[c]) * (1 - t)) * bce
    mean = evaluation.focal_loss(df, alpha, smoothing=0.1).first()[0]
    assert mean == pytest.approx(total / (20 * 6))
    assert evaluation.focal_loss(df, alpha, smoothing=0.1, reduction="sum").first()[0] == pytest.approx(total)
    assert evaluation.focal_loss(df, reduction="none").count() == 20


@pytest.mark.parametrize("prevalence, counts", [
    (0.145, (136, 9, 47, 808)), (0.02, (19, 1, 54, 926)), (0.05, (47, 3, 52, 898)),
    (0.08, (75, 5, 50, 870)), (0.10, (94, 6, 49, 851)), (0.20, (188, 12, 44, 756))])
def test_counts_per_thousand(spark, prevalence, counts):
    r = bayes.metrics_at_prevalence(spark.range(1), F.lit(prevalence), 0.94, 0.9453).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == counts
    assert r["pain_index"] == round(counts[2] / counts[0], 2)


def test_no_positives(spark):
    r = bayes.metrics_at_prevalence(spark.range(1), F.lit(0.0), 0.94, 1.0).first()
    assert r["ppv"] == 0.0 and r["pain_index"] == math.inf


def test_best_epochs(spark):
    rows = [(e, v) for e, v in enumerate([0.0, 0.5, 0.4, 0.5, 0.7, 0.7, 0.9])]
    for limit in (1000, 3):
        got = evaluation.best_epochs(spark.createDataFrame(rows, "epoch int, mean_auc double"), ranges=limit)
        assert [r["is_best"] for r in got.orderBy("epoch").collect()] == [False, True, False, False, True, False, True]
