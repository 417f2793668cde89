"""Model evaluation: ROC, AUC, thresholds, rates, log loss, focal loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import numeric as N
from slicewise.operators.ordered import scan, scan_by_bucket

INF = float("inf")


def finite_rows(scored: DataFrame, classes: list[str] = K.CLASSES) -> DataFrame:
    """Drop every row with a non-finite score in any class."""
    return scored.filter(N.all_finite([F.col(f"p_{c}") for c in classes]))


def long_scores(scored: DataFrame, classes: list[str] = K.CLASSES) -> DataFrame:
    """Wide scores and labels -> (class, p, y)."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p"),
                              F.col(f"y_{c}").cast("int").alias("y")) for c in classes])
    return scored.select(F.explode(rows).alias("r")).select("r.*")


def score_points(long: DataFrame) -> DataFrame:
    """Positives and negatives per class and distinct score: the map side does most of the work."""
    return long.groupBy("class", "p").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"))


def roc_curve(long: DataFrame) -> DataFrame:
    """One point per class and distinct score, highest score first.

    tp / fp count the rows at or above the score; tied scores share a point.
    """
    return roc_of_points(score_points(long))


def roc_of_points(points: DataFrame) -> DataFrame:
    bucket = F.coalesce(-N.score_bucket(F.col("p")), F.lit(1))
    running = scan_by_bucket(points, ["class"], bucket, [F.desc("p")],
                             sums={"tp": F.col("pos"), "fp": F.col("neg")}, totals_of={"n_pos": "tp", "n_neg": "fp"})
    return running.select("class", F.col("p").alias("threshold"), "pos", "neg", "tp", "fp", "n_pos", "n_neg",
                          F.try_divide("tp", "n_pos").alias("tpr"), F.try_divide("fp", "n_neg").alias("fpr"))


def _operating_points(roc: DataFrame) -> DataFrame:
    """AUC and the confusion counts at the Youden threshold, per class."""
    gain = F.col("tpr") - F.col("fpr")
    before = F.col("tp") - F.col("pos")
    # Each score's negatives lose to the positives above and share with those tied.
    credit = F.col("neg") * (before + F.col("pos") / 2)
    best = F.max_by(F.struct("threshold", "tp", "fp", gain.alias("j")), F.struct(gain, "threshold"))
    return (roc.groupBy("class")
            .agg(F.sum(credit).alias("credit"), best.alias("b"),
                 F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
            .withColumn("none", ~(F.col("b.j") > 0))
            .select("class", "n_pos", "n_neg",
                    F.try_divide(F.col("credit"), F.col("n_pos") * F.col("n_neg").cast("double")).alias("auc"),
                    F.when(F.col("none"), F.lit(INF)).otherwise(F.col("b.threshold")).alias("threshold"),
                    F.when(F.col("none"), F.lit(0)).otherwise(F.col("b.tp")).alias("tp"),
                    F.when(F.col("none"), F.lit(0)).otherwise(F.col("b.fp")).alias("fp")))


def class_metrics(long: DataFrame, style: str = "evaluation") -> DataFrame:
    """AUC, Youden threshold and rates per class.

    A threshold of +inf (the curve never rises above the diagonal) means no
    positive call. A class with only one label value is left out in
    ``evaluation`` style and gets the default metrics in ``training`` style.
    """
    return metrics_of_points(score_points(long), style)


def metrics_of_points(points: DataFrame, style: str = "evaluation") -> DataFrame:
    ops = _operating_points(roc_of_points(points))
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    r = N.rates(tp, fp, fn, tn, style)
    n = F.col("n_pos") + F.col("n_neg")
    share, auc, thr = F.col("n_pos") / n, F.col("auc"), F.col("threshold")
    if style == "evaluation":
        share, auc, thr = F.round(share, 6), F.round(auc, 6), F.when(thr == INF, thr).otherwise(F.round(thr, 6))
        ops = ops.filter(~single)
    else:
        # sensitivity, specificity, ppv, npv, lr+, lr-, prevalence, threshold
        defaults = {"sensitivity": 0.0, "specificity": 0.0, "ppv": 0.0, "npv": 0.0,
                    "lr_positive": 1.0, "lr_negative": 1.0}
        r = {k: F.when(single, F.lit(defaults[k])).otherwise(v) for k, v in r.items()}
        share = F.when(single, F.lit(0.0)).otherwise(share)
        auc = F.when(single, F.lit(0.5)).otherwise(auc)
        thr = F.when(single, F.lit(0.5)).otherwise(thr)
    return ops.select("class", auc.alias("auc"), share.alias("prevalence"),
                      *[c.alias(k) for k, c in r.items()], thr.alias("threshold"),
                      F.col("n_pos").alias("n_positive"), n.alias("n_total"))


def mean_auc(metrics: DataFrame) -> DataFrame:
    """Macro mean of the class AUCs, NaN skipped; 0 when there is none."""
    usable = F.when(~F.isnan("auc"), F.col("auc"))
    return metrics.agg(F.coalesce(F.avg(usable), F.lit(0.0)).alias("mean_auc"),
                       F.count(usable).alias("n_classes"))


def confusion(long: DataFrame, threshold: float = K.POSITIVE_AT) -> DataFrame:
    """tp, fp, fn, tn per class at a fixed threshold (at or above is positive)."""
    call, pos = F.col("p") >= threshold, F.col("y") == 1
    return long.groupBy("class").agg(
        F.count_if(call & pos).alias("tp"), F.count_if(call & ~pos).alias("fp"),
        F.count_if(~call & pos).alias("fn"), F.count_if(~call & ~pos).alias("tn"))


def _per_class_mean(scored: DataFrame, term, name: str) -> DataFrame:
    """Mean of a per-row term for every class: one pass, one row, then unpivot."""
    wide = scored.agg(*[F.avg(term(i, c)).alias(c) for i, c in enumerate(K.CLASSES)])
    return wide.unpivot([], K.CLASSES, "class", name)


def log_loss(scored: DataFrame, weights: list[float] = K.LOSS_WEIGHTS, eps: float = 1e-15) -> DataFrame:
    """Log loss per class plus the weighted mean (class ``weighted``). No rows: null."""
    def term(i: int, c: str) -> Column:
        p = N.clip(F.col(f"p_{c}"), eps, 1 - eps)
        y = F.col(f"y_{c}").cast("double")
        return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))

    return _with_weighted_mean(_per_class_mean(finite_rows(scored), term, "loss"), weights)


def loss_of_points(points: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Log loss per class from the counts per distinct score."""
    p = N.clip(F.col("p"), eps, 1 - eps)
    term = F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)
    return points.groupBy("class").agg((-F.sum(term) / F.sum(F.col("pos") + F.col("neg"))).alias("loss"))


def class_weight(weights: list[float] = K.LOSS_WEIGHTS) -> Column:
    return F.coalesce(*[F.when(F.col("class") == c, F.lit(v)) for c, v in zip(K.CLASSES, weights)])


def _with_weighted_mean(per_class: DataFrame, weights: list[float]) -> DataFrame:
    rolled = per_class.withColumn("w", class_weight(weights)).rollup("class").agg(
        F.grouping("class").alias("g"), (F.sum(F.col("loss") * F.col("w")) / F.sum("w")).alias("loss"))
    return rolled.select(F.when(F.col("g") == 1, "weighted").otherwise(F.col("class")).alias("class"), "loss")


def focal_loss(logits: DataFrame, alpha: dict[str, float] | None = None, gamma: float = 2.0,
               smoothing: float = 0.0, reduction: str = "mean") -> DataFrame:
    """Focal loss from logits (``x_<class>``, ``y_<class>``); one row, or one per input row for ``none``."""
    def term(c: str) -> Column:
        x, t = F.col(f"x_{c}"), F.col(f"y_{c}").cast("double")
        if smoothing > 0:
            t = t * (1 - smoothing) + 0.5 * smoothing
        bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
        p = N.sigmoid(x)
        focus = F.pow(1 - (p * t + (1 - p) * (1 - t)), F.lit(gamma))
        if alpha is not None:
            a = alpha[c]
            focus = focus * (a * t + (1 - a) * (1 - t))
        return focus * bce

    terms = {c: term(c) for c in K.CLASSES}
    if reduction == "none":
        return logits.select("*", *[v.alias(f"loss_{c}") for c, v in terms.items()])
    total = sum(list(terms.values())[1:], start=list(terms.values())[0])
    if reduction == "sum":
        return logits.agg(F.sum(total).alias("focal_loss"))
    return logits.agg((F.sum(total) / (F.count(F.lit(1)) * len(K.CLASSES))).alias("focal_loss"))


def class_balance(labels: DataFrame) -> DataFrame:
    """Positives, total, percent and alpha (share of negatives) per class."""
    rows = labels.agg(F.count(F.lit(1)).alias("n_total"),
                      *[F.sum(F.col(c).cast("bigint")).alias(c) for c in K.CLASSES])
    n, pos = F.col("n_total"), F.col("positives")
    return (rows.unpivot(["n_total"], K.CLASSES, "class", "positives")
            .select("class", "positives", "n_total",
                    F.round(F.try_divide(100 * pos, n), 2).alias("percent"),
                    F.round(F.try_divide(n - pos, n), 6).alias("alpha")))


def best_epochs(history: DataFrame, run: tuple[str, ...] = (), epoch: str = "epoch",
                metric: str = "mean_auc", **limits) -> DataFrame:
    """Flag every epoch whose metric beats all earlier ones (and zero)."""
    seen = scan(history, list(run), [F.col(epoch)], max_before={"_best": F.col(metric)}, **limits)
    best = F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))
    return (seen.withColumn("best_before", best).withColumn("is_best", F.col(metric) > best).drop("_best"))
