"""Splits, samples and cohort picks. Random order is md5(id, seed): reproducible on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import numeric as N
from slicewise.operators.ordered import scan, scan_by_bucket


def signature(classes: list[str] = K.CLASSES) -> Column:
    """The label bits as text, e.g. ``000011``."""
    return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in classes])


def _shuffled(df: DataFrame, keys: list[str], seed: int, position: str, size: str | None = None) -> DataFrame:
    """Position (and size) of each row in the md5 order of its group.

    The first four hex digits cut any group into 65,536 even parts.
    """
    keyed = df.withColumn("_md5", N.shuffle_key(F.col("image_id"), seed))
    return scan_by_bucket(keyed, keys, F.coalesce(F.substring("_md5", 1, 4), F.lit("")), [F.col("_md5"), F.col("image_id")],
                          position=position, size=size).drop("_md5")


def split_two(wide: DataFrame, val_split: float = 0.15, seed: int = 42) -> DataFrame:
    """Train / val per label signature: max(1, round(n * f)) to val, singletons to train."""
    placed = _shuffled(wide.withColumn("signature", signature()), ["signature"], seed, "_pos", "_n")
    n_val = F.when(F.col("_n") >= 2, F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(val_split)))).otherwise(0.0)
    return placed.select("image_id", "signature",
                         F.when(F.col("_pos") < n_val, "val").otherwise("train").alias("split"))


def split_three(wide: DataFrame, n_test: int, val_split: float = 0.15, seed: int = 42) -> DataFrame:
    """Test / train / val with exactly ``n_test`` test rows.

    Every signature gives its proportional share (never its last row), then the
    test set is trimmed or padded in md5 order; the rest goes through
    :func:`split_two`.
    """
    placed = _shuffled(wide.withColumn("signature", signature()), ["signature"], seed, "_pos", "_n")
    groups = wide.groupBy(signature().alias("signature")).agg(F.count(F.lit(1)).alias("_n"))
    total = groups.agg(F.sum("_n").alias("t"))
    fraction = F.lit(float(n_test)) / F.col("_total")
    take = F.greatest(F.lit(0.0), F.least(F.rint(F.col("_n") * fraction), F.col("_n") - 1.0))
    taken = (groups.withColumn("_total", total.select("t").scalar())
             .agg(F.sum(take).cast("bigint").alias("s")))
    marked = (placed.withColumn("_total", total.select("t").scalar())
              .withColumn("_take", F.col("_pos") < take).drop("_pos", "_n", "_total"))
    ranked = (_shuffled(marked, ["_take"], seed + 1, "_rank")
              .withColumn("_taken", taken.scalar()))
    test = F.when(F.col("_taken") >= n_test, F.col("_take") & (F.col("_rank") < n_test)).otherwise(
        F.col("_take") | (F.col("_rank") < n_test - F.col("_taken")))
    decided = ranked.select("image_id", *K.CLASSES, test.alias("_test"))
    rest = split_two(decided.filter(~F.col("_test")), val_split, seed)
    return (decided.filter("_test").select("image_id", signature().alias("signature"), F.lit("test").alias("split"))
            .unionByName(rest))


def first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids."""
    return ids.orderBy("image_id").limit(n)


def sample_ids(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` ids without replacement (all when there are fewer)."""
    return ids.orderBy(N.shuffle_key(F.col("image_id"), seed), "image_id").limit(n)


def _class_counts(wide: DataFrame, cls: str) -> Column:
    """Rows with label 1 and 0, as a struct that any row can read."""
    hit = F.col(cls) == 1
    return wide.agg(F.struct(F.count_if(hit).alias("n1"), F.count_if(~hit).alias("n0")).alias("c")).scalar()


def sample_weights(wide: DataFrame, cls: str = "any") -> DataFrame:
    """Weight 1 / (class count + 1) per row, balancing positives and negatives."""
    counted = wide.select("image_id", cls).withColumn("_c", _class_counts(wide, cls))
    count = F.when(F.col(cls) == 1, F.col("_c.n1")).otherwise(F.col("_c.n0"))
    return counted.select("image_id", cls, (1.0 / (count + 1)).alias("weight"))


def weighted_draws(wide: DataFrame, cls: str = "any", seed: int = 42) -> DataFrame:
    """As many draws with replacement as rows, by the weights of :func:`sample_weights`.

    A weight depends on the class alone, so a draw first picks the class by its
    total weight, then a row number inside it: an equi-join instead of a search
    in a running sum over all rows.
    """
    salted = str(seed)
    numbered = _shuffled(wide.select("image_id", cls), [cls], seed, "_pos")
    n1, n0 = F.col("_c.n1"), F.col("_c.n0")
    weight1, weight0 = n1 / (n1 + 1.0), n0 / (n0 + 1.0)
    pick_one = N.unit_draw(F.col("draw_id"), "c" + salted) * (weight0 + weight1) < weight1
    row = F.floor(N.unit_draw(F.col("draw_id"), "r" + salted) * F.when(F.col(cls) == 1, n1).otherwise(n0))
    draws = (wide.select(F.col("image_id").alias("draw_id")).withColumn("_c", _class_counts(wide, cls))
             .withColumn(cls, F.when(pick_one, 1).otherwise(0)).withColumn("_pos", row.cast("bigint")))
    return (draws.select("draw_id", cls, "_pos").join(numbered, [cls, "_pos"])
            .select("draw_id", "image_id", cls))


def _on_even_grid(pos: Column, n: Column, k: int) -> Column:
    """Is ``pos`` one of int(i * n / k), i = 0..k-1? Checked by inverting the formula."""
    step = n / F.lit(float(k))
    near = F.floor(pos / step).cast("bigint")

    def hit(i: Column) -> Column:
        return (i >= 0) & (i < k) & (F.floor(i * step) == pos)

    return hit(near - 1) | hit(near) | hit(near + 1)


def even_subsample(df: DataFrame, k: int, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """At most ``k`` evenly spaced rows per group; 0 keeps all."""
    placed = scan(df, group, [F.col(c) for c in order], position="position", size="_n", ranges=ranges)
    if k <= 0:
        return placed.drop("_n")
    keep = (F.col("_n") <= k) | _on_even_grid(F.col("position"), F.col("_n"), k)
    return placed.filter(keep).drop("_n")


def spaced_picks(indexed: DataFrame, k: int = 6) -> DataFrame:
    """``k`` slice numbers per study, evenly spaced from n/5 to 4n/5, truncated.

    Only the slice count is needed for the numbers; the slices come by equi-join.
    """
    n = F.col("n")
    counts = indexed.groupBy("study_uid").agg(F.count(F.lit(1)).alias("n"))
    start = F.floor(n / 5).cast("double")
    stop = F.floor(4 * n / 5).cast("double")
    step = (stop - start) / F.lit(float(max(k - 1, 1)))
    at = (F.when(F.col("pick") == k - 1, stop) if k > 1 else F.when(F.lit(False), stop)).otherwise(
        F.col("pick") * step + start)
    picks = (counts.select("study_uid", n, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pick"))
             .select("study_uid", "pick", F.floor(at).cast("bigint").alias("slice_index")))
    return picks.join(indexed.select("study_uid", "slice_index", "z_mm"), ["study_uid", "slice_index"])


def cohort(studies: DataFrame, n_pos: int, n_neg: int, min_labelled: int = 20) -> DataFrame:
    """Positive and negative studies for a demonstration cohort.

    Positives: the best-labelled study of every dominant class (in fixed class
    order), then the best-labelled of the rest, ``n_pos`` in all. Negatives: the
    best-labelled ``n_neg``. Ties go to the smaller uid. Both lists come out of
    bounded top-n steps.
    """
    able = studies.filter(F.col("n_labelled") >= min_labelled)
    pos = able.filter("study_positive").select("study_uid", "dominant_class", "n_slices", "n_labelled")
    neg = able.filter(~F.col("study_positive")).select("study_uid", "dominant_class", "n_slices", "n_labelled")
    class_rank = F.coalesce(*[F.when(F.col("dominant_class") == c, F.lit(i)) for i, c in enumerate(K.DOMINANT_ORDER)])
    best_first = F.struct((-F.col("n_labelled")).alias("a"), F.col("study_uid").alias("b"))
    leaders = (pos.filter(class_rank.isNotNull()).groupBy("dominant_class")
               .agg(F.min_by(F.struct("study_uid", "n_slices", "n_labelled"), best_first).alias("s"))
               .select("dominant_class", "s.*").withColumn("_tier", class_rank)
               .orderBy("_tier").limit(n_pos))
    # The top n_pos hold enough studies to fill every place the leaders leave.
    fill = (pos.orderBy(F.desc("n_labelled"), "study_uid").limit(n_pos)
            .withColumn("_tier", F.lit(len(K.DOMINANT_ORDER))))
    picked = (leaders.unionByName(fill).groupBy("study_uid", "dominant_class", "n_slices", "n_labelled")
              .agg(F.min("_tier").alias("_tier"))
              .orderBy("_tier", F.desc("n_labelled"), "study_uid").limit(n_pos))
    negatives = neg.orderBy(F.desc("n_labelled"), "study_uid").limit(n_neg)
    return (picked.drop("_tier").withColumn("group", F.lit("positive"))
            .unionByName(negatives.withColumn("group", F.lit("negative"))))
