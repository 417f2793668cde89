"""Labels: long to wide, study roll-up, reader votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import text as T


def labels_wide(long: DataFrame, keep: str = "first", order: str = "ord",
                available: DataFrame | None = None, classes: list[str] = K.CLASSES) -> DataFrame:
    """(ID, Label) rows -> one row per image with a column per class.

    Duplicates of (image, class): ``first`` row wins and absent classes become 0;
    ``first_non_null`` label wins; ``last`` row wins (split at the right-most
    underscore). The class list is fixed, so no job looks for the pivot values.
    """
    if keep == "last":
        image, cls = F.regexp_extract("ID", r"^(.*)_[^_]*$", 1), T.label_tail(F.col("ID"))
        image = F.when(F.col("ID").contains("_"), image).otherwise(F.col("ID"))
    else:
        image, cls = T.label_image(F.col("ID")), T.label_class(F.col("ID"))
    rows = long.select(image.alias("image_id"), cls.alias("cls"), "Label", F.col(order).alias("_ord"))
    if available is not None:
        rows = rows.join(available.select("image_id"), "image_id", "left_semi")

    def one(c: str) -> Column:
        hit = F.col("cls") == c
        if keep == "first":
            return F.coalesce(F.min_by("Label", F.when(hit, F.col("_ord"))), F.lit(0))
        if keep == "first_non_null":
            return F.min_by("Label", F.when(hit & F.col("Label").isNotNull(), F.col("_ord")))
        return F.max_by("Label", F.when(hit, F.col("_ord")))

    return rows.groupBy("image_id").agg(*[one(c).alias(c) for c in classes])


def positive_ids(wide: DataFrame, cls: str = "any") -> DataFrame:
    return wide.filter(F.col(cls) == 1).select("image_id")


def restrict(df: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Keep the rows whose key is available."""
    return df.join(ids.select(key), key, "left_semi")


def pending(df: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Keep the rows whose key is not done yet."""
    return df.join(done.select(key), key, "left_anti")


def with_labels(images: DataFrame, wide: DataFrame, how: str = "inner") -> DataFrame:
    """Join the label vector onto images; ``left`` keeps unlabelled images."""
    return images.join(wide, "image_id", how)


def study_labels(slices: DataFrame, prefix: str = "", labelled: Column | None = None) -> DataFrame:
    """Label roll-up: highest label per class, counts, and the dominant class.

    The dominant class is the first positive subtype in a fixed order, blank
    when there is none.
    """
    labelled = labelled if labelled is not None else F.lit(True)
    top = slices.groupBy("study_uid").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.count_if(labelled).alias("n_labelled"),
        *[F.coalesce(F.max(prefix + c), F.lit(0)).cast("int").alias(c) for c in K.CLASSES])
    dominant = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in K.DOMINANT_ORDER], F.lit(""))
    return top.select("*", (F.col("any") == 1).alias("study_positive"), dominant.alias("dominant_class"))


def vote_count(code: str, readers: list[str] = K.READERS) -> Column:
    """Votes for a finding; blank counts as none."""
    votes = [F.coalesce(F.col(f"`{r}:{code}`").try_cast("int"), F.lit(0)) for r in readers]
    return sum(votes[1:], start=votes[0])


def votes_majority(reads: DataFrame) -> DataFrame:
    """Label per class where at least two readers agree; any = highest."""
    marks = [(vote_count(code) >= 2).cast("int").alias(cls) for cls, code in K.VOTE_CODES.items()]
    return reads.select("name", "ord", *marks).withColumn("any", F.greatest(*K.VOTE_CODES))


def votes_negative(reads: DataFrame, n: int) -> DataFrame:
    """The first ``n`` studies for which no reader saw any finding."""
    clean = reads.filter(" AND ".join(
        f"coalesce(try_cast(`{r}:{K.ANY_CODE}` AS INT), 0) = 0" for r in K.READERS))
    return clean.groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord").limit(n)


def votes_greedy(reads: DataFrame) -> DataFrame:
    """At most one study per class, picked in one pass over the rows in order.

    A row takes the first class it is majority-positive for that is still
    empty; a study name is used once. Rows with the same positive classes are
    interchangeable except for their order, and at most five rows are ever
    picked, so the five earliest names of each of the 31 class combinations
    decide the outcome. The scan over those at most 155 rows is one fold.
    """
    order = list(K.VOTE_CODES)
    marks = votes_majority(reads)
    bits = [F.shiftleft(F.col(c), i) for i, c in enumerate(order)]
    signature = sum(bits[1:], start=bits[0])
    names = (marks.withColumn("signature", signature).filter(F.col("signature") > 0)
             .groupBy("signature", "name").agg(F.min("ord").alias("ord")))
    rank = F.row_number().over(W.partitionBy("signature").orderBy("ord"))
    few = names.withColumn("rn", rank).filter(F.col("rn") <= len(order))
    rows = few.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "signature"))).alias("rows"))
    last = len(order) - 1
    picks = F.expr(f"""
        aggregate(rows, CAST(array() AS array<struct<cls:int,ord:bigint,name:string>>),
          (got, r) -> concat(got, transform(
            slice(filter(sequence(0, {last}), c -> getbit(r.signature, c) = 1
                    AND NOT exists(got, g -> g.cls = c)
                    AND NOT exists(got, g -> g.name = r.name)), 1, 1),
            c -> named_struct('cls', c, 'ord', r.ord, 'name', r.name))))
    """)
    names_array = F.array(*[F.lit(c) for c in order])
    return (rows.select(F.explode(picks).alias("p"))
            .select(F.get(names_array, F.col("p.cls")).alias("class"), F.col("p.name").alias("name"),
                    F.col("p.ord").alias("ord")))
