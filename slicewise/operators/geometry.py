"""Series geometry: slice direction and voxel-to-patient affine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _scaled(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x * s)


def _cross(a: Column, b: Column) -> Column:
    def at(v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))
    return F.array(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3)
                     for i in range(3)])


def series_affine(slices: DataFrame, group: str = "study_uid", tie: tuple[str, ...] = ("path",)) -> DataFrame:
    """The 4 x 4 affine (row-major, 16 doubles) of every series.

    Columns: column direction x row spacing, row direction x column spacing, the
    step from the first to the second slice origin in z order (the instance
    number stands in for an absent z), the first origin. With one slice, or an
    absent origin, the step is the plane normal times the thickness (default 5).
    Only the first two slices per series matter, so the rank limit runs before
    the shuffle.
    """
    pos = F.col("image_position")
    z = F.coalesce(F.get(pos, F.lit(2)), F.col("instance_number").cast("double"), F.lit(0.0))
    rank = F.row_number().over(W.partitionBy(group).orderBy(z, *[F.col(c) for c in tie]))
    two = slices.withColumn("_rn", rank).filter(F.col("_rn") <= 2)
    fields = F.struct("image_position", "image_orientation", "pixel_spacing", "slice_thickness")
    pair = two.groupBy(group).agg(
        F.max_by(fields, F.when(F.col("_rn") == 1, 1)).alias("a"),
        F.max_by(F.col("image_position"), F.when(F.col("_rn") == 2, 1)).alias("second"))

    def default(c: str, *values: float) -> Column:
        return F.coalesce(F.col(f"a.{c}"), F.array(*[F.lit(float(v)) for v in values]))

    # A null and a missing second slice look alike: both leave the fallback step.
    step0 = pair.select(
        group,
        F.slice(default("image_orientation", 1, 0, 0, 0, 1, 0), 1, 3).alias("row_dir"),
        F.slice(default("image_orientation", 1, 0, 0, 0, 1, 0), 4, 3).alias("col_dir"),
        default("pixel_spacing", 1, 1).alias("ps"), default("image_position", 0, 0, 0).alias("origin"),
        F.coalesce(F.col("a.slice_thickness"), F.lit(5.0)).alias("thick"), "second")
    normal = _scaled(_cross(F.col("row_dir"), F.col("col_dir")), F.col("thick"))
    between = F.zip_with(F.col("second"), F.col("origin"), lambda s, o: s - o)
    ready = step0.select(
        group, _scaled(F.col("col_dir"), F.get("ps", F.lit(0))).alias("c0"),
        _scaled(F.col("row_dir"), F.get("ps", F.lit(1))).alias("c1"),
        F.coalesce(between, normal).alias("c2"), F.col("origin").alias("c3"))
    cells = [F.get(c, F.lit(r)) for r in range(3) for c in ("c0", "c1", "c2", "c3")]
    return ready.select(group, F.col("c2").alias("slice_step"),
                        F.array(*cells, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("affine"))

