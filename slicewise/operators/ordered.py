"""Ordered scans (positions, running sums, running maxima) without one-task groups.

A plain window sends a whole group to one task. The two functions here cut a
group along its order first, total each cut, and add the totals of the earlier
cuts as an offset:

* :func:`scan_by_bucket` - the order has a natural bucket that is a pure function
  of the row (a hash prefix, a score bucket). Lazy, one shuffle of the rows.
* :func:`scan` - no such bucket. A plain lazy window for groups that fit a task's disk
  (one study's slices, one run's epochs). For groups without bound the caller names a
  number of ranges: rows are then range-partitioned on the order, written once with
  their range number, and scanned per range. Nothing is capped or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise.session import durable

_CUT = "_cut"


def _scan_cuts(df: DataFrame, keys: list[str], cut: str, order: list[Column],
               position: str | None, size: str | None, sums: dict[str, Column],
               max_before: dict[str, Column], totals_of: dict[str, str] | None = None) -> DataFrame:
    """Window inside each (keys, cut) plus the offsets of the earlier cuts.

    The offsets come from one row per (keys, cut). ``totals_of`` names group
    totals of running sums to add: {new column: name in ``sums``}.
    """
    totals_of = totals_of or {}
    totals = df.groupBy(*keys, cut).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()],
        *[F.max(c).alias(f"_m_{name}") for name, c in max_before.items()],
    )
    earlier = W.partitionBy(*keys).orderBy(cut).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *keys, cut,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o_n"),
        F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_o_s_{name}") for name in sums],
        *[F.sum(f"_s_{name}").over(whole).alias(f"_t_{new}") for new, name in totals_of.items()],
        *[F.max(f"_m_{name}").over(earlier).alias(f"_o_m_{name}") for name in max_before],
    )
    joined = _null_safe_join(df, offsets, [*keys, cut])
    inside = W.partitionBy(*keys, cut).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.row_number().over(inside) - 1 + F.col("_o_n")).cast("bigint").alias(position))
    if size:
        out.append(F.col("_size").cast("bigint").alias(size))
    out += [(F.sum(c).over(upto) + F.col(f"_o_s_{name}")).alias(name) for name, c in sums.items()]
    out += [F.col(f"_t_{new}").alias(new) for new in totals_of]
    out += [F.greatest(F.max(c).over(before), F.col(f"_o_m_{name}")).alias(name)
            for name, c in max_before.items()]
    return joined.select(*out)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by ``keys`` with null equal to null.

    Keys that cannot be null use plain equality, so that the join and a window
    by the same keys share one shuffle.
    """
    renamed = right
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}")) if left.schema[k].nullable else F.col(k) == F.col(f"_r_{k}")
        cond = cond & same
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def scan_by_bucket(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], *,
                   position: str | None = None, size: str | None = None,
                   sums: dict[str, Column] | None = None, totals_of: dict[str, str] | None = None) -> DataFrame:
    """Scan each group of ``keys`` in ``order``; ``bucket`` must never decrease along it."""
    cut = df.withColumn(_CUT, bucket)
    return _scan_cuts(cut, keys, _CUT, order, position, size, sums or {}, {}, totals_of).drop(_CUT)


def _plain(df: DataFrame, keys: list[str], order: list[Column], position: str | None,
           size: str | None, sums: dict[str, Column], max_before: dict[str, Column]) -> DataFrame:
    inside = W.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.row_number().over(inside) - 1).cast("bigint").alias(position))
    if size:
        out.append(F.count(F.lit(1)).over(W.partitionBy(*keys)).alias(size))
    out += [F.sum(c).over(upto).alias(name) for name, c in sums.items()]
    out += [F.max(c).over(before).alias(name) for name, c in max_before.items()]
    return df.select(*out)


def scan(df: DataFrame, keys: list[str], order: list[Column], *,
         position: str | None = None, size: str | None = None,
         sums: dict[str, Column] | None = None,
         max_before: dict[str, Column] | None = None,
         ranges: int | None = None) -> DataFrame:
    """Scan each group of ``keys`` in ``order`` (which must leave no ties).

    ``position`` is the 0-based rank, ``size`` the group's row count, ``sums``
    running sums up to the row, ``max_before`` maxima over the earlier rows.
    A lazy window, unless the caller declares groups without bound by ``ranges``.
    """
    sums, max_before = sums or {}, max_before or {}
    if ranges is None:
        return _plain(df, keys, order, position, size, sums, max_before)
    cut = df.repartitionByRange(ranges, *keys, *order).withColumn(_CUT, F.spark_partition_id())
    return _scan_cuts(durable(cut, "ranges"), keys, _CUT, order, position, size, sums, max_before).drop(_CUT)
