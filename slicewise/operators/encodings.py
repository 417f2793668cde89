"""How well pixel encodings separate tissues: statistics and histogram overlap.

Encoded values are kept at half precision, so an encoding has at most 15,361
distinct values in [0, 1]. Counting per value within each task leaves a small
table from which means, exact medians and histograms all follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions.pixels import mask_count

SCHEMES = {"per_image": None, "medium": K.WINDOWS["medium"], "narrow": K.WINDOWS["narrow"]}


def usable_blocks(blocks: DataFrame, hu: str = "hu", min_pixels: int = K.MIN_TISSUE_PIXELS) -> DataFrame:
    """Blocks with enough gray-matter and blood pixels."""
    return blocks.filter((mask_count(F.col(hu), *K.GRAY_HU) >= min_pixels)
                         & (mask_count(F.col(hu), *K.BLOOD_HU) >= min_pixels))


#: Half-precision codes of the values 0 to 1: their bits, read as a number.
CODES = 0x3C00 + 1
TISSUES = (("gray", K.GRAY_HU), ("blood", K.BLOOD_HU))


def block_codes(values: np.ndarray, lengths: np.ndarray, schemes: dict = SCHEMES) -> np.ndarray:
    """Pixel counts of flat blocks as one vector: scheme, then tissue, then code.

    NaN stands for a missing pixel. A block with less than one HU of range has no own scale.
    """
    counts = np.zeros(len(schemes) * len(TISSUES) * CODES, np.int64)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return counts
    first = np.cumsum(lengths) - lengths
    low, high = np.fmin.reduceat(values, first), np.fmax.reduceat(values, first)
    block = np.repeat(np.arange(len(lengths)), lengths)
    for t, (_, (least, most)) in enumerate(TISSUES):
        mine = (values >= least) & (values <= most)
        v, lo, hi = values[mine], low[block[mine]], high[block[mine]]
        for s, params in enumerate(schemes.values()):
            if params is None:
                wide = hi - lo >= 1.0
                value = (v[wide] - lo[wide]) / (hi[wide] - lo[wide])
            else:
                value = np.clip((v - params[0]) / (params[1] - params[0]), 0.0, 1.0)
            code = value.astype(np.float16).view(np.uint16).astype(np.int64) & 0x7FFF  # no negative zero
            at = (s * len(TISSUES) + t) * CODES
            counts[at:at + CODES] += np.bincount(code, minlength=CODES)
    return counts


def value_counts(blocks: DataFrame, hu: str = "hu", schemes: dict = SCHEMES) -> DataFrame:
    """(scheme, tissue, value) -> pixel count, over all usable blocks.

    Every task adds its blocks up in one vector of counts, whose length is fixed by the
    schemes, so that no row is made for a pixel and a task hands on a row for each
    code that occurs.
    """
    places = [(scheme, tissue) for scheme in schemes for tissue, _ in TISSUES]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places) * CODES, np.int64)
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            total += block_codes(values, lengths, schemes)
        used = np.flatnonzero(total)
        place, code = np.divmod(used, CODES)
        yield pa.RecordBatch.from_arrays(
            [pa.array([places[i][0] for i in place], pa.string()), pa.array([places[i][1] for i in place], pa.string()),
             pa.array(code.astype(np.uint16).view(np.float16).astype(np.float64)), pa.array(total[used])], ["scheme", "tissue", "value", "n"])

    parts = blocks.select(hu).mapInArrow(step, "scheme string, tissue string, value double, n bigint")
    return parts.groupBy("scheme", "tissue", "value").agg(F.sum("n").alias("n"))


def encoding_stats(counts: DataFrame) -> DataFrame:
    """Mean, population std, exact median and pixel count per scheme and tissue."""
    group = W.partitionBy("scheme", "tissue")
    running = F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("n").over(group)
    mean = (F.sum(F.col("value") * F.col("n")).over(group) / total)
    ranked = counts.select("scheme", "tissue", "value", "n", running.alias("upto"), total.alias("total"),
                           mean.alias("mean"))
    # The two middle pixels (one and the same for an odd count).
    left, right = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col("value")))

    spread = F.sum(F.col("n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    return ranked.groupBy("scheme", "tissue").agg(
        F.sum("n").alias("n_pixels"), F.max("mean").alias("mean"),
        F.sqrt(spread / F.sum("n")).alias("std"),
        ((at(left) + at(right)) / 2).alias("median"))


def tissue_separation(counts: DataFrame, bins: int = 300) -> DataFrame:
    """One row per scheme: both tissues side by side, difference of means, overlap."""
    stats = encoding_stats(counts)

    def side(tissue: str, short: str) -> list[Column]:
        hit = F.col("tissue") == tissue
        return [F.max(F.when(hit, F.col(c))).alias(f"{short}_{c}") for c in ("mean", "std", "median", "n_pixels")]

    wide = stats.groupBy("scheme").agg(*side("gray", "gray"), *side("blood", "blood"))
    return (wide.withColumn("delta_mean", F.abs(F.col("blood_mean") - F.col("gray_mean")))
            .join(encoding_overlap(counts, bins), "scheme"))


def encoding_overlap(counts: DataFrame, bins: int = 300) -> DataFrame:
    """Histogram overlap of the tissues per scheme; 1.0 when the common range is empty.

    Equal bins over the common range of both tissues, the last one closed.
    """
    group = W.partitionBy("scheme")
    ranged = counts.select("*", F.min("value").over(group).alias("lo"), F.max("value").over(group).alias("hi"),
                           F.sum("n").over(W.partitionBy("scheme", "tissue")).alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.when(F.col("hi") > F.col("lo"),
                    F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    share = F.col("n") / F.col("total")
    per_bin = (ranged.groupBy("scheme", bin_no.alias("bin"))
               .agg(F.sum(F.when(F.col("tissue") == "gray", share).otherwise(0.0)).alias("g"),
                    F.sum(F.when(F.col("tissue") == "blood", share).otherwise(0.0)).alias("b"),
                    F.max("hi").alias("hi"), F.max("lo").alias("lo")))
    common = F.sum(F.least("g", "b"))
    return per_bin.groupBy("scheme").agg(
        F.when(F.max("hi") > F.max("lo"), common).otherwise(F.lit(1.0)).alias("overlap"))
