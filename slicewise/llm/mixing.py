"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

A source has a weight schedule over training time 0..1: knots joined by straight lines.
Its integral is the source's share of the budget; a target stops at ``max_repeats``
times the source's size and the excess is shared again by weight. The schedule's
running integral, scaled to the target, is the source's cumulative token demand.
Documents of a source queue in hashed order, pass after pass; a copy is wanted when the
demand reaches the words queued before it, so inverting the demand gives its training
position, and documents are range-sorted by position.

A source may hold any share of all rows: running sums are cut by a hash prefix of the
id (4,096 cuts a source), summed per cut first. Sources are aggregated to one row each
before they are ordered.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, ordered last; rows with equal ids (null included) are queued by
their text's hash, equal rows in any order of equal effect; an empty table gives an
empty mix; columns of ``docs`` other than id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise.llm.common import WORD

BUDGET = 1.5
MAX_REPEATS = 2
#: Hex digits of the id's digest that cut a source's queue.
CUT_DIGITS = 3


def source_key(source: Column) -> Column:
    """A non-null key that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def integral(knots: Column) -> Column:
    """Area under a schedule: array of (t, w) with t rising from 0 to 1."""
    steps = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (
        (knots[i]["t"] - knots[i - 1]["t"]) * (knots[i]["w"] + knots[i - 1]["w"]) / 2))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def segments(knots: Column) -> Column:
    """Straight pieces of a schedule with the area before each: (t0, t1, w0, w1, area0, area1)."""
    empty = F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,area0:double,area1:double>>")

    def extend(done: Column, i: Column) -> Column:
        a, b = knots[i - 1], knots[i]
        before = F.when(F.size(done) == 0, F.lit(0.0)).otherwise(F.element_at(done, -1)["area1"])
        piece = F.struct(a["t"].alias("t0"), b["t"].alias("t1"), a["w"].alias("w0"), b["w"].alias("w1"), before.alias("area0"),
                         (before + (b["t"] - a["t"]) * (a["w"] + b["w"]) / 2).alias("area1"))
        return F.concat(done, F.array(piece))
    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), empty, extend)


def time_of(area: Column, pieces: Column) -> Column:
    """When the running integral reaches ``area``: the root of the piece's quadratic."""
    piece = F.get(F.filter(pieces, lambda p: p["area1"] > area), F.lit(0))
    rest = area - piece["area0"]
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    # stable form of the root: 2 c / (b + sqrt(b^2 + 2 a c))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.when(rest <= 0, piece["t0"]).otherwise(F.least(piece["t1"], piece["t0"] + 2 * rest / (piece["w0"] + root)))


def targets(sources: DataFrame, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source_key, source_size, weight): shares by weight, stopped and shared again.

    Sources that stop are those with the least size per weight. In that order the level
    (words per unit of weight) follows from running sums, without a loop. The window is
    over one row per source.
    """
    whole = W.partitionBy()
    order = W.partitionBy().orderBy("_ratio", "source_key")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    stop = (max_repeats * F.col("source_size")).cast("double")
    level = ((F.lit(budget) * F.sum("source_size").over(whole) - F.coalesce(F.sum(stop).over(earlier), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    levels = (sources.withColumn("_ratio", stop / F.col("weight")).withColumn("_level", level)
              .withColumn("_open", F.col("_level") <= F.col("_ratio")))
    # the first source that need not stop sets the level of all after it
    at = F.min(F.when(F.col("_open"), F.struct("_ratio", "source_key", "_level"))).over(whole)
    return (levels.withColumn("_at", at)
            .withColumn("target", F.coalesce(F.least(stop, F.col("weight") * F.col("_at")["_level"]), stop))
            .drop("_ratio", "_level", "_open", "_at"))


def cyclic_schedules(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Schedules of (source_key): weights repeat by code point; odd sources fade in, even ones out.

    Every schedule keeps its integral equal to the source's weight: from 1.5 to 0.5
    times the weight, or the other way round.
    """
    rank = F.row_number().over(W.partitionBy().orderBy("source_key")) - 1
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    first = F.when(F.col("_rank") % 2 == 0, 1.5).otherwise(0.5)
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return (sources.withColumn("_rank", rank).withColumn("_w", cycle).withColumn("_f", first)
            .withColumn("knots", F.array(knot(0.0, F.col("_f") * F.col("_w")), knot(1.0, (2 - F.col("_f")) * F.col("_w"))))
            .drop("_rank", "_w", "_f"))


def queued(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, tie, source_key, size, cut, place) of every row: what the queues are made of."""
    digest = F.md5(F.concat_ws("/", F.lit("mix"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), source_key(F.col(source)).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.substring(digest, 1, CUT_DIGITS).alias("cut"), digest.alias("place"))


def mix(docs: DataFrame, schedules=cyclic_schedules, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Columns: doc_id, tie (hash of the text), source_key, size, source_size, target,
    taken, and copies: array of (words, position), one entry for each pass that takes
    words of the document. ``schedules`` adds ``knots`` to a table of sources.
    A source's takings sum to its target rounded down; the last copy of a source may be
    taken in part.
    """
    rows = queued(docs, doc_id, text, source)
    cuts = rows.groupBy("source_key", "cut").agg(F.sum("size").alias("_cut_size"))
    totals = schedules(cuts.groupBy("source_key").agg(F.sum("_cut_size").alias("source_size")))
    totals = targets(totals.withColumn("weight", integral(F.col("knots"))), budget, max_repeats)
    earlier = W.partitionBy("source_key").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cuts.withColumn("_offset", F.coalesce(F.sum("_cut_size").over(earlier), F.lit(0)))
               .join(totals, "source_key").select("source_key", "cut", "_offset", "source_size", "target", "knots"))
    inside = W.partitionBy("source_key", "cut").orderBy("place", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source_key", "cut"])
    start = F.col("_before") + F.col("_offset")
    demand = F.floor("target")

    def copy(i: Column) -> Column:
        at = start + i * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), demand - at)).cast("bigint")
        area = F.try_divide(at, F.col("target")) * F.element_at(F.col("_pieces"), -1)["area1"]
        return F.struct(words.alias("words"), time_of(area, F.col("_pieces")).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), copy), lambda c: c["words"] > 0)
    return (placed.withColumn("_pieces", segments(F.col("knots"))).withColumn("copies", copies)
            .withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]))
            .select("doc_id", "tie", "source_key", "size", "source_size", "target", "taken", "copies"))


def training_order(docs: DataFrame, schedules=cyclic_schedules, doc_id: str = "doc_id", text: str = "text",
                   source: str = "source") -> DataFrame:
    """The rows of ``docs`` in training order, once per copy; columns as in ``docs``.

    A document whose last copy is wanted in part stays whole: the overshoot is below one
    document per source.
    """
    taken = mix(docs, schedules, doc_id, text, source).filter(F.size("copies") > 0)
    plan = (taken.groupBy("doc_id", "tie", "source_key").agg(F.min("copies").alias("copies"))  # equal rows share one plan
            .select("doc_id", "tie", "source_key", F.explode(F.col("copies.position")).alias("position")))
    d, p = docs.alias("d"), plan.alias("p")
    wanted = d.join(p, F.col(f"d.{doc_id}").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("p.tie"))
                    & (source_key(F.col(f"d.{source}")) == F.col("p.source_key")))
    return wanted.orderBy("p.position", "p.doc_id", "p.tie").select("d.*")
