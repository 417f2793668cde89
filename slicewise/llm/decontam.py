"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ten consecutive words (fewer, if the item has
fewer). A window is a set of shingles of five words (fewer, if the window has fewer), and
a document holds the window only if it holds all of them, so that one necessary shingle
is enough to find it: the prefix of the set under the order by rarity, which is the
window's rarest shingle in the corpus. Windows one of whose shingles never occurs cannot
be held at all. Documents' shingles meet the prefixes in an equi-join; the shingle's
place in the window then fixes the place of the whole window in the document (position
bound), which must lie inside the document (length bound), and its words are compared
one by one.

The texts are read once for shingles. A shingle leaves its task only if it is one of
the benchmark's: a bit table of fixed size (65,536 rows, whatever the benchmark's size)
is broadcast for that, and what it lets through meets the exact shingles. A hit carries
the few words around it, so that no text is shuffled. Copies of a text share one key (the
text's digest) and are counted once; documents that hold the same windows share one list
of items.

Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII.

Defined results: null and empty texts have no words; an item without words has no window;
a null item id counts as the empty id; items with one id are one item; each row of the
table gives one row, repeated rows and ids equal ones; an empty benchmark contaminates
nothing, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise.session import durable

WINDOW = 10
SHINGLE = 5
#: Low bits of a shingle's hash that index the bit table: 2 ** 22 bits in 65,536 rows.
BITS = 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before upper-case letters are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """The words of a text as they stand there."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def words_of(text: Column) -> Column:
    """The words of a text; only A-Z are lower-cased (``lower`` does just that to pure ASCII)."""
    def low(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(tokens(text), low)


def shingle_at(words: Column, place: Column, k: int) -> Column:
    """The hash of the ``k`` words from a place on (of fewer words behind the last whole shingle)."""
    return F.xxhash64(*[F.get(words, place + j) for j in range(k)])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, window, m): every window of every item, once an item; words joined by a blank."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))
    rows = rows.filter(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(size)))
    rows = rows.select("item", "w", "m", F.explode_outer(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("i"))
    return rows.select("item", F.array_join(F.slice("w", F.col("i") + 1, F.col("m")), " ").alias("window"), "m").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, m, k, offset, x): the shingles of every window with their places in it."""
    rows = windows.select("wid", "m", F.least("m", F.lit(shingle)).alias("k"), F.split("window", " ").alias("w"))
    rows = rows.select("wid", "m", "k", "w", F.explode_outer(F.sequence(F.lit(0), F.col("m") - F.col("k"))).alias("offset"))
    by_length = F.coalesce(*[F.when(F.col("k") == k, shingle_at(F.col("w"), F.col("offset"), k)) for k in range(1, shingle + 1)])
    return rows.select("wid", "m", "k", "offset", by_length.alias("x"))


def bit_table(shingles: DataFrame) -> DataFrame:
    """(cell, bits): one set bit for the low bits of each hash; at most 2 ** (BITS - 6) rows."""
    low = shingles.select(F.col("x").bitwiseAND((1 << BITS) - 1).alias("low")).distinct()
    return low.groupBy(F.shiftright("low", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(low & 63 AS int)))").alias("bits"))


def document_hits(docs: DataFrame, shingles: DataFrame, lengths: list[int], text: str, window: int) -> DataFrame:
    """(key, n, at, x, first, around): the places of the benchmark's shingles in every text.

    ``around`` are the words from ``first`` on that any window through the shingle can cover.
    """
    rows = docs.select(text_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("w"))
    # the outer form: the plain one infers a filter that takes the words out of the text once more
    rows = rows.select("key", "w", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "word"))
    codes = [shingle_at(F.col("w"), F.col("at"), k) for k in lengths]
    rows = rows.select("key", "w", "n", "at", codes[0].alias("x") if len(codes) == 1 else F.explode(F.array(*codes)).alias("x"))
    rows = rows.withColumn("cell", F.shiftright(F.col("x").bitwiseAND((1 << BITS) - 1), 6))
    rows = rows.join(F.broadcast(bit_table(shingles)), "cell").filter(F.getbit("bits", F.col("x").bitwiseAND(63).cast("int")) == 1)
    first = F.greatest(F.lit(0), F.col("at") - (window - 1))
    rows = rows.select("key", "n", "at", "x", first.alias("first"), F.slice("w", first + 1, F.lit(2 * window - 1)).alias("around"))
    return rows.join(shingles.select("x").distinct(), "x")


def held_windows(hits: DataFrame, windows: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, wid, start, m): every occurrence of a window in a text."""
    rarity = hits.groupBy("x").agg(F.count(F.lit(1)).alias("seen"))
    known = shingles.withColumn("needed", F.col("m") - F.col("k") + 1).join(rarity, "x")
    prefix = (known.groupBy("wid", "m", "needed")
              .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("seen", "offset", "x")).alias("rarest"))
              .filter("found = needed").select("wid", "m", F.col("rarest.offset").alias("offset"), F.col("rarest.x").alias("x")))
    prefix = prefix.join(windows.select("wid", "window"), "wid")
    start = F.col("at") - F.col("offset")
    fits = hits.join(prefix, "x").withColumn("start", start).filter((start >= 0) & (start + F.col("m") <= F.col("n")))
    same = F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.col("m")), " ") == F.col("window")
    return fits.filter(same).select("key", "wid", "start", "m").distinct()


def covered(held: DataFrame) -> DataFrame:
    """(key, n_hit): words under at least one window."""
    spans = held.groupBy("key", "start").agg(F.max(F.col("start") + F.col("m")).alias("end"))
    earlier = W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    return (spans.withColumn("fresh", F.greatest(fresh, F.lit(0)))
            .groupBy("key").agg(F.sum("fresh").cast("bigint").alias("n_hit")))


def item_lists(held: DataFrame, members: DataFrame) -> DataFrame:
    """(key, items): the sorted ids of the items whose windows a text holds; equal window sets share a list."""
    sets = held.groupBy("key").agg(F.sort_array(F.collect_set("wid")).alias("wids"))
    named = sets.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(members, "wid")
    lists = named.groupBy("wids").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return sets.join(lists, "wids").select("key", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of ``docs``; ``items`` are sorted ids, empty for clean texts."""
    per_item = durable(item_windows(benchmark, item_id, item_text, window), "decontam-windows")
    windows = durable(per_item.select("window", "m").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontam-sets")
    members = per_item.join(windows, ["window", "m"]).select("wid", "item")
    shingles = durable(window_shingles(windows, shingle), "decontam-shingles")
    lengths = [r.k for r in shingles.select("k").distinct().orderBy("k").collect()] or [shingle]  # at most ``shingle`` numbers
    hits = durable(document_hits(docs, shingles, lengths, text, window), "decontam-hits")
    held = durable(held_windows(hits, windows, shingles), "decontam-held")
    found = covered(held).join(item_lists(held, members), "key")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"),
                       F.size(tokens(F.col(text))).cast("bigint").alias("n_words"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """The figures of :func:`contamination` with the items as count and digest."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
