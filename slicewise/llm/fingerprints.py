"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a bag of words weighted by their counts. Sample d of a word of weight w takes
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (word, d) and gives

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r;

the word with the smallest a is the text's sample, told as a hash of (word, t, d). Two
texts share a sample with a probability equal to their generalised Jaccard similarity
(sum of smaller over sum of larger weights), so the share of equal samples estimates it.

``samples`` keeps ln a and the hash in one long, so that a grouped minimum in generated
code finds the sample. The edited texts need each document's successor by id: ids are cut
into ranges of ``RANGE``, each range is shuffled once with its texts, and everything after
that (successor, words, counts, samples) is grouped by the range and needs no further
shuffle of texts or words. The last row of a range takes the first text of the next
range that holds any id, found by a hierarchy of range numbers.

Defined results: a null text is the empty text; a text without words has one pseudo-word,
so that two of them are alike; a null id comes after all others; rows with equal ids are
ordered by a hash of their text; the only row follows itself; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLES = 32
#: Bits of the id inside a range (256 ids), and of the range number inside its parent.
RANGE_BITS, PARENT_BITS = 8, 20
BLANKS = " \t\n\x0b\x0c\r"
_LOW = (1 << 32) - 1
_BITS = (1 << 24) - 1
_LEAST_ID = -(1 << 63)


def sample(word: Column, weight: Column, d: int) -> Column:
    """ln a (upper half, order kept) and the sample's hash (lower half) of a hashed word."""
    x = F.xxhash64(word, F.lit(d))
    y = F.xxhash64(x)
    unit = lambda bits: (bits.cast("double") + 0.5) / float(1 << 24)
    part = lambda h, shift: unit(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_BITS)))
    r = -F.ln(part(x, 40) * part(x, 16))
    c = -F.ln(part(y, 40) * part(y, 16))
    b = (x.bitwiseAND(F.lit(0xFFFF)) * 65536 + y.bitwiseAND(F.lit(0xFFFF)) + 0.5) / float(1 << 32)
    t = F.floor(F.ln(weight) / r + b)
    ln_a = F.ln(c) - r * (t - b) - r
    return F.shiftleft(((ln_a + 96) * float(1 << 24)).cast("bigint"), 32).bitwiseOR(F.xxhash64(word, t, F.lit(d)).bitwiseAND(F.lit(_LOW)))


def samples(bags: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of (keys, word, weight): n samples of 8 hex digits each."""
    least = bags.groupBy(*keys).agg(*[F.min(sample(F.col("word"), F.col("weight"), d)).alias(f"_s{d}") for d in range(n)])
    digits = [F.lpad(F.lower(F.hex(F.col(f"_s{d}").bitwiseAND(F.lit(_LOW)))), 8, "0") for d in range(n)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 1 + 8 * d, 8) == F.substring(b, 1 + 8 * d, 8)).cast("int") for d in range(n)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / float(n)


def bags(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, weight): the hashed words of each text with their counts."""
    words = F.explode(F.split(F.trim(F.col(text), F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    return (texts.select(*keys, words.alias("w")).select(*keys, F.xxhash64("w").alias("word"))
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("weight")))


def fingerprint(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint) of every text; ``keys`` identify a row."""
    return samples(bags(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))), keys, text), keys)


def next_ranges(ranges: DataFrame) -> DataFrame:
    """(range, next_range) of the ranges in use: the next lower one; the lowest leads to the highest.

    Range numbers are grouped by their upper bits twice, so that no step sorts more
    than 2 ** 20 numbers in one task.
    """
    low = ranges.select("range", F.shiftright("range", PARENT_BITS).alias("p")).distinct()
    middle = low.groupBy("p").agg(F.max("range").alias("first")).withColumn("q", F.shiftright("p", PARENT_BITS))
    top = middle.groupBy("q").agg(F.max("p").alias("first_p"))
    down = W.partitionBy().orderBy(F.desc("q"))
    after = top.select("q", F.coalesce(F.lead("first_p").over(down), F.first("first_p").over(down)).alias("after_q"))
    inside = F.lead("p").over(W.partitionBy("q").orderBy(F.desc("p")))
    parents = (middle.withColumn("inside", inside).join(after, "q")
               .select("p", F.coalesce("inside", "after_q").alias("next_p")))
    heads = middle.select(F.col("p").alias("next_p"), "first")
    inside = F.lead("range").over(W.partitionBy("p").orderBy(F.desc("range")))
    return (low.withColumn("inside", inside).join(parents.join(heads, "next_p"), "p")
            .select("range", F.coalesce("inside", "first").alias("next_range")))


def successors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(range, nth, doc_id, text, next_text, last) in descending order of ids."""
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LEAST_ID))
    rows = docs.select(F.shiftright(key, RANGE_BITS).alias("range"), key.alias("id"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    down = W.partitionBy("range").orderBy(F.desc("id"), "tie")
    ordered = (rows.withColumn("nth", F.row_number().over(down)).withColumn("next_text", F.lead("text").over(down))
               .withColumn("last", F.col("next_text").isNull()))
    heads = ordered.filter("nth = 1").select(F.col("range").alias("next_range"), F.col("text").alias("head_text"))
    ahead = next_ranges(docs.select(F.shiftright(key, RANGE_BITS).alias("range")).distinct()).join(heads, "next_range").select("range", "head_text")
    return ordered.join(ahead, "range").select(
        "range", "nth", "doc_id", "text", F.coalesce("next_text", "head_text").alias("next_text"), "last")


def edited(text: Column, next_text: Column) -> Column:
    """The text whose last half gave way to the beginning of the next text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(next_text, half))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike it is to that and to its successor."""
    rows = successors(docs, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    told = rows.select("range", "nth", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    one = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    bodies = F.when(F.col("last"), F.array(one(0, F.col("text")), one(1, F.col("edited")), one(2, F.col("next_text")))).otherwise(
        F.array(one(0, F.col("text")), one(1, F.col("edited"))))
    each = rows.select("range", "nth", "doc_id", F.explode(bodies).alias("b")).select("range", "nth", "doc_id", "b.kind", "b.body")
    keys = ["range", "nth", "doc_id", "kind"]  # with doc_id both uses of the ranges read the same columns and share one shuffle
    prints = samples(bags(each, keys, "body"), keys)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fingerprint")))
    wide = prints.groupBy("range", "nth").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"), of(2).alias("head"))
    following = F.coalesce(F.lead("fingerprint").over(W.partitionBy("range").orderBy("nth")), F.col("head"))
    wide = (wide.withColumn("near_next", likeness(F.col("fingerprint"), following))
            .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))))
    return told.join(wide, ["range", "nth"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
