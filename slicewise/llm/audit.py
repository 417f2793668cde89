"""Filter interaction audit: which filter removes what, in every order, with duplicate flags from radix tries.

A filter is a bit. A document's mask holds the filters it fails; four filters look at the
text alone, the fifth fails a text that a smaller id has as well. What any order of the
filters keeps, removes and removes a second time follows from the number of documents of
each mask, so that documents are reduced to masks once and orders are never run.

Equal texts are found by compressed tries over whole texts. Every task inserts its texts
into tries of its own (a trie is emptied when it holds ``TRIE_BYTES``) and hands on each
different text once with its smallest id, so that a group of copies of any size arrives
as few rows. These are range-partitioned by prefixes that adapt to the texts: a prefix
that covers more than a range should hold is made four times as long, until it splits or
the texts end. A range's rows are merged in order into tries that are emptied between two
texts, whatever the range's size; their terminals hold the smallest id of a text and the
number of its rows, and a walk over them gives the texts that occur more than once.

Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive.

Defined results: a null text is the empty text; a null source is the part named ''; a
null id neither is smaller than another id nor has a smaller one, so it never fails the
duplicate filter; of rows with equal ids and texts none fails it on account of the other;
a document counts as good or toxic if any label row of its id says so, a null id has no
labels; an empty table gives no parts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import byte_texts, code_points
from slicewise.session import durable

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT, MAX_CAPITALS = 50, 2  # percent
SYMBOLS = b"#$%&*|"
#: Text bytes that a trie may hold before it is emptied.
TRIE_BYTES = 16 << 20
#: Text bytes of a range; beyond ``RANGES`` ranges these grow instead of their number.
RANGE_BYTES, RANGES = 32 << 20, 4096
#: Characters of the first prefix; longer ones are its multiples by powers of four.
PREFIX = 16

_NO_CAPITALS = bytes(range(65, 91))


class Trie:
    """Compressed trie over byte strings: edges carry slices, a terminal holds (smallest id, rows)."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.bytes = 0

    def insert(self, text: bytes, least: int | None, rows: int) -> None:
        """Add ``rows`` rows of a text whose smallest id is ``least`` (None: no row has an id)."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                held = node.get(None)
                if held is None:
                    node[None] = [least, rows]
                    self.bytes += len(text) + 100
                else:
                    held[1] += rows
                    if least is not None and (held[0] is None or least < held[0]):
                        held[0] = least
                return
            edge = node.get(text[at])
            if edge is None:
                node[text[at]] = (text[at:], {None: [least, rows]})
                self.bytes += len(text) - at + 300
                return
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = shared(label, text[at:at + len(label)])
            node[text[at]] = (label[:same], {label[same]: (label[same:], below)})
            self.bytes += 300

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(text, smallest id, rows) of every text, in byte order."""
        stack: list = [(b"", self.root)]
        while stack:
            text, node = stack.pop()
            if None in node:
                yield (text, *node[None])
            for first in sorted((k for k in node if k is not None), reverse=True):
                label, below = node[first]
                stack.append((text + label, below))


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # halving compares slices in C
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def text_mask(data: bytes) -> int:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, _NO_CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * code_points(data)) << 2
            | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


_READ = "id bigint, part string, mask int, key binary, text string, least bigint, rows bigint, size bigint"


def read(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """One pass over the texts: a row (id, part, mask, key) a document and a row (key, text, least, rows) a text of a local trie."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        trie = Trie()

        def emptied() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for text, least, n in trie.terminals():
                rows.append((digest(text), text, least, n))
                size += len(text)
                if size > 4 << 20:
                    yield texts(rows)
                    rows, size = [], 0
            if rows:
                yield texts(rows)

        def texts(rows: list[tuple]) -> pa.RecordBatch:
            key, text, least, n = zip(*rows, strict=True)
            empty = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([
                empty.cast(pa.int64()), empty.cast(pa.string()), empty.cast(pa.int32()), pa.array(key, pa.binary()),
                pa.array(text, pa.binary()).cast(pa.string()), pa.array(least, pa.int64()), pa.array(n, pa.int64()), pa.array(map(len, text), pa.int64())], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 512):
                data = byte_texts(batch.column(1).slice(at, 512))
                for i, t in zip(ids[at:at + 512], data, strict=True):
                    trie.insert(t, i, 1)
                empty = pa.nulls(len(data))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 512), batch.column(2).slice(at, 512), pa.array([text_mask(t) for t in data], pa.int32()),
                    pa.array([digest(t) for t in data], pa.binary()), empty.cast(pa.string()), *[empty.cast(pa.int64())] * 3], names)
                if trie.bytes > TRIE_BYTES:
                    yield from emptied()
                    trie = Trie()
        yield from emptied()

    return source.mapInArrow(step, _READ)


def ranged(texts: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(text, least, rows, size) range-partitioned by adaptive prefixes and sorted; equal texts share a partition.

    The order is by the first ``PREFIX`` characters, then by the hash of the row's adapted
    prefix: the shortest one (16, 64, 256, ... characters) that covers at most ``size``
    bytes, or the whole text. At most ``RANGES`` prefixes of a length can cover more, and
    only their hashes reach the driver.
    """
    total = texts.agg(F.sum("size")).first()[0] or 0
    size = max(size, total // RANGES + 1)
    at = lambda n: F.xxhash64(F.substring("text", 1, n))
    left, length, deep = texts, PREFIX, at(PREFIX)
    while True:
        grown = left.groupBy(at(length).alias("h")).agg(F.sum("size").alias("size"), F.max(F.length("text")).alias("longest"))
        wide = [r.h for r in grown.filter((F.col("size") > size) & (F.col("longest") > length)).collect()]
        if not wide:
            break
        left = left.filter(at(length).isin(wide))
        deep = F.when(at(length).isin(wide), at(4 * length)).otherwise(deep)
        length *= 4
    cut = texts.repartitionByRange(total // size + 1, F.substring("text", 1, PREFIX), deep)
    return cut.sortWithinPartitions("text")


def repeated(texts: DataFrame) -> DataFrame:
    """(key, least): the texts of (text, least, rows, size) with more than one row, from tries over sorted ranges."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
            found = [(digest(t), least) for t, least, n in trie.terminals() if n > 1 and least is not None]
            if found:
                key, least = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(least, pa.int64())], ["key", "least"])

        trie, last = Trie(), None
        for batch in batches:
            for text, least, n in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if trie.bytes > TRIE_BYTES and text != last:
                    yield from emptied(trie)
                    trie = Trie()
                trie.insert(text, least, n)
                last = text
        yield from emptied(trie)

    return ranged(texts.select("text", "least", "rows", "size")).mapInArrow(step, "key binary, least bigint")


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: bit i is set if the row fails the filter ``LETTERS[i]``."""
    both = durable(read(docs, doc_id, text, part), "audit-texts")
    first = durable(repeated(both.filter("text IS NOT NULL")), "audit-repeated")
    rows = both.filter("text IS NULL").select("id", "part", "mask", "key").join(first, "key", "left")
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    return rows.select(F.col("id").alias("doc_id"), "part", F.col("mask").bitwiseOR(F.shiftleft(late, 4)).alias("mask"))


def order_steps() -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, unique): what a document of a mask adds to each step of each order."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        name = "".join(LETTERS[i] for i in order)
        for mask in range(1 << len(LETTERS)):
            fails = [mask >> i & 1 for i in order]
            gone = np.cumsum(fails)
            for step, failed in enumerate(fails):
                rows.append((mask, name, step + 1, int(gone[step] == 0), int(failed and gone[step] == 1), int(failed and gone[step] > 1),
                             int(failed and gone[-1] == 1)))
    return rows


def audit(found: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """What every step of every order does to every part of :func:`masks`' rows."""
    spark = found.sparkSession
    flags = (labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    by_mask = found.join(flags, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), flag("good"), flag("toxic"))
    by_mask = durable(by_mask, "audit-masks")  # at most 32 rows a part
    steps = spark.createDataFrame(order_steps(), "mask int, filter_order string, step int, kept int, removed int, redundant int, only int")
    total = lambda how, n="n": F.sum(F.col(how) * F.col(n)).cast("bigint")
    orders = by_mask.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"),
        total("only").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    # of a mask's filters each comes first in the same number of orders
    share = F.col("n") * F.expr("120 div bit_count(mask)")
    shares = by_mask.filter("mask > 0").groupBy("part").agg(*[
        F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, share).otherwise(0)).alias(letter) for i, letter in enumerate(LETTERS)])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = F.coalesce(*[F.when(letter == c, F.coalesce(c, F.lit(0))) for c in LETTERS])
    return orders.join(shares, "part", "left").select(*orders.columns, own.cast("bigint").alias("shapley"))
