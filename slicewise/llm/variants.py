"""Spelling variant grouping: one-edit neighbours over the sorted vocabulary.

The vocabulary is sorted by code point. All words between two places of the list that
share their first d letters share the first d rows of the edit matrix against a query, so
that a range of the list is walked from prefix to prefix: a range is cut where the longest
common prefix of adjacent words ends, its parts inherit its row and add one letter, and a
part whose row holds nothing within one edit is skipped with all its words. Rows are three
cells wide (the band around the diagonal). A block of queries takes each step at once.

Two words at one edit share their first or their last half: a query of length n starts
at the range of the words that share its first n // 2 letters, where the row is known, and
a second list, sorted by the reversed words, finds the pairs that share the last half.
Each list is range-partitioned into parts of a bounded number of words; a query goes to the
parts that hold words of its range, which is one part unless a beginning is so frequent
that it fills several; of those it goes where the part's shared prefix is within one edit.

A word's form is its neighbour of largest count, if that is ``RATIO`` times its own at
least; roots follow forms to the end. Counts grow along a chain, so that it has no loops
and doubling ends after a few joins.

Defined results: a null text has no words; a null id counts as the empty text in the
digest that decides on deletions; repeated rows count as often as they stand there; among
neighbours of equal count the first by code point is the form; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import byte_texts
from slicewise.session import durable

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter, by the crc32 of ``<doc_id>:<run>``.
DELETE_ONE_IN = 199
#: Words of a part of the sorted list; queries that take their steps together; different words a task counts before it hands them on.
PART_WORDS, BLOCK, HELD_WORDS = 20_000, 2048, 400_000
#: Letters are code points up to 255: one byte each.
CODE = "latin-1"


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences in all texts."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}")  # matches begin at a run's first letter and end with it

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                for i, data in zip(ids[at:at + 256], byte_texts(batch.column(1).slice(at, 256)), strict=True):
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for run, n in Counter(runs.findall(data.lower().decode())).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % DELETE_ONE_IN == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1:]
                            if len(run) < MIN_LETTERS:
                                continue
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    rows = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(step, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def below(words: list[bytes], prefix: bytes) -> int:
    """Place of the first of the sorted words behind all that begin with ``prefix``."""
    head = prefix.rstrip(b"\xff")
    return bisect_left(words, head[:-1] + bytes([head[-1] + 1])) if head else len(words)


class SortedWords:
    """A sorted list of different words as one buffer, with the longest common prefixes of adjacent words."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1].astype(np.int64)
        self.letters = np.frombuffer(b"\0".join(words) + b"\0\0", np.uint8)
        lcp, left, depth = np.zeros(len(words), np.int64), np.arange(1, len(words)), 0
        while len(left):
            a, b = self.letters[self.start[left - 1] + depth], self.letters[self.start[left] + depth]
            left = left[(a == b) & (a > 0)]
            depth += 1
            lcp[left] = depth
        #: Places where a range of words with d shared letters is cut.
        order = np.argsort(lcp, kind="stable")
        cuts = np.searchsorted(lcp[order], np.arange(lcp.max(initial=0) + 2))
        self.cut = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def range_of(self, prefix: bytes) -> tuple[int, int]:
        return bisect_left(self.words, prefix), below(self.words, prefix)

    def split(self, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut ranges that share ``depth`` letters by the next letter: (range number, low, high)."""
        cut = self.cut[depth] if depth < len(self.cut) else np.zeros(0, np.int64)
        a, b = np.searchsorted(cut, low + 1), np.searchsorted(cut, high)
        parts = b - a + 1
        owner = np.repeat(np.arange(len(low)), parts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        place = a[owner] + inner
        if not len(cut):
            return owner, low[owner], high[owner]
        begin = np.where(inner == 0, low[owner], cut[np.minimum(place - 1, len(cut) - 1)])
        end = np.where(inner == parts[owner] - 1, high[owner], cut[np.minimum(place, len(cut) - 1)])
        return owner, begin, end


def advance(row: tuple, letter: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple:
    """The band's next row: cells at query prefixes of depth, depth + 1 and depth + 2 letters after one more letter of the list."""
    before, here, after = row
    at = start + depth
    n0 = np.minimum(before + (query[at - 1] != letter), here + 1) if depth else here + 1
    n1 = np.minimum(np.minimum(here + (query[at] != letter), after + 1), n0 + 1)
    n2 = np.minimum(after + (query[at + 1] != letter), n1 + 1)
    # cells behind the query's end lead nowhere
    return n0, np.where(length > depth, n1, 2), np.where(length > depth + 1, n2, 2)


def neighbours(listed: SortedWords, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs at exactly one edit that share the query's first half; words as long as the query or one shorter."""
    found_q, found_w = [], []
    for block in range(0, len(queries), BLOCK):
        asked = queries[block:block + BLOCK]
        size = np.array([len(q) for q in asked], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 3)])[:-1].astype(np.int64)
        letters = np.frombuffer(b"\0\0\0".join(asked) + b"\0\0\0", np.uint8)
        ranges = np.array([listed.range_of(q[:len(q) // 2]) for q in asked], np.int64).reshape(-1, 2)
        waiting = np.argsort(size // 2, kind="stable")
        waiting_depth = (size // 2)[waiting]
        q = low = high = before = here = after = np.zeros(0, np.int64)
        depth = int(waiting_depth[0])
        while True:
            fresh = waiting[slice(*np.searchsorted(waiting_depth, [depth, depth + 1]))]
            fresh = fresh[ranges[fresh, 0] < ranges[fresh, 1]]
            one = np.ones(len(fresh), np.int64)
            q, low, high = np.concatenate([q, fresh]), np.concatenate([low, ranges[fresh, 0]]), np.concatenate([high, ranges[fresh, 1]])
            before, here, after = np.concatenate([before, one]), np.concatenate([here, 0 * one]), np.concatenate([after, one])
            if not len(q):
                later = waiting_depth[waiting_depth > depth]
                if not len(later):
                    break
                depth = int(later[0])
                continue
            owner, low, high = listed.split(low, high, depth)
            q, before, here, after = q[owner], before[owner], here[owner], after[owner]
            letter = listed.letters[listed.start[low] + depth]
            ended = letter == 0
            short = size[q] - depth  # the query's letters beyond the word
            hit = ended & (((short == 0) & (here == 1)) | ((short == 1) & (after == 1)))
            found_q.append(q[hit] + block)
            found_w.append(low[hit])
            go = ~ended
            q, low, high, letter = q[go], low[go], high[go], letter[go]
            before, here, after = advance((before[go], here[go], after[go]), letter, letters, begin[q], size[q], depth)
            near = np.minimum(np.minimum(before, here), after) <= 1
            q, low, high, before, here, after = q[near], low[near], high[near], before[near], here[near], after[near]
            depth += 1
    return np.concatenate([*found_q, np.zeros(0, np.int64)]), np.concatenate([*found_w, np.zeros(0, np.int64)])


def within_one(query: bytes, prefix: bytes) -> bool:
    """Whether a word that begins with ``prefix`` can be at one edit from ``query``."""
    row: tuple = (np.array([2]), np.array([0]), np.array([1]))
    letters, size = np.frombuffer(query + b"\0\0\0", np.uint8), np.array([len(query)])
    for depth, c in enumerate(prefix[:len(query) + 2]):
        if depth > len(query):
            return False
        row = advance(row, np.array([c]), letters, np.array([0]), size, depth)
        if min(int(x[0]) for x in row) > 1:
            return False
    return True


def keys(words: list[str], backward: bool) -> list[bytes]:
    coded = [w.encode(CODE) for w in words]
    return [w[::-1] for w in coded] if backward else coded


def routed(listed: DataFrame, bounds: list[tuple[int, str, str]], backward: bool) -> DataFrame:
    """(part, word, n): every word as a query in each part of the list that can hold a neighbour in its range."""
    spans = sorted((*keys([low, high], False), part) for part, low, high in bounds)  # bounds are keys already
    lows, parts = [s[0] for s in spans], [s[2] for s in spans]
    common = [a[:next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))] for a, b, _ in spans]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, row = [], []
            for i, key in enumerate(keys(batch.column(0).to_pylist(), backward)):
                prefix = key[:len(key) // 2]
                first, last = max(0, bisect_right(lows, prefix) - 1), below(lows, prefix) - 1
                for k in range(first, last + 1):
                    if first == last or within_one(key, common[k]):
                        to.append(parts[k])
                        row.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.take(pa.array(row, pa.int64())).columns], ["part", "word", "n"])

    return listed.select("word", "n").mapInArrow(step, "part int, word string, n bigint")


def best_of(owner: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner among pairs: (owner, pairs, its other of largest count, first rank among equals)."""
    order = np.lexsort((rank[other], -n[other], owner))
    owner, other = owner[order], other[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[first], np.diff(np.append(first, len(owner))), other[first]


_NEAR = "word string, n_near bigint, form string, form_n bigint"


def near(words: DataFrame, backward: bool, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) from the pairs that share their first half (``backward``: the last half only)."""
    key = F.reverse("word") if backward else F.col("word")
    parts = words.count() // part_words + 1
    listed = (words.withColumn("key", key).repartitionByRange(parts, "key")
              .withColumn("part", F.spark_partition_id()))
    listed = durable(listed, "variants-list")
    bounds = [tuple(r) for r in listed.groupBy("part").agg(F.min("key"), F.max("key")).collect()]  # a row a part
    both = listed.select("part", "word", "n", F.lit(True).alias("listed")).unionAll(
        routed(listed, bounds, backward).select("part", "word", "n", F.lit(False).alias("listed")))

    def step(table: pa.Table) -> pa.Table:
        is_listed = table.column("listed").to_numpy()
        text, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        key = keys(text, backward)
        rows = np.flatnonzero(is_listed)
        rows = rows[np.argsort(np.array([key[i] for i in rows], object), kind="stable")] if len(rows) else rows
        asked = np.flatnonzero(~is_listed)
        q, w = neighbours(SortedWords([key[i] for i in rows]), [key[i] for i in asked])
        a, b = asked[q], rows[w]
        # pairs of one length are met from both sides; those that share the first half belong to the forward list
        keep = np.array([(len(x := text[i]) > len(y := text[j]) or x < y) and not (backward and x[:len(x) // 2] == y[:len(x) // 2])
                         for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[keep], b[keep]
        places: dict[str, int] = {}
        same = np.array([places.setdefault(t, i) for i, t in enumerate(text)], np.int64)
        a, b = same[a], same[b]
        rank = np.empty(len(text), np.int64)
        rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
        owner, pairs, other = best_of(np.concatenate([a, b]), np.concatenate([b, a]), n, rank)
        return pa.table([pa.array([text[i] for i in owner.tolist()], pa.string()), pa.array(pairs, pa.int64()),
                         pa.array([text[i] for i in other.tolist()], pa.string()), pa.array(n[other], pa.int64())], ["word", "n_near", "form", "form_n"])

    return both.groupBy("part").applyInArrow(step, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form in (word, form), by doubling."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = durable(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                      "variants-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = durable(words, "variants-words")
    found = near(words, False, part_words).unionAll(near(words, True, part_words))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    by_word = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    told = words.join(by_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    told = durable(told, "variants-forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
