"""Near-duplicate groups with SetSketch registers, banding, likelihood estimates and full checks.

A document's set of k-word shingles is hashed to 64 bits. Register i of its sketch is
the exponentially spaced, truncated level of the smallest of exponentially distributed
values that hash i gives to the set's members (base 1.001): sketches merge by maximum
and equal registers are as likely as the sets are alike. Steps:

1. equal sets are one node (grouped by a 128-bit digest);
2. bands of registers are bucketed; in each bucket every node is a candidate with the
   bucket's smallest node, its hub, so that a bucket of n nodes gives n - 1 pairs;
3. the likeness of a pair is estimated by joint likelihood from the registers and the
   two exact set sizes; pairs more than ``SIGMAS`` standard errors short are dropped;
4. the rest is checked on the full sets: first each node's most alike hub, then, while
   components differ, its other hubs;
5. buckets whose nodes still fall into several components are compared across
   components, in cells of two blocks of ``BLOCK`` nodes, so that links between nodes that
   are no hub are found too. A pair counts in the first bucket it shares; likely pairs are
   checked on full sets where they are, and a cell hands on links only. No link among bucket
   mates is lost: each pair is checked, too unlike by its estimate, or joined already.

Sets at the threshold share no band with a chance below 1e-4 (0.8) or 1e-6 (0.85).

Defined results: a text without words has an empty set and is linked with nothing; with
fewer words than k the whole sequence is the one shingle; a row with a null id is
linked with nothing, gets a null component and is kept; rows of equal ids are one node of
the graph, linked if any of their sets is; repeated rows are alike; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise.llm.common import byte_texts
from slicewise.llm.components import components
from slicewise.session import durable

REGISTERS = 120
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
BASE = 1.001
RATE = 20.0
TOP = 65534
SIGMAS = 4.5
BLOCK = 512
#: Words kept with their hash in a task; the store is emptied when it is full.
MEMO_ENTRIES = 250_000

_RNG = np.random.RandomState(20)
_MULTIPLY = _RNG.randint(0, 1 << 63, REGISTERS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.randint(0, 1 << 63, REGISTERS, np.int64).astype(np.uint64) * np.uint64(2)
_SHINGLE = _RNG.randint(0, 1 << 63, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Hashed sets of k-word shingles of lower-cased texts."""

    def __init__(self, k: int) -> None:
        import xxhash
        self.k, self.hash, self.memo = k, xxhash.xxh3_64_intdigest, {}

    def __call__(self, data: bytes) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes; empty without words."""
        words = data.lower().split()
        if len(words) < self.k:
            return np.array([self.hash(b" ".join(words), len(words))] if words else [], np.uint64)
        memo, code = self.memo, self.hash
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = code(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        s = np.zeros(n, np.uint64)
        for i in range(self.k):
            s += h[i:i + n] * _SHINGLE[i]
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def registers(members: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of hashes."""
    most = np.zeros(REGISTERS, np.uint64)
    for start in range(0, len(members), 1024):
        part = members[start:start + 1024, None] * _MULTIPLY
        part += _ADD
        np.maximum(most, part.max(0), out=most)
    # the largest uniform value gives the smallest exponential one
    smallest = -np.log1p(-((~most >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likeness(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, given set sizes and how many registers of u lie above and below v's."""
    n_u, n_v = n_u.astype(np.float64), n_v.astype(np.float64)
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    equal = REGISTERS - above - below

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        over, under = p(u - v * j), p(v - u * j)
        return above * np.log(over) + below * np.log(under) + equal * np.log(np.clip(1 - over - under, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):  # the log likelihood is concave: golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = likelihood(a) < likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, regs) of every row; key and regs are null for empty sets."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            size, key, regs = [], [], []
            for data in byte_texts(batch.column(1)):
                members = shingle(data)
                size.append(len(members))
                key.append(hashlib.md5(members.tobytes()).digest() if len(members) else None)
                regs.append(registers(members).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "key", "regs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {kind}, n_shingles bigint, key binary, regs binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, cut: float) -> DataFrame:
    """(x, y, estimate) of the pairs (x, y) whose estimate reaches ``cut``."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "r_x", "r_y")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            estimate = likeness(batch.column(2).to_numpy(), batch.column(3).to_numpy(), (a > b).sum(1), (a < b).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate)], ["x", "y", "estimate"]).filter(
                pa.array(estimate >= cut))

    kind = nodes.schema["node"].dataType.simpleString()
    return met.mapInArrow(step, f"x {kind}, y {kind}, estimate double")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are alike."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))
    met = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").select("x", "y", "t_x", "t_y")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, hub = Shingler(k), None, None
        for batch in batches:
            good = []
            for x, y in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True):
                if y != last:  # pairs come sorted by y
                    last, hub = y, shingle(y)
                good.append(alike(shingle(x), hub, percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = texts.schema["node"].dataType.simpleString()
    return met.mapInArrow(step, f"x {kind}, y {kind}")


def _cross_pairs(cell: np.ndarray, band: np.ndarray, component: np.ndarray, block: np.ndarray, within: np.ndarray, n: np.ndarray,
                 regs: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of rows sorted by cell: the likely pairs of different components in each cell, likeliest first.

    ``within`` tells that a cell compares one block with itself; otherwise only pairs
    across its two blocks count. A pair that shares several buckets counts in the first.
    """
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(start, len(cell)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in np.unique(size[size > 1]):
        first, second = np.triu_indices(s, 1)
        of_size = start[size == s]
        step = max(1, 200_000 // len(first))  # cells at once
        for k in range(0, len(of_size), step):
            at = of_size[k:k + step, None]
            a, b = (at + first).ravel(), (at + second).ravel()
            keep = (component[a] != component[b]) & (within[a] | (block[a] != block[b]))
            a, b = a[keep], b[keep]
            for c in range(0, len(a), 20_000):
                x, y = a[c:c + 20_000], b[c:c + 20_000]
                equal = regs[x] == regs[y]
                # a loose bound on equal registers first; the estimate below is within it
                near = equal.sum(1) >= (cut - 0.1) * REGISTERS
                near &= equal.reshape(-1, BANDS, BAND_ROWS).all(2).argmax(1) == band[x]
                found.append((x[near], y[near]))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    estimate = likeness(n[a], n[b], (regs[a] > regs[b]).sum(1), (regs[a] < regs[b]).sum(1))
    a, b, estimate = (v[estimate >= cut] for v in (a, b, estimate))
    order = np.lexsort((b, a, -estimate, cell[a]))
    return a[order], b[order]


def _across(cells: DataFrame, cut: float, k: int, percent: int) -> DataFrame:
    """Links (x, y) between components from rows (bucket, i, j, band, block, node, component, n, regs, text).

    Likely pairs of a cell are checked on their full sets, unless links found in the cell
    have joined their components before; so a cell hands on fewer links than it has rows.
    """
    kind = cells.schema["node"].dataType.simpleString()
    names = ["bucket", "i", "j", "band", "block", "node", "component", "n", "regs", "text"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)

        def out(table: pa.Table) -> pa.RecordBatch:
            bucket, i, j, band, block, node, component, n = (table.column(c).to_numpy() for c in names[:-2])
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            cell = np.cumsum(np.append(False, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            a, b = _cross_pairs(cell, band, component, block, i == j, n, regs, cut)
            text = byte_texts(table.column("text").combine_chunks()) if len(a) else []
            sets: dict[bytes, np.ndarray] = {}
            links: list[tuple[int, int]] = []
            up: dict[int, int] = {}  # joined components of the current cell
            last = -1

            def members(row: int) -> np.ndarray:
                if text[row] not in sets:
                    sets[text[row]] = shingle(text[row])
                return sets[text[row]]

            def root(c: int) -> int:
                while (above := up.get(c, c)) != c:
                    c = above
                return c

            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if cell[x] != last:
                    last = cell[x]
                    up.clear()
                c, d = root(component[x]), root(component[y])
                if c != d and alike(members(x), members(y), percent):
                    up[max(c, d)] = min(c, d)
                    links.append((x, y))
            of = table.schema.field("node").type
            return pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in links], of), pa.array([node[y] for _, y in links], of)], ["x", "y"])

        rest: pa.Table | None = None  # the last cell may go on in the next batch; a cell has few rows
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if not table.num_rows:
                continue
            bucket, i, j = (table.column(c).to_numpy() for c in names[:3])
            last = int(np.flatnonzero((bucket == bucket[-1]) & (i == i[-1]) & (j == j[-1]))[0])
            if last:
                yield out(table.slice(0, last).combine_chunks())
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield out(rest.combine_chunks())

    dealt = cells.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(step, f"x {kind}, y {kind}")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    share = percent / 100
    cut = share - SIGMAS * math.sqrt(share * (1 - share) / REGISTERS)
    rows = durable(sketches(docs, k, doc_id, text), "sketches")
    nodes = durable(rows.filter("key is not null and doc_id is not null").groupBy("key")
                    .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "nodes")
    band = [F.xxhash64(F.lit(b), F.substring("regs", 1 + 2 * BAND_ROWS * b, 2 * BAND_ROWS)) for b in range(BANDS)]
    banded = nodes.select("node", F.posexplode(F.array(*band)).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("members")).filter("hub <> last")
    mates = durable(banded.join(shared.select("bucket", "hub", "members"), "bucket"), "mates")
    pairs = mates.filter("node <> hub").select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
    candidates = durable(_estimated(pairs, nodes, cut), "candidates")

    wanted = mates.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = durable(_member_texts(docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text")).join(wanted, "node"), k), "texts")
    best = candidates.groupBy("x").agg(F.max_by("y", F.struct("estimate", -F.col("y"))).alias("y"))
    links = durable(_verified(best, texts, k, percent), "verified")
    component = components(links, "x", "y")

    def differ(found: DataFrame, component: DataFrame) -> DataFrame:
        side = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        return found.join(side("x"), "x", "left").join(side("y"), "y", "left").filter(
            F.coalesce("c_x", "x") != F.coalesce("c_y", "y")).select("x", "y")

    def add(found: DataFrame, links: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = durable(_verified(found, texts, k, percent), "verified")
        if new.isEmpty():
            return links, component
        links = links.unionAll(new)
        return links, components(links, "x", "y")

    links, component = add(differ(candidates, component), links, component)
    placed = (mates.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
              .select("bucket", "band", "node", "component", "members"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cells = (placed.join(split, "bucket").join(nodes.select("node", "n", "regs"), "node").join(texts, "node")
             .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    crossing = durable(_across(cells, cut, k, percent), "crossing")
    if not crossing.isEmpty():
        component = components(links.unionAll(crossing), "x", "y")
    by_key = nodes.join(component, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), F.col("doc_id")))
    return (out.withColumn("component_id", component_id)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def _member_texts(rows: DataFrame, k: int) -> DataFrame:
    """(node, text) of (node, text, key): the rows whose text has the node's set, one for each set."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            same = [hashlib.md5(shingle(t).tobytes()).digest() == key
                    for t, key in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    kind = rows.schema["node"].dataType.simpleString()
    found = rows.select("node", "text", "key").mapInArrow(step, f"node {kind}, text string, key binary")
    return found.dropDuplicates(["node", "key"]).drop("key")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest id.

    Of rows that repeat an id one stays; rows with a null id all stay.
    """
    stay = groups(docs, k, percent, doc_id, text).filter("kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct()
    number = F.row_number().over(W.partitionBy(doc_id).orderBy(F.xxhash64(text), text))
    one = docs.join(stay, doc_id).select(*docs.columns).withColumn("_nth", number).filter("_nth = 1").drop("_nth")
    return one.unionAll(docs.filter(F.col(doc_id).isNull()))
