"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are hashed to ``SLOTS`` slots (short words by all their bytes, longer ones by
their first two and last three), slots are grouped into ``CLASSES`` classes by the words
that precede them, and

    P(word | context) = P(class | context) P(slot | class, context) P(word | slot).

The first factor is a softmax over classes with features for the previous word, the
word before it (skip) and the pair of both, all hashed; the second a softmax over the
slots of a class with features for the two previous classes. The third comes from the
exact counts of all training words, one count added, with one unknown word a slot.

Both softmaxes see a word only through its hash, so counts per hashed context are a
sufficient statistic: one pass counts words and what precedes each slot, a second one
the contexts of both softmaxes, and every gradient update is then the exact full-data
gradient, summed over the partitions of the context table. What is shipped to tasks
(weights, head words) has a size set by parameters; counts of words beyond the ``HEAD``
most frequent ones reach their texts by a join.

Without context the model is the base: slots and classes have the mass of their words'
counts, one added to each. Contexts move it only as far as texts that were kept back
from the fit (one training text in ``KEEP_ONE_IN``, by its crc32) agree: they choose how far the
first weights shrink to the base, and the round at which training stops.

Defined results: a null text is the empty text (one token, its end); without training
texts no word is known and the base score is 0; a null id counts as the empty id in the
split; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import byte_texts
from slicewise.llm.descent import fit_kept
from slicewise.session import durable

SLOTS = 2048
CLASSES = 32
#: Hashed buckets of the previous word, of the word before it, of the pair, and of the class before the last.
NEAR, FAR, PAIR, FAR_CLASS = 256, 64, 4096, 8
#: Most frequent training words whose counts are shipped to the tasks.
HEAD = 1 << 17
ROUNDS = 10
RATE = 0.1
#: One training text in so many is kept back to judge the fit; how many cases without context the starts may count as much as;
#: the prior's cases for a weight, and for one of a pair.
KEEP_ONE_IN = 8
SHRINK = (10.0, 40.0, 160.0, 640.0)
PULL, PAIR_PULL = 2.0, 20.0
#: Partitions, and so partial gradients, of the context tables, which have NEAR or CLASSES * FAR_CLASS rows.
PARTS = 4
#: Different words that a counting task holds before it hands them on, and words kept with their hash.
HOLD = 300_000
#: Bytes of text that are turned into arrays at once; they take some forty times as much.
CHUNK = 1 << 20
END = b""


def slot_of(word: bytes) -> int:
    """Slot 0 is the end of a text; short words have the lower half, others the upper."""
    if not word:
        return 0
    half = SLOTS // 2
    return 1 + crc32(word) % (half - 1) if len(word) <= 4 else half + crc32(word[:2] + word[-3:]) % half


def near_of(word: bytes) -> int:
    """Context bucket of a word; bucket 0 is the start of a text. Longer words count by their ending, which new words share."""
    if not word:
        return 0
    half = NEAR // 2
    return 1 + (crc32(word) >> 7) % (half - 1) if len(word) <= 4 else half + (crc32(word[-2:]) >> 7) % half


class Codes(dict):
    """word -> slot, context bucket and head number (0: not a head word), packed."""

    def __init__(self, head: dict[bytes, int] | None = None) -> None:
        super().__init__()
        self.head = head or {}

    def __missing__(self, word: bytes) -> int:
        code = (self.head.get(word, 0) * NEAR + near_of(word)) * SLOTS + slot_of(word)
        if len(self) < HOLD:
            self[word] = code
        return code


def tokens_of(data: bytes) -> list[bytes]:
    """Two starts, the lower-cased words, and the end."""
    return [END, END, *data.lower().split(), END]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a column of about ``CHUNK`` bytes and their texts: only one range's texts and arrays are there at a time."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = min(int(np.searchsorted(ends, before + CHUNK)) + 1, len(ends))
        yield start, end, byte_texts(column.slice(start, end - start))
        start = end


def coded(texts: list[bytes], codes: Codes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Token lists of texts, their codes in one array, and where each text starts in it."""
    tokens = [tokens_of(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    code = np.fromiter((codes[w] for t in tokens for w in t), np.int64, int(starts[-1]))
    return tokens, code, starts


def context(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, slot, previous, before): positions of real tokens and codes of the tokens around them."""
    real = np.ones(len(code), bool)
    real[starts[:-1]] = real[starts[:-1] + 1] = False
    at = np.flatnonzero(real)
    return at, code[at] % SLOTS, code[at - 1], code[at - 2]


def bucket(code: np.ndarray) -> np.ndarray:
    return code // SLOTS % NEAR


def pair_of(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return (near.astype(np.int64) * 40503 + far * 9973) % PAIR


class Model:
    """Classes of the slots, weights of both softmaxes and totals of each slot."""

    def __init__(self, slot_class: np.ndarray, slot_words: np.ndarray, slot_tokens: np.ndarray) -> None:
        self.slot_class, self.slot_words, self.slot_tokens = slot_class, slot_words, slot_tokens
        self.class_weights = np.zeros((1 + NEAR + FAR + PAIR, CLASSES), np.float32)
        self.slot_weights = np.zeros((1 + CLASSES + FAR_CLASS, SLOTS), np.float32)

    def class_logs(self, near: int, w: np.ndarray) -> np.ndarray:
        """log P(class | near, every far bucket)."""
        far = np.arange(FAR)
        z = w[0] + w[1 + near] + w[1 + NEAR:1 + NEAR + FAR] + w[1 + NEAR + FAR + pair_of(np.full(FAR, near), far)]
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def slot_logs(self, last: int, far: int, w: np.ndarray) -> np.ndarray:
        """log P(slot | its class, previous class, bucket of the class before)."""
        z = (w[0] + w[1 + last] + w[1 + CLASSES + far]).astype(np.float64)
        total = np.bincount(self.slot_class, np.exp(z), minlength=CLASSES)
        return z - np.log(np.maximum(total, 1e-300))[self.slot_class]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the two softmaxes for all contexts, and of each slot's share of one added count."""
        first = np.stack([self.class_logs(b, self.class_weights) for b in range(NEAR)])
        second = np.stack([self.slot_logs(i // FAR_CLASS, i % FAR_CLASS, self.slot_weights) for i in range(CLASSES * FAR_CLASS)])
        log10 = math.log(10)
        return (first / log10).astype(np.float32), (second / log10).astype(np.float32), -np.log10(self.slot_tokens + self.slot_words + 1.0)

    def class_fit(self, batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, float, float]:
        g = np.zeros(w.shape, np.float64)
        cases = kept = 0.0
        for near, fit, keep in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, k = np.frombuffer(fit, np.int64).reshape(FAR, CLASSES), np.frombuffer(keep, np.int64).reshape(FAR, CLASSES)
            logs = self.class_logs(near, w)
            kept += float((k * logs).sum())
            miss = np.exp(logs) * n.sum(1, keepdims=True) - n
            g[1 + near] += miss.sum(0)
            g[1 + NEAR:1 + NEAR + FAR] += miss
            np.add.at(g, 1 + NEAR + FAR + pair_of(np.full(FAR, near), np.arange(FAR)), miss)
            cases += n.sum()
        return g, cases, kept

    def slot_fit(self, batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, float, float]:
        g = np.zeros(w.shape, np.float64)
        cases = kept = 0.0
        for i, fit, keep in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, k = np.frombuffer(fit, np.int64), np.frombuffer(keep, np.int64)
            last, far = divmod(i, FAR_CLASS)
            logs = self.slot_logs(last, far, w)
            kept += float((k * logs).sum())
            per_class = np.bincount(self.slot_class, n, minlength=CLASSES)
            miss = np.exp(logs) * per_class[self.slot_class] - n
            g[1 + last] += miss
            g[1 + CLASSES + far] += miss
            cases += n.sum()
        return g, cases, kept


def first_pass(texts: DataFrame) -> DataFrame:
    """Partial counts of one pass: rows (token, slot, n) of words and rows (context, counts) of what precedes each slot.

    Every token counts, the end included.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        codes, total = Codes(), np.zeros(NEAR * SLOTS, np.int64)
        names = ["token", "slot", "n", "context", "counts"]

        def out() -> pa.RecordBatch:
            none = pa.nulls(len(held))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(map(slot_of, held), pa.int32()), pa.array(held.values(), pa.int64()),
                 none.cast(pa.int32()), none.cast(pa.binary())], names)

        for batch in batches:
            for _, _, data in chunks(batch.column(0)):
                tokens, code, starts = coded(data, codes)
                _, slot, last, _ = context(code, starts)
                total += np.bincount(bucket(last) * SLOTS + slot, minlength=NEAR * SLOTS)
                for t in tokens:
                    held.update(t)
                    held[END] -= 2  # the two starts
                    if len(held) >= HOLD:
                        yield out()
                        held.clear()
        if held:
            yield out()
        cells = total.reshape(NEAR, SLOTS)
        used = np.flatnonzero(cells.any(1))
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.binary()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(used, pa.int32()),
             pa.array([cells[i].tobytes() for i in used], pa.binary())], names)

    return durable(texts.mapInArrow(step, "token binary, slot int, n bigint, context int, counts binary"), "first-pass")


def word_counts(seen: DataFrame) -> DataFrame:
    """(token, slot, n) of every token from :func:`first_pass`."""
    return seen.filter("token IS NOT NULL").groupBy("token").agg(F.max("slot").alias("slot"), F.sum("n").alias("n"))


def _added(table: pa.Table) -> pa.Table:
    """The rows of one key with their count arrays summed."""
    sums = {c: sum(np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()).tobytes() for c in ("fit", "keep")}
    return pa.table({c: pa.array([sums[c]], pa.binary()) if c in sums else table.column(c)[:1] for c in table.column_names})


def contexts(texts: DataFrame, kind: np.ndarray) -> DataFrame:
    """(kind, context, fit, keep): counts of both softmaxes over all texts in one pass, kept-back texts apart."""
    tables = (("class", NEAR, FAR * CLASSES), ("slot", CLASSES * FAR_CLASS, SLOTS))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, totals = Codes(), [np.zeros(2 * rows * width, np.int64) for _, rows, width in tables]
        for batch in batches:
            for _, _, data in chunks(batch.column(0)):
                tokens, code, starts = coded(data, codes)
                _, slot, last, far = context(code, starts)
                keep = np.repeat([crc32(t) % KEEP_ONE_IN == 0 for t in data], [len(t) - 2 for t in tokens])
                cells = ((bucket(last) * FAR + bucket(far) % FAR) * CLASSES + kind[slot],
                         (kind[last % SLOTS] * FAR_CLASS + kind[far % SLOTS] % FAR_CLASS) * SLOTS + slot)
                for total, cell in zip(totals, cells, strict=True):
                    total += np.bincount(cell + keep * (len(total) // 2), minlength=len(total))
        for (name, rows, width), total in zip(tables, totals, strict=True):
            both = total.reshape(2, rows, width)
            used = np.flatnonzero(both.any((0, 2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()),
                 *[pa.array([side[i].tobytes() for i in used], pa.binary()) for side in both]], ["kind", "context", "fit", "keep"])

    form = "kind string, context int, fit binary, keep binary"
    return texts.mapInArrow(step, form).groupBy("kind", "context").applyInArrow(_added, form)


def classes_of(profile: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Classes of slots by k-means on which context buckets precede them (Hellinger distance)."""
    mass = profile.sum(1)
    x = np.sqrt(profile / np.maximum(mass, 1)[:, None])
    centre = x[np.argsort(-mass, kind="stable")[:CLASSES]]
    for _ in range(rounds):
        group = np.argmax(x @ centre.T, 1)
        for c in range(CLASSES):
            weight = np.sqrt(mass) * (group == c)
            if weight.any():
                centre[c] = weight @ x
                centre[c] /= max(np.linalg.norm(centre[c]), 1e-12)
    return np.where(mass > 0, group, np.arange(len(mass)) % CLASSES)


def class_shares(by_class: DataFrame) -> np.ndarray:
    """How often each class follows each context bucket in the texts of the fit."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.frombuffer(x, np.int64).reshape(FAR, CLASSES).sum(0).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], ["context", "n"])

    share = np.zeros((NEAR, CLASSES), np.int64)
    for r in by_class.mapInArrow(step, "context int, n binary").collect():  # at most NEAR rows
        share[r.context] = np.frombuffer(r.n, np.int64)
    return share


def shrunk(share: np.ndarray, base: np.ndarray, cases: float) -> np.ndarray:
    """Log of how much more likely each column is in a row of counts than in ``base``, drawn to 0 by so many cases without context."""
    return np.log((share + cases * base) / (share.sum(1, keepdims=True) + cases)) - np.log(base)


def train(texts: DataFrame, seen: DataFrame, counts: DataFrame) -> Model:
    """Fits the model to the training texts (text), their first pass and their word counts."""
    profile = np.zeros((SLOTS, NEAR), np.int64)
    near = seen.filter("context IS NOT NULL").select("context", F.col("counts").alias("fit"), F.unhex(F.lit("")).alias("keep"))
    near_rows = near.groupBy("context").applyInArrow(_added, "context int, fit binary, keep binary").collect()  # at most NEAR rows
    for r in near_rows:
        profile[:, r.context] = np.frombuffer(r.fit, np.int64)
    words, tokens = np.zeros(SLOTS), np.zeros(SLOTS)
    for r in counts.groupBy("slot").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():  # at most SLOTS rows
        words[r.slot], tokens[r.slot] = r.v, r.n
    model = Model(classes_of(profile), words, tokens)
    kind = model.slot_class
    both = durable(contexts(texts, kind), "contexts")
    by_class, by_slot = (both.filter(F.col("kind") == k).drop("kind").coalesce(PARTS) for k in ("class", "slot"))

    # the base: every known word's count and one, and one for the unknown word of the slot
    mass = tokens + words + 1.0
    class_mass = np.bincount(kind, mass, minlength=CLASSES)
    base = class_mass / class_mass.sum()
    base = np.maximum(base, 1e-12)  # a class without a slot
    share = class_shares(by_class)  # without the kept texts, or these would like the starts too well
    starts = []
    for cases in SHRINK:
        w = model.class_weights.copy()
        w[0] = np.log(base)
        w[1:1 + NEAR] = shrunk(share, base, cases)
        starts.append(w)
    pull = np.full(model.class_weights.shape, PULL)
    pull[1 + NEAR + FAR:] = PAIR_PULL
    model.class_weights = fit_kept(by_class, model.class_fit, starts, ROUNDS, RATE, pull)
    plain = model.slot_weights.copy()
    plain[0] = np.log(mass)
    model.slot_weights = fit_kept(by_slot, model.slot_fit, [plain], ROUNDS, RATE, np.full(plain.shape, PULL))
    return model


def scored(docs: DataFrame, model: Model, head: list[tuple[bytes, int]]) -> DataFrame:
    """Per row of (doc_id, text, held_out): what the tasks can tell without rare words' counts.

    row (a number of its own once the table is written), n_tokens, head_known, head_logs
    (sum of log10(count + 1)), model_logs (all but the words' own counts), and tail: the
    words that are no head words, with their number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    logs = np.concatenate(([0.0], np.log10(np.array([n for _, n in head], np.float64) + 1)))
    numbers = {w: i + 1 for i, (w, _) in enumerate(head)}
    first, second, slot_log = model.tables()
    slot_class = model.slot_class

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        codes, row = Codes(numbers), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data in chunks(batch.column(1)):
                tokens, code, starts = coded(data, codes)
                at, slot, last, far = context(code, starts)
                number = code[at] // (SLOTS * NEAR)
                group = slot_class[slot]
                value = (first[bucket(last), bucket(far) % FAR, group].astype(np.float64)
                         + second[slot_class[last % SLOTS] * FAR_CLASS + slot_class[far % SLOTS] % FAR_CLASS, slot] + slot_log[slot])
                begin = starts[:-1] - 2 * np.arange(b - a)  # every text has its end, so no range is empty
                size = np.diff(np.append(begin, len(at)))
                rare, flat, many, offsets = number == 0, [], [], [0]
                for i, t in enumerate(tokens):
                    here = np.flatnonzero(rare[begin[i]:begin[i] + size[i]])
                    found = Counter([t[j + 2] for j in here])
                    flat += found
                    many += found.values()
                    offsets.append(len(flat))
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat, pa.binary()), pa.array(many, pa.int64())], ["token", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size),
                     pa.array(np.add.reduceat((number > 0).astype(np.int64), begin)), pa.array(np.add.reduceat(logs[number], begin)),
                     pa.array(np.add.reduceat(value, begin)), tail],
                    ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_logs", "model_logs", "tail"])
                row += b - a

    return docs.select("doc_id", "text", "held_out").mapInArrow(
        step, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_logs double, "
              "model_logs double, tail array<struct<token:binary,k:bigint>>")


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows for which ``held_out`` is false.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    texts = rows.filter(~F.col("held_out")).select("text")
    seen = first_pass(texts)
    counts = durable(word_counts(seen), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = [(bytes(r.token), r.n) for r in counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "n").collect()]
    first = durable(scored(rows, train(texts, seen, counts), head), "scored")
    tail = first.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.k")
    found = (tail.join(counts.select("token", "n"), "token").groupBy("row")
             .agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("tail_logs")))
    logs = F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0))
    return first.drop("tail").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (logs + F.col("model_logs")).alias("score"))
