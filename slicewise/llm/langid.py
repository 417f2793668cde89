"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one logistic classifier per bit looks at hashed
byte n-grams of the lower-cased text. Decoding sums, for each language, the logistic
losses of its bits, weighted by how reliable a trial fit's bit was on texts kept back from
it, and takes the nearest codeword (ties: the first language by code point). A text whose two nearest codewords are close is flagged ambiguous.

The classifiers are fitted on a sample of about ``PER_LANGUAGE`` labelled texts per
language, drawn by a hash of the id; prediction covers every row and whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; without
any labelled text every row is ``und``; a null label is not learned from; repeated rows
get equal results; an empty table gives an empty result; other columns, clashing names
included, are not read by ``identify`` and stay as they are in ``keep_known``. The set of labels is taken to be bounded (language names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import texts_of
from slicewise.llm.descent import descend
from slicewise.session import durable

BUCKETS = 1 << 14
#: Expected number of labelled texts per language in the training sample.
PER_LANGUAGE = 1000
#: One text in so many of the sample is kept back from a trial fit and tells how far each bit is right.
KEPT_BACK = 5
UNKNOWN = "und"
ROUNDS = 12
#: Partitions of the training sample, which is bounded.
PARTS = 8
#: Fixed odd multipliers of the n-gram hash.
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def features(text: str) -> np.ndarray:
    """Hellinger-scaled counts of hashed byte 1-, 2- and 3-grams (length 1)."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    value = np.zeros(len(data), np.uint32)
    for order in range(1, 4):
        if len(data) < order:
            break
        value = (value[:len(data) - order + 1] if order == 1 else value[:-1]) * _MIX[3] + (data[order - 1:] + np.uint32(order)) * _MIX[order - 1]
        counts += np.bincount(value >> np.uint32(18), minlength=BUCKETS)
    x = np.sqrt(counts.astype(np.float32))
    norm = math.sqrt(counts.sum())
    return x / norm if norm else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(languages, bits) of -1 / 1 whose rows are far apart: the best of seeded random draws.

    Every bit splits the languages; the number of bits grows with their logarithm.
    """
    if n < 2:
        return np.ones((n, 1), np.float32)
    bits = max(15, 10 * math.ceil(math.log2(n)))
    rng = np.random.RandomState(seed)
    best, best_distance = None, -1
    for _ in range(60):
        code = np.where(rng.rand(n, bits) < 0.5, -1, 1).astype(np.float32)
        flat = np.flatnonzero(np.abs(code.sum(0)) == n)
        code[rng.randint(0, n, len(flat)), flat] *= -1
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        distance = int((bits - agree.max()) / 2)
        if distance > best_distance:
            best, best_distance = code, distance
    return best


class Model:
    """Languages, their codewords, the bit classifiers and the bits' weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bit_weights: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bit_weights = languages, code, weights, bit_weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability of it among the languages, and whether it is ambiguous."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        x = features(text)
        at = np.flatnonzero(x)
        f = x[at] @ self.weights[at]
        losses = (np.logaddexp(0, -self.code * f) * self.bit_weights).sum(1)
        p = np.exp(losses.min() - losses)
        p /= p.sum()
        best = int(np.argmin(losses))  # ties: the first language by code point
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < 0.2)


def _gradient(code: np.ndarray):
    def gradient(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, float]:
        x = np.zeros((batch.num_rows, BUCKETS), np.float32)
        for i, (at, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
        y = code[batch.column(0).to_numpy()]
        weight = batch.column(3).to_numpy()[:, None]
        miss = -y / (1 + np.exp(np.clip(y * (x @ w), -30, 30))) * weight
        return x.T @ miss, float(weight.sum())
    return gradient


def sample_features(rows: DataFrame) -> DataFrame:
    """(label, at, value, weight, kept, deal) of (label, text, weight, kept, deal): sparse features as bytes."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = [], []
            for text in texts_of(batch.column(1)):
                x = features(text)
                nonzero = np.flatnonzero(x)
                at.append(nonzero.astype(np.uint16).tobytes())
                value.append(x[nonzero].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary()), *batch.columns[2:]],
                ["label", "at", "value", "weight", "kept", "deal"])

    return rows.mapInArrow(step, "label int, at binary, value binary, weight double, kept boolean, deal bigint")


def train(docs: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fits the bit classifiers on rows with a label and a text for which ``may_learn`` holds."""
    labelled = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}  # one row per language
    languages = sorted(sizes)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("language sample")), F.lit(1 << 30))
    label = share = weight = None
    for i, name in enumerate(languages):
        here = F.col(lang) == name
        part = min(1.0, per_language / sizes[name])
        balance = 1.0 / (part * sizes[name])
        label = F.when(here, i) if label is None else label.when(here, i)
        share = F.when(here, int(part * (1 << 30))) if share is None else share.when(here, int(part * (1 << 30)))
        weight = F.when(here, balance) if weight is None else weight.when(here, balance)
    # copies of a text are dealt to different parts by their ids, and kept back together
    kept = F.pmod(F.xxhash64(F.col(text), F.lit("kept back")), F.lit(KEPT_BACK)) == 0
    deal = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    chosen = labelled.filter(draw < share).select(
        label.cast("int").alias("label"), F.col(text).alias("text"), weight.alias("weight"), kept.alias("kept"), deal.alias("deal"))
    # a round of the fit sends weights from every partition: few of them, into however many files the sample was dealt
    sample = durable(sample_features(chosen).repartition(PARTS, "deal").drop("deal"), "language-sample").coalesce(PARTS)
    start = np.zeros((BUCKETS, code.shape[1]), np.float32)
    trial = descend(sample.filter("not kept"), _gradient(code), start, ROUNDS, 0.5)
    bits = _reliability(sample.filter("kept"), code, trial)
    # the classifiers themselves learn from the whole sample: a rare language may have no text to spare
    return Model(languages, code, descend(sample, _gradient(code), start, ROUNDS, 0.5), bits)


def _reliability(sample: DataFrame, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A weight per bit: log odds of a right bit on rows that the fit has not seen, between 0.2 and 4; equal weights without any."""
    def gradient(batch: pa.RecordBatch, _: np.ndarray) -> tuple[np.ndarray, float]:
        right = np.zeros(code.shape[1])
        for y, at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            f = np.frombuffer(value, np.float32) @ weights[np.frombuffer(at, np.uint16)]
            right += f * code[y] > 0
        return right, batch.num_rows

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(code.shape[1]), 0
        for batch in batches:
            r, k = gradient(batch, weights)
            right, n = right + r, n + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([right.tolist()], pa.list_(pa.float64()))], ["n", "right"])

    rows = sample.mapInArrow(step, "n bigint, right array<double>").collect()
    n = sum(r.n for r in rows)
    share = (sum(np.array(r.right) for r in rows) + 0.5) / (n + 1)
    return np.clip(np.log(share / (1 - share)), 0.2, 4.0)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                 pa.array([o[2] for o in out], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model, text: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose language is known (and wanted, if ``languages`` is given), ambiguous ones too."""
    at = docs.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([p != UNKNOWN and (languages is None or p in languages) for p, _, _ in out], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
