"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Every rule looks at one figure of the text and votes good (1), bad (-1) or abstains
(0); a rule that cannot tell anything about a text is not asked (2): only the rules that
hunt junk are asked about short texts, and only when they call them bad.
Expectation-maximisation over all documents estimates, without labels, how often each
rule votes what on good and on bad texts, false alarms included. Its sufficient statistic
is the count of every vote pattern (a few thousand), so the driver never sees documents.
The posterior probability of "good" replaces a filter in which all rules must pass.

Defined results: a null text has no words; a text without words gets posterior 0; with
an empty table the model stays at its starting values. Rows are judged one by one, so
repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import BLANKS, byte_texts, code_points

SYMBOLS = b"#*$%&|<>"
#: ASCII characters that are neither letters nor blanks.
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in BLANKS)
MIN_WORDS = 50
#: Share of posterior from which a text is kept.
KEEP_FROM = 0.5
#: Pseudo-cases of the fit, as a share of all cases.
PSEUDO = 0.003
#: Expected share of good texts that a rule calls bad, and the weight of that belief as a share of all cases.
FALSE_ALARM, BELIEF = 0.005, 1.0

#: Fixed values: (figure, good up to, bad from). A rule abstains in between; one without
#: a "good" bound looks for one kind of junk only and never calls a text good.
RULES = (
    ("symbols_per_word", None, 0.1),
    ("letterless_word_share", None, 0.25),
    ("symbol_run_share", None, 0.1),
    ("duplicate_line_share", None, 0.4),
    ("repeated_word_share", None, 0.5),
    ("stutter_share", None, 0.2),
    ("top_word_share", 0.12, 0.3),
    ("upper_word_share", None, 0.5),
    ("shouted_word_share", None, 0.2),
    ("odd_word_length", 0.0, 4.0),
    ("odd_sentence_length", 0.0, 3.0),
)
FIGURES = [name for name, _, _ in RULES]
#: The vote of a rule that has nothing to go by; it weighs nothing.
NOT_ASKED = 2
#: Rules on what scripts, languages and kinds of text differ in.
HABITS = frozenset(("odd_word_length", "odd_sentence_length"))
#: Figures that are shares of blank-separated words.
TOKEN_SHARES = frozenset(("letterless_word_share", "repeated_word_share", "stutter_share", "top_word_share", "upper_word_share"))
#: Texts with fewer words are only asked for junk: so many finds make a bad vote there, and repeats count so much.
FEW_WORDS, FINDS = 20, 2
SHORT_REPEAT = 5 / 9
#: Usual characters a word and words a sentence.
WORD_LENGTH = (3.0, 8.0)
SENTENCE_LENGTH = (2.0, 40.0)
STOPS = (b".", b"!", b"?")
#: Sentence ends of other scripts: Indic, CJK, Arabic, Armenian, Ethiopic, Burmese, Khmer, Tibetan; the ellipsis.
FAR_STOPS = tuple(c.encode() for c in "।॥。！？｡．؟۔։።፧၊။។៕།…")
#: Letters of scripts that put no blanks between words, their usual number a word, and the bytes that may begin one.
LOOSE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
LOOSE_WORD = 3.0
LOOSE_LEAD = re.compile(b"[\xe0\xe1\xe3-\xe9\xef\xf0]")
RUNS = tuple(bytes([c]) * 3 for c in b"#*$%&|<>=~_-")


def codes(words: list[bytes]) -> np.ndarray:
    """The words as numbers from 0, in order of first use."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def repeat_words(code: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, each word counted once."""
    n = len(code)
    if n < 4:
        return 0
    m = int(code.max()) + 1
    if m >= 1 << 20:  # three numbers no longer fit 63 bits
        pairs = np.unique(code[:-1] * m + code[1:], return_inverse=True)[1]
        key = pairs[:-1] * m + code[2:]
    else:
        key = (code[:-2] * m + code[1:-1]) * m + code[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def measure(data: bytes) -> tuple[list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the votes of a text."""
    words = data.split()
    n = len(words)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    if not n:
        return [0, 0, n_symbols, 0, 0], [NOT_ASKED] * len(RULES)
    chars = code_points(data.translate(None, BLANKS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    code = codes(words)
    n_repeat = repeat_words(code)
    base, full_words, ends = [n, chars, n_symbols, n_dup, n_repeat], float(n), sum(map(data.count, STOPS))
    if not data.isascii():
        ends += sum(map(data.count, FAR_STOPS))
        if LOOSE_LEAD.search(data) and (loose := len(LOOSE.findall(data.decode()))):
            tied = sum(LOOSE.search(w.decode()) is not None for w in words)
            full_words, ends = n - tied + loose / LOOSE_WORD, max(ends, tied)  # their blanks end phrases
    runs, stutters, shouts = sum(map(data.count, RUNS)), int(np.count_nonzero(code[1:] == code[:-1])), data.count(b"!!")
    if full_words < FEW_WORDS:
        finds = {"symbols_per_word": (n_symbols, n), "symbol_run_share": (runs, n), "duplicate_line_share": (n_dup, len(lines)),
                 "repeated_word_share": (n_repeat * SHORT_REPEAT, n), "stutter_share": (stutters, n), "shouted_word_share": (shouts, n)}
        return base, [-1 if name in finds and finds[name][0] >= max(FINDS, bad * finds[name][1]) else NOT_ASKED for name, _, bad in RULES]
    # lines of verse and lists end as sentences do
    length, sentence = chars / full_words, full_words / max(1, ends, len(lines))
    figures = (
        n_symbols / full_words, 1 - len(data.translate(None, NO_LETTERS).split()) / n, runs / full_words, n_dup / len(lines),
        n_repeat / n, stutters / n, float(np.bincount(code).max()) / n, sum(map(bytes.isupper, words)) / n,
        shouts / full_words, max(WORD_LENGTH[0] - length, length - WORD_LENGTH[1], 0.0),
        max(SENTENCE_LENGTH[0] / sentence, sentence / SENTENCE_LENGTH[1], 1.0) - 1)
    votes = [-1 if f >= bad else 1 if good is not None and f <= good else 0
             for f, (_, good, bad) in zip(figures, RULES, strict=True)]
    if n < FEW_WORDS:  # too few tokens for shares of tokens
        votes = [NOT_ASKED if name in TOKEN_SHARES else v for v, name in zip(votes, FIGURES, strict=True)]
    return base, votes


def pattern_of(votes: list[int]) -> int:
    """Votes as one number in base 4."""
    out = 0
    for v in votes:
        out = out * 4 + v + 1
    return out


def votes_of(pattern: np.ndarray) -> np.ndarray:
    """Inverse of :func:`pattern_of`: (patterns, rules) of vote + 1."""
    powers = 4 ** np.arange(len(RULES) - 1, -1, -1)
    return pattern[:, None] // powers % 4


def silent(votes: np.ndarray) -> np.ndarray:
    """Whether no rule votes in a row of :func:`votes_of`."""
    return ((votes == 1) | (votes == NOT_ASKED + 1)).all(1)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def signals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five base figures and the vote pattern of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [measure(t) for t in byte_texts(batch.column(1))]
            base = np.array([s[0] for s in seen], np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(base[:, i]) for i in range(len(BASE))],
                 pa.array([pattern_of(s[1]) for s in seen], pa.int32())], ["doc_id", *BASE, "pattern"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in BASE)}, pattern int")


class Model:
    """Class prior and, per rule, the chance of each vote on usual good (0), bad (1) and other good (2) texts.

    Other good texts have no junk, but words or sentences of a length of their own.
    """

    def __init__(self) -> None:
        both = [[0.01, 0.19, 0.8, 1.0], [0.3, 0.4, 0.3, 1.0]]  # bad vote, abstain, good vote, not asked
        hunts = [[0.01, 0.99, 1e-9, 1.0], [0.3, 0.7, 1e-9, 1.0]]  # of rules that never vote good
        self.prior = np.array([0.85, 0.1, 0.05])
        self.chance = np.array([[*rows, [0.5, 0.25, 0.25, 1.0] if name in HABITS else rows[0]]
                                for name, good, _ in RULES for rows in [hunts if good is None else both]])

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of a good text for each pattern; without any vote it is the prior."""
        votes = votes_of(np.asarray(pattern, np.int64))
        return np.where(silent(votes), 1 - self.prior[1], 1 - self._classes(votes)[:, 1])

    def _classes(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior) + sum(np.log(self.chance[j][:, votes[:, j]]).T for j in range(len(RULES)))
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)

    def fit(self, pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> "Model":
        """EM over pattern counts, with a few pseudo-cases per class and vote.

        Patterns without any vote take no part.

        The false alarms of a rule are estimated as well, with a belief that they are few
        (none for the habits of other good texts): a source of clean texts that a rule's
        bounds do not fit may be any share of all.
        """
        votes, count = votes_of(np.asarray(pattern, np.int64)), np.asarray(count, np.float64)
        count = np.where(silent(votes), 0.0, count)
        few, belief = 1 + PSEUDO * count.sum(), BELIEF * count.sum()
        for _ in range(rounds if len(count) else 0):
            weight = self._classes(votes) * count[:, None]
            self.prior = (weight.sum(0) + 1) / (weight.sum() + 3)
            for j in range(len(RULES)):
                sums = np.stack([np.bincount(votes[:, j], weight[:, c], minlength=4)[:3] for c in range(3)]) + few
                for c in (0,) if FIGURES[j] in HABITS else (0, 2):
                    share = self.prior[c] / (1 - self.prior[1])
                    sums[c] += belief * share * np.array([FALSE_ALARM, *((1 - FALSE_ALARM) * sums[c, 1:] / sums[c, 1:].sum())])
                self.chance[j, :, :3] = sums / sums.sum(1, keepdims=True)
        return self


def estimate(signal: DataFrame) -> Model:
    """Fits the model to the vote patterns of all rows."""
    rows = sorted(signal.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each pattern
    return Model().fit(np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows]))


def posterior_column(model: Model, pattern: Column, n_words: Column) -> Column:
    """The posterior as a column: prior and vote log odds through the logistic function."""
    digit = [F.shiftright(pattern, 2 * (len(RULES) - 1 - j)).bitwiseAND(F.lit(3)) for j in range(len(RULES))]
    sides = []
    for c in (0, 2):  # both kinds of good texts against bad ones
        odds = F.lit(float(np.log(model.prior[c] / model.prior[1])))
        for j, d in enumerate(digit):
            bad, none, good = (float(x) for x in np.log(model.chance[j][c, :3] / model.chance[j][1, :3]))
            odds = odds + F.when(d == 0, F.lit(bad)).when(d == 1, F.lit(none)).when(d == 2, F.lit(good)).otherwise(F.lit(0.0))
        sides.append(F.exp(odds))
    # votes are even digits: 0 (bad) and 2 (good)
    voting = F.lit(sum(4 ** j for j in range(len(RULES))))
    return (F.when(n_words == 0, F.lit(0.0)).when(pattern.bitwiseAND(voting) == voting, F.lit(float(1 - model.prior[1])))
            .otherwise(1 - 1 / (1 + sides[0] + sides[1])))


def judge(signal: DataFrame, model: Model) -> DataFrame:
    """Adds base_failed, the posterior and the verdict to :func:`signals`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (signal.withColumn("posterior", posterior_column(model, F.col("pattern"), F.col("n_words")))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)))


def keep_good(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the model takes for good, whatever their length."""
    model = estimate(signals(docs, docs.columns[0], text))
    at = docs.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [measure(t) for t in byte_texts(batch.column(at))]
            words = np.array([s[0][0] for s in seen], np.int64)
            good = model.posterior(np.array([pattern_of(s[1]) for s in seen], np.int64)) >= keep_from
            yield batch.filter(pa.array(good & (words > 0)))

    return docs.mapInArrow(step, docs.schema)
