"""Operators against brute force on the whole small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from compare import compare, connect

from slicewise.llm import bpe, maxent, mixing, neardup, quality
from slicewise.llm.queries import QUERIES, vocabulary
from slicewise.llm.sql import SQL
from slicewise.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents").collect()


def by_id(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == []


def words(text):
    return (text or "").encode().split()


def test_mix_meets_its_targets(spark):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    total, taken, targets = sum(r.size for r in rows), Counter(), {}
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and all(r.position is None for r in rows[len(positions):])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target, r.source_size] += r.taken
        targets[r.target, r.source_size] = r.target
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * total, rel=1e-3)
    per_source = defaultdict(int)
    for r in table(spark, SF, "documents").join(QUERIES["op1_mixing"](spark, SF), "doc_id").select("source", "taken", "target").collect():
        per_source[r.source, r.target] += r.taken
    assert all(n == math.floor(t) for (_, t), n in per_source.items())


def test_language_model(spark, documents):
    got = by_id(spark, "op2_lm_scoring")
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in documents}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    unseen = [d for d in tokens if held[d]]
    assert sum(got[d].score for d in unseen) > sum(got[d].base_score for d in unseen)


def test_language_model_gains_on_unseen_texts(spark):
    """Better than the base by a margin a token, more so on the larger corpus."""
    for sf, margin in ((SF, 0.01), ("/root/testdata/sf0.01", 0.06)):
        unseen = [r for r in QUERIES["op2_lm_scoring"](spark, sf).collect() if r.held_out]
        assert sum(r.score - r.base_score for r in unseen) > margin * sum(r.n_tokens for r in unseen)


def test_language_model_is_normalised(spark, documents):
    """In any context the probabilities of all known words and of one unknown word a slot sum to one."""
    texts = table(spark, SF, "documents").select("text")
    seen = maxent.first_pass(texts)
    counts = maxent.word_counts(seen)
    model = maxent.train(texts, seen, counts)
    first, second, slot_log = model.tables()
    per_slot = defaultdict(list)
    for r in counts.collect():
        per_slot[r.slot].append(r.n)
    for near, far, last, group in ((0, 0, 0, 0), (17, 5, 3, 2), (255, 63, 31, 7)):
        total = 0.0
        for slot in range(maxent.SLOTS):
            own = first[near, far, model.slot_class[slot]] + second[last * maxent.FAR_CLASS + group, slot] + slot_log[slot]
            total += 10 ** own * (sum(n + 1 for n in per_slot[slot]) + 1)
        assert total == pytest.approx(1, rel=1e-3)


def test_fingerprints(spark, documents):
    got = by_id(spark, "op3_fingerprints")
    order = sorted(documents, key=lambda r: -r.doc_id)

    def jaccard(a, b):
        a, b = Counter(words(a)), Counter(words(b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    errors, seen = [], {}
    for r, following in zip(order, [*order[1:], order[0]], strict=True):
        half = len(r.text) // 2
        edited = r.text[:len(r.text) - half] + following.text[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_edited == sum(g.fingerprint[i:i + 8] == g.edited_fingerprint[i:i + 8] for i in range(0, len(g.fingerprint), 8)) / 32
        errors.append(g.near_edited - jaccard(r.text, edited))
        assert seen.setdefault(r.text, g.fingerprint) == g.fingerprint
    assert abs(sum(errors) / len(errors)) < 0.03
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.12


def repeated(w):
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    return len(inside)


def test_quality_figures(spark, documents):
    got = by_id(spark, "op5_quality_rules")
    for r in documents:
        text, w = r.text or "", words(r.text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(w))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * want[4] > 50 * len(w))
        assert not (g.kept and g.base_failed)


def test_quality_verdict_agrees_with_labels(spark):
    rows = table(spark, "/root/testdata/sf0.01", "labels").join(
        QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01"), "doc_id").select("quality", "posterior").collect()
    good = [r.posterior >= 0.5 for r in rows if r.quality == 1]
    bad = [r.posterior < 0.5 for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) > 0.9


def test_posterior_column_is_the_models(spark):
    signal = quality.signals(table(spark, SF, "documents"))
    model = quality.estimate(signal)
    rows = quality.judge(signal, model).filter("n_words > 0").collect()
    import numpy as np
    want = model.posterior(np.array([r.pattern for r in rows]))
    assert [r.posterior for r in rows] == pytest.approx(list(want))


def library():
    import tiktoken
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, documents):
    encoding, got = library(), by_id(spark, "op6_byte_bpe")
    for r in documents:
        ids = encoding.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_on_random_and_very_long_pieces():
    encoding, codec = library(), bpe.Codec.load(*vocabulary())
    rng = random.Random(3)
    alphabets = ["ab", "aaaa", "etaoin shrdlu", "éüß中😀 \n\t", "0123456789", "!?<>#\"' "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 3, 8, 30, 300]))) for _ in range(800)]
    texts += ["x" * 20_000, "ab" * 10_000, "".join(rng.choice("abcde") for _ in range(30_000)), ""]
    found = codec.encode(texts)
    assert found == [encoding.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in found] == [t.encode() for t in texts]


def brute_groups(texts: dict, k: int, percent: int) -> tuple[dict, dict]:
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in holders[s])
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in sets}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_duplicates(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    component, size = brute_groups(texts, 3, 85)
    got = QUERIES["op8_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (size[d], component[d], component[d] == d) for d in texts}


def test_near_duplicates_that_only_chain(spark):
    """A chain of texts, each alike to its neighbours only, some linked through no hub, and a large group of copies."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(60):
        w = list(base)
        for j in range(i):
            w[(j * 5) % 300] = f"x{j}"
        texts[1000 - i] = " ".join(w)
    for i in range(300):
        w = [f"y{j}" for j in range(200)]
        w[rng.randrange(200)] = f"z{i}"
        texts[2000 + i] = " ".join(w)
    component, size = brute_groups(texts, 3, 85)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in neardup.groups(rows, 3, 85).collect()}
    assert got == component
    assert len(set(got.values())) < 10


def test_likelihood_estimates_similarity():
    import numpy as np
    rng = np.random.RandomState(1)
    for share in (0.3, 0.85):
        common = rng.randint(0, 1 << 62, 400).astype(np.uint64)
        extra = int(400 * (1 - share) / share / 2)
        errors = []
        for _ in range(30):
            a, b = (np.unique(np.concatenate((common, rng.randint(0, 1 << 62, extra).astype(np.uint64)))) for _ in range(2))
            common = rng.randint(0, 1 << 62, 400).astype(np.uint64)
            a = np.unique(np.concatenate((common, rng.randint(0, 1 << 62, extra).astype(np.uint64))))
            b = np.unique(np.concatenate((common, rng.randint(0, 1 << 62, extra).astype(np.uint64))))
            x, y = neardup.registers(a), neardup.registers(b)
            got = neardup.likeness(np.array([len(a)]), np.array([len(b)]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0]
            errors.append(got - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_sketches_merge():
    import numpy as np
    a, b = np.arange(1, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(500, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.unique(np.concatenate((a, b)))
    assert (neardup.registers(both) == np.maximum(neardup.registers(a), neardup.registers(b))).all()


def test_language(spark, documents):
    got = by_id(spark, "op9_language_id")
    for r in documents:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= got[r.doc_id].score <= 1
    unseen = [r for r in documents if got[r.doc_id].held_out and any(map(str.isalpha, r.text or ""))]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in unseen) >= 0.97 * len(unseen)


def test_licences(spark, documents):
    got = by_id(spark, "op10_license_scan")
    planted = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    assert len(got) == len(documents)
    for r in documents:
        want = sorted({f for line, f in planted.items() if line in (r.text or "")})
        assert [f for f in got[r.doc_id].families.split(",") if f] == want


def test_schedule_inverts(spark):
    """Positions follow from the running integral of a schedule with three knots."""
    from pyspark.sql import functions as F
    knots = [(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)]
    rows = spark.createDataFrame([(knots, a / 20) for a in range(0, 35)], "knots array<struct<t:double,w:double>>, area double")
    out = rows.select("area", mixing.time_of(F.col("area"), mixing.segments(F.col("knots"))).alias("t"), mixing.integral(F.col("knots")).alias("all")).collect()
    for r in out:
        t = r.t
        area = t + 2 * t * t if t <= 0.5 else 1.0 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2
        assert r["all"] == pytest.approx(1.75) and area == pytest.approx(r.area, abs=1e-9)
