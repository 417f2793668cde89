"""Quality rules on clean texts of other habits and on short junk."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from slicewise.llm import quality
from slicewise.session import table

SF = "/root/testdata/sf0.01"


def pattern(text):
    return quality.pattern_of(quality.measure((text or "").encode())[1])


@pytest.fixture(scope="module")
def labelled(spark):
    """(text, quality or None) of the table."""
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    return [(r.text, label.get(r.doc_id)) for r in table(spark, SF, "documents").collect()]


def made(letters, length, blank, end, rng, n=90):
    """n words of random letters; ``end`` closes every 12th."""
    out = ""
    for i in range(n):
        out += "".join(rng.choice(letters) for _ in range(rng.randint(*length))) + (end if i % 12 == 11 else blank)
    return out


KINDS = {
    "hindi": ("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", (2, 6), " ", "। "),
    "thai": ("กขคงจฉชซญดตถทนบปผพมยรลวสหอ", (3, 6), "", " "),
    "chinese": ([chr(c) for c in range(0x4E00, 0x5200)], (1, 3), "", "。"),
    "verse": ("aeiounrtslm", (2, 8), " ", "\n"),
    "no stops": ("aeiounrtslm", (3, 7), " ", " "),
    "long words": ("aeiounrtslmkpv", (12, 18), " ", ". "),
    "long words, no stops": ("aeiounrtslmkpv", (12, 18), " ", " "),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("share", [0.03, 0.1, 1 / 3])
def test_clean_source_of_other_habits(labelled, kind, share):
    rng = random.Random(5)
    one = [made(*KINDS[kind], rng, n=600 if kind == "chinese" else 170) for _ in range(round(len(labelled) * share / (1 - share)))]
    counts = Counter(map(pattern, one + [t for t, _ in labelled]))
    keys = np.array(sorted(counts))
    model = quality.Model().fit(keys, np.array([counts[p] for p in keys]))
    kept = lambda texts: float(np.mean(model.posterior(np.array([pattern(t) for t in texts])) >= quality.KEEP_FROM))
    assert kept(one) > 0.98
    assert kept([t for t, q in labelled if q == 1]) > 0.98
    assert kept([t for t, q in labelled if q == 0 and len(t.split()) >= 20]) < 0.1


def test_short_junk_is_rejected(spark, labelled):
    texts = ["Ourere | ertible | thheedre. |", "dota dota que que", "BUY!! NOW!! CHEAP!! OFFER!!", "go ### to *** it %%% so", "la la la la la la la"]
    clean = ["A short clean note.", "OK", "R&D plans for May.", "Price: $5", "USA 1990", "Wow!! It works.", "no no, not that one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in labelled] + texts + clean)], "doc_id bigint, text string")
    kept = {r.text for r in quality.keep_good(docs).collect()}
    assert not kept & set(texts) and set(clean) <= kept


def test_short_junk_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    short = [r for r in docs.collect() if 0 < len((r.text or "").split()) < quality.FEW_WORDS]
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    bad = [r.doc_id for r in short if r.quality == 0]
    good = [r.doc_id for r in short if r.quality == 1]
    # two of the labelled ones look like any clean text: 'Laèoueau la ment est éailele.', a telephone number
    assert sum(d not in kept for d in bad) >= len(bad) - 2 and set(good) <= kept
