"""The pipeline against stages computed by brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
from test_llm_exact import brute_groups, library

import corpus_pipeline
from slicewise.llm import langid, quality
from slicewise.llm.common import id_crc
from slicewise.session import table

SF = "/root/testdata/sf0.001"


def mixed(docs):
    """Copies of each document: queue by digest, targets by repeated sharing."""
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    names = sorted({r.source for r in docs if r.source is not None}) + [None] * any(r.source is None for r in docs)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = Counter()
    for r in docs:
        total[r.source] += size[r.doc_id]
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    queues, copies = defaultdict(list), Counter()
    for r in docs:
        queues[r.source].append((md5(f"mix/{r.doc_id}".encode()).hexdigest(), r.doc_id))
    for s, queue in queues.items():
        at = 0
        for _ in range(2):
            for _, d in sorted(queue):
                copies[d] += size[d] > 0 and at < math.floor(target[s])
                at += size[d]
    return copies


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents").collect()
    seen = [quality.measure((r.text or "").encode()) for r in docs]
    counts = Counter(quality.pattern_of(s[1]) for s in seen)
    model = quality.Model().fit(np.array(sorted(counts)), np.array([counts[p] for p in sorted(counts)]))
    docs = [r for r, s in zip(docs, seen, strict=True) if s[0][0] and model.posterior(np.array([quality.pattern_of(s[1])]))[0] >= 0.5]
    docs = [r for r in docs if any(map(str.isalpha, r.text))]
    component, _ = brute_groups({r.doc_id: r.text for r in docs}, 5, 80)
    docs = [r for r in docs if component[r.doc_id] == r.doc_id]
    want, encoding = mixed(docs), library()
    assert Counter(r.doc_id for r in got) == +want
    ids = {r.doc_id: r.ids for r in got}
    texts = {r.doc_id: r.text for r in docs}
    assert set(ids) <= set(texts)
    assert all(ids[d] == encoding.encode_ordinary(texts[d]) for d in ids)


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "near duplicates", "source mix", "byte bpe"]


def test_language_stage_keeps_close_languages(spark):
    """Two labels for one language: every text is ambiguous, none goes but those without letters."""
    text = "The fox met a hen near the river and they walked on for a while, {}."
    rows = [(i, text.format(i % 7), ("en", "en-GB")[i % 2]) for i in range(80)] + [(100, "12345 678", "en"), (101, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, id_crc("doc_id") % 5 != 0)
    assert langid.identify(docs, model).filter("ambiguous and doc_id < 100").count() > 0
    kept = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(80))


def test_language_stage_is_exact(spark):
    docs = table(spark, SF, "documents")
    want = Counter(r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or "")))
    assert Counter(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == want
