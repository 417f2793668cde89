"""Benchmark decontamination against brute force, on the small table and on made-up rows."""

from __future__ import annotations

import hashlib
import random
import re

from slicewise.llm import decontam
from slicewise.llm.queries import QUERIES
from slicewise.session import table

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add("" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in texts:
        w, hit, held = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i:i + m])):
                    held |= found
                    hit |= set(range(i, i + m))
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = QUERIES["op13_decontamination"](spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts, items)


DOCS = "doc_id bigint, text string, key string, x bigint, m int, wid bigint, item string"
ITEMS = "item_id bigint, text string, window string, k int"


def run(spark, texts, items):
    docs = spark.createDataFrame([(*t, None, None, None, None, None) for t in texts], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, None, None) for i in items], ITEMS)
    return sorted(map(tuple, decontam.digests(decontam.contamination(docs, bench)).collect()), key=str)


def test_odd_rows(spark):
    rng = random.Random(4)
    alphabet = "aa bb Cc dd É ÉE 7 x9 中 \U0001f600a".split()
    line = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 15, 30]))) for i in range(40)]
    items += [(None, "null id here"), (3, "second text of three"), (3, None), (50, ""), (51, "?!"), (52, "one " * 30), (53, "Null-ID; here")]
    texts = [(i, line(rng.randrange(60))) for i in range(60)]
    texts += [(100, items[5][1] + " " + items[6][1]), (101, "ONE one, " * 9 + "two " + "one " * 12), (102, "null\tid\nhere"), (102, "null\tid\nhere"), (103, None),
              (104, ""), (None, items[9][1].upper()), (None, items[9][1].upper()), (105, "word " * 60_000 + items[10][1] + " tail"), (106, "second text of\x7fthree")]
    texts += [(200 + i, "same copy " + items[8][1]) for i in range(50)]
    assert run(spark, texts, items) == brute(texts, items)


def test_only_long_items(spark):
    """One length of shingles; a shared passage; words at both ends of a text."""
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(1, passage), (2, "q " * 12), (3, "head " + passage)]
    texts = [(1, passage), (2, "a " + passage + " b"), (3, " ".join(passage.split()[:10])), (4, " ".join(passage.split()[1:10])), (5, passage + " " + passage), (6, "q " * 11)]
    assert run(spark, texts, items) == brute(texts, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (2, None)], []) == brute([(1, "a b c"), (2, None)], [])
