"""Filter audit against brute force: every order is really run over every document."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

from slicewise.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, key binary, mask int, least bigint, part string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(docs):
    texts = [(i, t or "", s or "") for i, t, s in docs]
    out = []
    for i, t, s in texts:
        w = WORDS.findall(t)
        again = i is not None and any(o is not None and o < i and u == t for o, u, _ in texts)
        out.append((i, s, {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search(r"[#$%&*|]", t) is not None, again), strict=True) if bad}))
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts, rows, shapley = defaultdict(list), [], defaultdict(int)
    for i, s, bad in fails(docs):
        parts[s].append((i, bad))
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, c in enumerate(order, 1):
                gone = [m for m in left if c in m[1]]
                left = [m for m in left if c not in m[1]]
                failing = [m for m in members if c in m[1]]
                shapley[part, c] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                             sum(m[1] == {c} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), c))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in rows)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, None, None, None, None) for d in docs], DOCS).repartition(4),
            spark.createDataFrame([(*x, None) for x in labels], LABELS))


def run(spark, docs, labels):
    d, x = frames(spark, docs, labels)
    return sorted(map(tuple, audit.audit(audit.masks(d), x).select(*NAMES).collect()))


def made_up():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "x#", "CAPS"]
    texts = [" ".join(rng.choices(vocabulary[rng.randrange(290):], k=rng.randrange(150, 420))) for _ in range(40)]
    texts += ["", None, "short", "A" * 10, "é" * 98 + "AA", "é" * 97 + "AAA", "a|b", " \n ", "word " * 40_000, " ".join(vocabulary[:200]), " ".join(vocabulary[:199])]
    docs = [(rng.randrange(400), rng.choice(texts), rng.choice(["a", "b", None, "", "hot"])) for _ in range(300)]
    docs += [(None, texts[0], "a"), (None, None, "b"), (-3, texts[0], "hot"), *[(1000 + i, texts[1], "hot") for i in range(100)], (7, texts[2], "a"), (7, texts[2], "a")]
    labels = [(rng.randrange(400), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    return docs, labels


def test_every_order(spark):
    docs, labels = made_up()
    assert run(spark, docs, labels) == brute(docs, labels)


def test_small_tries_and_ranges(spark, monkeypatch):
    """Tries that are emptied all the time and prefixes that must grow give the same masks."""
    rng = random.Random(2)
    head = "the same long beginning of every text, again and again, " * 30
    docs = [(i, head + rng.choice("abc") * rng.randrange(4) + f"{rng.randrange(60)}", "a") for i in range(600)] + [(900, head, "a"), (901, head[:20], "a")]
    d, _ = frames(spark, docs, [])
    read = audit.read(d, "doc_id", "text", "source").filter("text IS NOT NULL").select("text", "least", "rows", "size").cache()
    parts = audit.ranged(read, 4_000).rdd.glom().map(lambda rows: [r.text for r in rows]).collect()
    assert sum(bool(p) for p in parts) > 20  # the shared beginning is cut further
    seen = [t for p in parts for t in set(p)]
    assert len(seen) == len(set(seen)) and all(p == sorted(p) for p in parts)
    got = {r.doc_id: r["mask"] >> 4 for r in audit.masks(d).collect()}
    assert got == {i: int("E" in bad) for i, _, bad in fails(docs)}


def test_trie():
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(3000)]
    trie, want = audit.Trie(), {}
    for i, t in enumerate(texts):
        least = None if i % 7 == 0 else rng.randrange(-50, 50)
        trie.insert(t, least, 2)
        known = [x for x in (want.get(t, (None, 0))[0], least) if x is not None]
        want[t] = (min(known) if known else None, want.get(t, (None, 0))[1] + 2)
    assert list(trie.terminals()) == [(t, *want[t]) for t in sorted(want)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    docs = [(1, "a b", "x"), (2, None, None)]
    assert run(spark, docs, []) == brute(docs, [])
