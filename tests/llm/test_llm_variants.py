"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from slicewise.llm import variants
from slicewise.llm.queries import QUERIES
from slicewise.session import table

SF = "/root/testdata/sf0.01"


def count(docs):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def brute(words):
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for (_, rest), group in holes.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda o: (-words[o], o))
            if words[best] >= 5 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows(QUERIES["op11_spelling_variants"](spark, SF)) == brute(count(docs))


@pytest.mark.parametrize("part_words", [20_000, 40])
def test_grouping(spark, part_words):
    """Dense neighbourhoods, frequent beginnings that fill several parts, the last letter of the alphabet, very long words."""
    rng = random.Random(11)
    words = {}
    for letters, low, high, many in (("ab", 6, 9, 300), ("abÿ", 6, 7, 300), ("ÿ", 6, 12, 30), ("étude", 6, 8, 100)):
        for _ in range(many):
            words["".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))] = rng.choice([5, 6, 25, 30, 125, 700, 4000])
    for _ in range(300):
        words["aaa" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 5)))] = rng.choice([5, 25, 625])
    words |= {"x" * 5000: 5, "x" * 5001: 30, "x" * 4999 + "y": 7, "y" + "x" * 4999: 800, "×÷×÷×÷": 9, "×÷×÷×": 50}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    table_of = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert rows(variants.group(table_of, part_words)) == brute(words)


def test_odd_rows(spark):
    docs = [(i, "Straßenbahn straßenbahn STRASSENBAHN Éclair éclair ÉCLAIR abcdefg_abcdefh abcdef7 Ångström") for i in range(20)]
    docs += [(None, "Éclair " * 7 + "中中eclair中 abcdefgh"), (None, "Éclair " * 7), (3, None), (4, ""), (5, "a b c 123"), (6, "longword" * 9000), (6, "longword" * 9000)]
    docs += [(7, "longword" * 9000)] * 3 + [(i, " ".join(["receive"] * 90 + ["recieve"] * 5 + ["recive", "receves"])) for i in range(300)]
    frame = spark.createDataFrame([(*d, None, None) for d in docs], "doc_id bigint, text string, word string, n int").repartition(4)
    got = rows(variants.group(variants.counted(frame)))
    assert got == brute(count(docs)) and any(r[1] == "receive" for r in got)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(variants.group(variants.counted(frame))) == []
    frame = spark.createDataFrame([(1, None), (None, "one two")], "doc_id bigint, text string")
    assert rows(variants.group(variants.counted(frame))) == []
