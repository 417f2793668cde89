"""Notices broken over lines and notices inside long lines."""

from __future__ import annotations

import textwrap

import pytest

from slicewise.llm import licenses
from slicewise.session import table

PROSE = "The fox met a hen near the river, and they walked on for a while under the old trees of the park. "


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark, table(spark, "/root/testdata/sf0.001", "documents"))


def test_wrapped_and_diluted_notices(spark, model):
    rows, want = [], {}
    for i, (family, notice) in enumerate(licenses.NOTICES):
        commented = "\n".join(f"# {x}" for x in textwrap.wrap(notice, 40))
        for k, text in enumerate((textwrap.fill(notice, 40), "Title\n\n" + commented + "\n\n" + PROSE, PROSE * 30 + notice + " " + PROSE * 30,
                                  PROSE * 3 + "\n" + textwrap.fill(notice, 60) + "\n" + PROSE * 3)):
            rows.append((10 * i + k, text))
            want[10 * i + k] = family
    rows += [(-1, PROSE * 60), (-2, "\n".join(textwrap.wrap(PROSE * 9, 50)))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), *model).collect()}
    assert {i: (want[i], got[i].families) for i in want if want[i] != got[i].families} == {}
    assert got[-1].families == got[-2].families == "" and got[-1].n_paragraphs == 1
    assert got[1].n_paragraphs == 3


def test_the_sample_reaches_the_last_lines(spark):
    texts = [(i, "\n".join(f"line{i}x{j} of a text" for j in range(40))) for i in range(50)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert licenses.sampled_lines(docs, "text").filter("size(words) > 0").count() == 2000  # fewer than CORPUS_SAMPLE: all
    repeated = docs.filter("doc_id < 3").crossJoin(spark.range(20)).drop("id")
    assert licenses.sampled_lines(repeated, "text").count() == 120


def test_sample_is_bounded_and_long_lines_are_cut(spark):
    docs = spark.range(8).selectExpr("id doc_id", "array_join(transform(sequence(1, 5000), i -> concat('w', id, 'v', i, ' here')), '\n') text")
    assert 2000 < licenses.sampled_lines(docs, "text").count() < 4000
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9000)))], "doc_id bigint, text string")
    assert [len(r.words) for r in licenses.sampled_lines(long, "text").collect()] == [licenses.WINDOW]


def test_prediction_equals_brute_force(spark, model):
    import numpy as np

    fit, threshold = model
    texts = [n for _, n in licenses.NOTICES] + [PROSE, "license of the house", "free software"]
    rows = licenses.featured(spark.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.words(licenses.F.col("text")).alias("words"))
                             .withColumn("pairs", licenses.pairs(licenses.F.col("words"))))
    weights, shift = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    for r in fit.transform(rows).collect():
        assert set(r.features.values) <= {1.0} and len(r.features.indices) <= len(set(r.words)) + len(set(r.pairs))
        margin = weights[:, r.features.indices].sum(axis=1) + shift
        chance = np.exp(margin - margin.max())
        assert np.allclose(r.probability.toArray(), chance / chance.sum())


def test_the_fit_and_the_threshold_meet_every_line(spark):
    """Also of a corpus with many more lines than a sample has: 40,000 lines, some rare ones near a notice."""
    docs = spark.range(8).selectExpr("id doc_id", """array_join(transform(sequence(1, 5000), i -> concat('w', id, 'v', i,
        if(i % 97 = 0, ' licensed under the terms of the house', ' of the river'))), '\n') text""")
    notice = spark.createDataFrame([(99, "a b\nReleased under the MIT License.\n\n" + "word " * 9)], "doc_id bigint, text string")
    lines = licenses.coded_segments(docs.unionAll(notice))
    corpus = licenses.corpus_rows(lines)
    assert corpus.agg(licenses.F.sum("n")).first()[0] == 40_002  # all but the notice and its passage
    assert corpus.count() < 20
    fit, threshold = licenses.fit(lines)
    held = fit.transform(licenses.hashed(corpus.filter("held_out"))).collect()
    total = sum(r.n for r in held)
    assert 9_000 < total < 11_000
    reach = lambda t: sum(r.n for r in held if 1 - r.probability[0] >= t)
    odds = licenses.math.log(threshold / (1 - threshold)) - 1.01 / licenses.STEPS
    assert reach(threshold) <= licenses.FALSE_ALARM * total
    assert threshold == 0.5 or reach(1 / (1 + licenses.math.exp(-odds))) > licenses.FALSE_ALARM * total
    found = {r.doc_id: r for r in licenses.scan(notice, fit, threshold).collect()}
    assert found[99].families == "MIT" and found[99].n_paragraphs == 2
