"""Bit weights, dealing and decoding of language identification against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.llm import langid
from slicewise.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(table(spark, SF, "documents"), F.lit(True))


def decode(model, text):
    """Language and probability, language by language and bit by bit."""
    x = langid.features(text).astype(np.float64)
    losses = []
    for word in model.code:
        losses.append(sum(w * np.log1p(np.exp(-bit * float(x @ model.weights[:, i].astype(np.float64))))
                          for i, (bit, w) in enumerate(zip(word, model.bit_weights))))
    chance = np.exp(-np.array(losses) + min(losses))
    return model.languages[int(np.argmin(losses))], float(chance.max() / chance.sum())


def test_decoding_equals_brute_force(spark, model):
    docs = table(spark, SF, "documents").filter("text is not null").orderBy("doc_id")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect()[::5]:
        if langid.has_letter(r.text):
            name, chance = decode(model, r.text)
            assert got[r.doc_id].lang_pred == name and got[r.doc_id].score == pytest.approx(chance, abs=1e-4)


def test_bit_weights_come_from_other_rows(spark):
    rng = np.random.default_rng(3)
    code = np.array([[1, 1, -1], [-1, 1, 1]], np.float32)
    weights = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    rows = [(i, f"word{i} of text {i * i}", i % 2) for i in range(60)]
    kind = "doc_id bigint, text string, label int"
    ready = langid.sample_features(spark.createDataFrame(rows, kind).select(
        "label", "text", F.lit(1.0).alias("weight"), (F.col("doc_id") % 3 == 0).alias("kept"), F.col("doc_id").alias("deal")))
    got = langid._reliability(ready.filter("kept").drop("deal"), code, weights)
    right = np.mean([[f * b > 0 for f, b in zip(langid.features(t) @ weights, code[y])] for i, t, y in rows if i % 3 == 0], axis=0)
    share = (right * 20 + 0.5) / 21
    assert got == pytest.approx(np.clip(np.log(share / (1 - share)), 0.2, 4.0), rel=1e-6)
    assert langid._reliability(ready.filter("false").drop("deal"), code, weights) == pytest.approx(np.full(3, 0.2))


def test_a_language_with_one_text_is_learned(spark):
    rows = [(i, f"der hund und die katze gehen {i} mal heim", "de") for i in range(40)] + [(99, "όλα τα παιδιά πάνε στο σχολείο", "el")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert model.predict("τα παιδιά")[0] == "el" and model.predict("die katze")[0] == "de"


def test_a_round_of_the_fit_has_few_partitions_however_the_sample_was_dealt(spark, monkeypatch):
    """Every partition sends a gradient as large as the weights to the driver."""
    seen = []
    whole = langid.descend
    monkeypatch.setattr(langid, "descend", lambda table, *a: seen.append(table.rdd.getNumPartitions()) or whole(table, *a))
    monkeypatch.setattr(langid, "durable", lambda df, name: df.repartition(64))
    monkeypatch.setattr(langid, "ROUNDS", 1)
    docs = spark.createDataFrame([(i, f"word{i} text{i % 7}", "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, lang string")
    langid.train(docs, F.lit(True))
    assert seen and max(seen) <= langid.PARTS
