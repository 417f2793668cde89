"""Nulls, empty and long texts, repeats, clashing columns and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from slicewise.llm import bpe, extraction, fingerprints, langid, licenses, maxent, mixing, neardup, quality, warc
from slicewise.llm.common import id_crc
from slicewise.llm.queries import vocabulary
from slicewise.session import fresh_path

_NAMES = "fox hen dog cat owl cow pig rat bee ant elk emu".split()
PROSE = " ".join(f"The {a} met a {b} near the {c}, and they walked on. " for a, b, c in zip(_NAMES, _NAMES[5:] + _NAMES[:5], _NAMES[7:] + _NAMES[:7], strict=True))
LONG = " ".join(f"word{i % 977} and, then." for i in range(12_000))
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row bigint, node bigint, label int, "
          "words string, n_words int, pattern int, key string, cut string, ids string, `range` int, copies int, digest string, html2 string")
PLAIN = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "", 0),
    (5, " \n\t ", None, "b", 4), (6, LONG, "en", "b", 9), (None, PROSE + "extra", "en", None, 7), (7, "x" * 50_000, None, "c", 5),
    (8, "12345 678", "de", "c", 9), (9, "Der Hund und die Katze gehen durch den Wald. " * 9, "de", "c", 9), (-5, "é中\U0001f600 ok", "fr", "d", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[None] * 14) for r in PLAIN], SCHEMA).repartition(3).checkpoint(eager=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def run(name, docs, spark):
    if name == "mix":
        return mixing.mix(docs)
    if name == "score":
        return maxent.score(docs, id_crc("doc_id") % 7 == 2)
    if name == "compare":
        return fingerprints.compare(docs)
    if name == "judge":
        signal = quality.signals(docs)
        return quality.judge(signal, quality.estimate(signal))
    if name == "digests":
        return bpe.digests(docs, *vocabulary())
    if name == "groups":
        return neardup.groups(docs, 3, 85)
    if name == "identify":
        return langid.identify(docs, langid.train(docs, id_crc("doc_id") % 5 != 0))
    return licenses.scan(docs, *licenses.train(spark, docs))


NAMES = ["mix", "score", "compare", "judge", "digests", "groups", "identify", "scan"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert run(name, empty, spark).count() == 0


@pytest.fixture(scope="module")
def results(spark, odd):
    return {name: run(name, odd, spark).collect() for name in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(results, name):
    assert sorted(map(str, (r.doc_id for r in results[name]))) == sorted(str(r[0]) for r in PLAIN)


def of(rows, doc_id):
    return next(r for r in rows if r.doc_id == doc_id)


def test_defined_results(results):
    assert of(results["mix"], 3).size == 0 and of(results["mix"], 3).taken == 0
    score = results["score"]
    assert of(score, 3).n_tokens == 1 and of(score, 4).n_tokens == 1 and of(score, 5).base_score == of(score, 3).base_score
    compare = results["compare"]
    assert of(compare, 3).n_chars == 0 and of(compare, 3).fingerprint == of(compare, 4).fingerprint == of(compare, 5).fingerprint
    assert of(compare, 1).fingerprint == of(compare, 2).fingerprint != of(compare, 3).fingerprint
    judge = results["judge"]
    assert of(judge, 3).posterior == 0 and not of(judge, 3).kept and of(judge, 1).kept
    digests = results["digests"]
    assert of(digests, 3).n_tokens == 0 and of(digests, 3).ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert of(digests, 6).decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    groups = results["groups"]
    assert [(r.component_id, r.kept) for r in groups if r.doc_id == 2] == [(1, False)] * 2
    assert of(groups, 3).n_shingles == 0 and of(groups, 3).component_id == 3 and of(groups, 4).component_id == 4
    assert [(r.component_id, r.kept) for r in groups if r.doc_id is None] == [(None, True)]
    identify = results["identify"]
    assert {of(identify, d).lang_pred for d in (3, 4, 5, 8)} == {"und"} and of(identify, 3).score == 0
    assert of(results["scan"], 3).n_paragraphs == 0 and of(results["scan"], 3).license == "none"


def test_equal_rows_get_equal_results(results):
    for name in NAMES:
        if name != "mix":  # equal rows take different places in their source's queue
            repeated = [tuple(r) for r in results[name] if r.doc_id == 2]
            positions = [i for i, f in enumerate(results[name][0].__fields__) if f not in ("near_next", "near_edited", "edited_fingerprint", "edited_sha256")]
            assert len({tuple(r[i] for i in positions) for r in repeated}) == 1


def test_stages_keep_columns(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
    kept = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "-5", "None"])


def test_tokens_of_odd_rows(spark, odd):
    out = corpus_pipeline.byte_bpe(spark, odd, "")  # the table's own column of that name gives way
    assert out.count() == len(PLAIN)
    decoded = bpe.decode(out.select("doc_id", "ids"), vocabulary()[0]).filter("doc_id = 6").first().decoded
    assert bytes(decoded) == LONG.encode()


PAGES = "page_id bigint, url string, html string, digest string, size int, refers_to int"


def test_pages(spark):
    big = "<p>" + "same text, again. " * 80
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", big),
            (5, "http://f", "x"), (6, "http://g", "x"), (None, None, None), (7, "http://h", "y" * 700_000)]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES).repartition(2)
    folder = fresh_path(spark, "warc-test")
    index = warc.write(pages, folder)
    got = sorted(map(tuple, warc.read(index).collect()), key=str)

    def want(page_id, html):
        data = (html or "").encode()
        revisit = html == big and page_id != 2
        return (page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)

    assert got == sorted((want(i, h) for i, _, h in rows), key=str)
    ids = spark.createDataFrame([("<urn:page:7>",), ("<urn:page:3>",)], "record_id string")
    found = {r.record_id: bytes(r.record) for r in warc.fetch(index, ids).collect()}
    assert found["<urn:page:7>"].endswith(b"y" * 700_000 + b"\r\n\r\n") and found["<urn:page:3>"].startswith(b"WARC/1.1\r\n")
    assert len(found) == 2
    none = spark.createDataFrame([], PAGES)
    assert warc.round_trip(none).count() == 0
    texts = {r.page_id: r for r in extraction.extract(pages).collect() if r.page_id is not None}
    assert texts[3].text == "" and texts[4].n_chars == 0 and texts[5].text == "x" and texts[7].n_chars == 700_000
    assert extraction.extract(none).count() == 0


def test_bundle_frames():
    import io
    out = io.BytesIO()
    out.close, close = (lambda: None), out.close
    bundle = warc.Bundle(out)
    records = [warc.record(i, f"http://x/{i}", b"z" * (i * 997), i * 997, hashlib.sha1(b"z" * (i * 997)).hexdigest(), None, False) for i in range(60)]
    places = [bundle.add(r) for r in records]
    bundle.close()
    data = out.getvalue()
    frames = warc.seek_table(io.BytesIO(data), len(data))
    assert len(frames) > 2
    for (frame, at, inside), r in zip(places, records, strict=True):
        assert frames[frame][0] == at
        assert warc.read_frame(io.BytesIO(data), *frames[frame])[inside:inside + len(r)] == r
    import zstandard
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(records)  # the seek table is a skippable frame


ARTICLE = "<p>First paragraph, with commas, and a fair length so that it counts for something here.</p><p>Second &amp; last one,\n  split   over lines.</p>"


@pytest.mark.parametrize(("html", "text"), [
    (f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1>{ARTICLE}</article><footer>F</footer></body></html>",
     "Head\n\nFirst paragraph, with commas, and a fair length so that it counts for something here.\n\nSecond & last one, split over lines."),
    (f"<body><div class='sidebar'><p>Links, more links, and, again, links.</p></div><div id=main-text><h2>Head</h2>{ARTICLE}</div>"
     "<div class=comments><p>I like this, a lot, really, very much, truly.</p></div><div class='cookie-notice'>We use cookies</div>",
     "Head\n\nFirst paragraph, with commas, and a fair length so that it counts for something here.\n\nSecond & last one, split over lines."),
    ("<article><p><b>One.<br><p>Two.<script>var a='</p>';</script><p>Three<!-- no --> &#233;&nbsp;x</article>", "One.\n\nTwo.\n\nThree é x"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("plain text only", "plain text only"), ("<div>unclosed <b>bold", "unclosed bold"), ("<!-- never closed", ""), ("<script>x", ""),
    ("a < b and <p>c", "a < b and\n\nc"), ("", ""),
    (f"<article>{ARTICLE}<form><input><button>Go</button></form><aside>More</aside><div class=ad>Buy</div></article>",
     "First paragraph, with commas, and a fair length so that it counts for something here.\n\nSecond & last one, split over lines."),
])
def test_main_text(html, text):
    assert extraction.main_text(html) == text


def test_pages_of_the_table(spark):
    """The generator's articles: heading and paragraphs, nothing of menu, advert and footer."""
    import re
    from html import unescape

    from slicewise.session import table
    for r in table(spark, "/root/testdata/sf0.001", "pages").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", article)]
        assert extraction.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def test_ranges_of_texts_hold_few_bytes_and_every_text():
    rng = np.random.RandomState(3)
    texts = [None if i % 50 == 0 else "w" * int(rng.randint(0, 3000)) for i in range(4000)] + ["x" * (3 * maxent.CHUNK), ""]
    column = pa.array(texts).slice(7)
    got = list(maxent.chunks(column))
    assert [t for _, _, part in got for t in part] == [(t or "").encode() for t in texts[7:]]
    assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]] and got[-1][1] == len(column)
    assert all(sum(map(len, part[:-1])) < maxent.CHUNK <= 1 << 20 for _, _, part in got)
    assert list(maxent.chunks(column.slice(0, 0))) == []
