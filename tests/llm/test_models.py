"""Quality, language and page models: held-out accuracy on the driver's tables, brute-force decoding and edge rows."""

import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import crf_extract, language_bits, pairwise_quality

DATA = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")


@here
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = pairwise_quality.train(docs, labels)
    rows = pairwise_quality.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all((r.score >= pairwise_quality.CUT) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    kept = pairwise_quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == pairwise_quality.score(docs, model).filter("predicted = 1").count()


def test_quality_edges(spark):
    rows = [(1, "a b c", 5.0), (2, None, None), (3, "", 1.0), (None, "x", 1.0), (1, "a b c", 5.0), (4, "*** &&& $$$ " * 9, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(1, None), (None, 0)], [(1, 1), (4, 0), (2, 1), (3, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        got = pairwise_quality.score(docs, pairwise_quality.train(docs, known)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert pairwise_quality.score(docs.limit(0), pairwise_quality.train(docs, known)).count() == 0


def test_pairs_order_texts():
    rnd = np.random.default_rng(1)
    good = rnd.random(400) < 0.8
    x = rnd.normal(size=(400, pairwise_quality.FEATURES))
    x[:, 2] += 3 * good
    model = pairwise_quality.learn(x, good)
    assert np.argmax(np.abs(model.weights)) == 2
    s = model.scores(x)
    assert s[good].mean() > 0.7 > 0.3 > s[~good].mean()
    assert abs((s < pairwise_quality.CUT).mean() - (~good).mean()) < 0.01


def test_quality_cut_is_at_the_true_share(spark):
    """However few rows of either class the weights come from, as many labelled rows are rejected as are bad."""
    rnd = random.Random(9)
    rows = []
    for i in range(1500):
        good = i % 7 > 0
        words = ["w" * rnd.randint(1, 9) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(20, 60))]
        words += ["#"] * rnd.randint(0, 20 if good else 30)
        rows.append((i, " ".join(words), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for size in (30, 300, 10_000):
        model = pairwise_quality.train(df.drop("quality"), df.drop("text"), rows_per_class=size)
        got = pairwise_quality.score(df, model).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).collect()
        bad = sum(r.quality == 0 for r in got)
        assert sum(r.predicted == 0 for r in got) == bad and model.prior == pytest.approx(1 - bad / len(got))


@here
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_bits.identify(docs, language_bits.train(docs), keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_edges(spark):
    rows = [(i, "the cat sat on that mat " * 3, "en") for i in range(9)] + [(i, "der Hund ist über die Brücke", "de") for i in range(20, 29)]
    odd = [(50, None, "en"), (51, "", "en"), (52, "12 345 !!", "de"), (53, "the mat", None), (None, "Brücke und Hund", "de"), (54, "Ж", None)]
    docs = spark.createDataFrame(rows + odd + odd[3:4], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language_bits.train(docs)
    got = {r.doc_id: r.lang_pred for r in language_bits.identify(docs, model).collect()}
    assert [got[k] for k in (0, 20, 50, 51, 52, 53, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got[54] in ("en", "de")
    none = language_bits.train(docs.filter("lang is null"))
    assert {r.lang_pred for r in language_bits.identify(docs, none).collect()} == {"und"}
    assert language_bits.identify(docs.limit(0), model).count() == 0


def test_filters_hold_all_members_of_many_languages():
    rnd = random.Random(4)
    counts = {f"l{i:03}": {rnd.getrandbits(62): 5 for _ in range(50)} for i in range(70)}
    model = language_bits.build(counts)
    for i, lang in enumerate(model.languages):
        masks = model.masks(np.array(list(counts[lang]), np.int64).view(np.uint64))
        assert (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    assert (model.false_rate < 0.01).all()


def test_viterbi_and_gradient_against_all_labellings():
    rnd = random.Random(2)
    n = len(crf_extract._NAMES)
    chain = crf_extract.Chain(np.array([rnd.uniform(-2, 2) for _ in range(n)]), np.array([[0.3, -0.9], [-0.4, 0.7]]))
    for size in range(1, 8):
        features = [[rnd.randrange(n) for _ in range(4)] for _ in range(size)]

        def total(y):
            return sum(chain.weights[k] for f, l in zip(features, y) if l for k in f) + sum(
                chain.moves[a][b] for a, b in zip(y, y[1:])
            )

        best = max(itertools.product((0, 1), repeat=size), key=total)
        assert tuple(chain.decode(features)) == best
    assert chain.decode([]) == [] and crf_extract.fit([]).decode([[0]]) == [0]


@pytest.fixture(scope="module")
def chain():
    pages = [(crf_extract.leaf_blocks(h), y) for h, y in crf_extract.made_pages(300)]
    return crf_extract.fit([(crf_extract.block_features(b), y) for b, y in pages])


def test_made_pages_held_out(chain):
    wrong = total = 0
    for page, labels in crf_extract.made_pages(150, seed=99):
        got = chain.decode(crf_extract.block_features(crf_extract.leaf_blocks(page)))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong < 0.03 * total


def test_blocks():
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><p>a&amp;b&nbsp; c<br>d"
        "<p>e <b>f</b>g<ul><li>h<li>i</ul><script>var t='</p>'</script><div class='x' data-y=\"a>b\">j &lt;k&gt; &am"
    )
    assert [b.text for b in crf_extract.leaf_blocks(page)] == ["a&b c d", "e fg", "h", "i", "j <k> &am"]
    assert crf_extract.leaf_blocks("<p>x</p><p>cut <a href='") [-1].text == "cut"
    assert [b.text for b in crf_extract.leaf_blocks("1 < 2 <> 3 <b")] == ["1 < 2 <> 3"]
    assert crf_extract.leaf_blocks("<p" + " a" * 50_000) == []
    assert len(crf_extract.leaf_blocks("<div>" * 3000 + "x")) == 1


@pytest.mark.parametrize("page, texts", [
    ("<p>one</p><a title=it's href=x>two</a><p>three</p>", ["one", "two", "three"]),
    ("<p>if x <y and it's so</p><p>three</p>", ["if x <y and it's so", "three"]),
    ("<p>If a<b then</p><p>it's</p>", ["If a<b then", "it's"]),
    ("<p>a < b and c > d</p>", ["a < b and c > d"]),
    ("<p title='a > b' lang=\"x'y\">one</p>", ["one"]),
    ("<p>one</p><a href=\"x>two", ["one", "two"]),
    ("<p>one</p><a href=\"x", ["one"]),
    ("<p>one <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> two</p>", ["one x=2 two"]),
    ("<object data=a><p>shown instead</p></object><noscript><p>no script</p></noscript>", ["shown instead", "no script"]),
])
def test_broken_tags_lose_nothing(page, texts):
    assert [b.text for b in crf_extract.leaf_blocks(page)] == texts


@here
def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = crf_extract.extract(pages, crf_extract.train(pages), keep=["page_id", "html"]).collect()
    got = crf_extract.extract(pages.withColumn("text", F.lit("clash")), crf_extract.train(pages)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        blocks = crf_extract.leaf_blocks(html[r.page_id])
        assert r.text == "\n".join(b.text for b in blocks if "article" in b.tags) and r.n_chars == len(r.text)


def test_page_edges(spark, chain):
    rows = [(1, None), (2, ""), (3, "<nav><a href=/>x</a></nav>"), (3, "<nav><a href=/>x</a></nav>"), (None, "<article><p>Some long enough text stands here, and it goes on.</p></article>")]
    got = crf_extract.extract(spark.createDataFrame(rows, "page_id long, html string"), chain).collect()
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, ""), (2, ""), (3, ""), (3, "")]
    assert got[4].text.startswith("Some long") and got[4].n_chars == len(got[4].text)
    assert crf_extract.extract(spark.createDataFrame([], "page_id long, html string"), chain).count() == 0


def test_features_of_long_and_empty_texts():
    x = pairwise_quality.features(pa.array([None, "", "a" * 3_000_000, "b " * 1_000_000, "ü!"]))
    assert np.isfinite(x).all() and x[0, -1] == x[1, -1] == 1 and (x[:, :] <= 1.3).all()
