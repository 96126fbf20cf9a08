"""Components, near duplicates and URL classes against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import parity_join
from haulgrid.llm.components import connected_components
from haulgrid.llm.redirect_filter import filter_urls, page_links


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)]
    edges += [(1000, i) for i in range(1001, 1080)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges + edges[:20], "u long, v long")
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = {k: v for k, v in roots({n for e in real for n in e}, real).items() if k != v}
    assert {(r.node, r.component) for r in connected_components(df).collect()} == set(want.items())
    assert connected_components(df.limit(0)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """By rows (id, text): (n_shingles, smallest id of the component)."""
    sets = [shingles(t) for _, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = roots(range(len(rows)), edges)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    return [(key, len(sets[i]), least.get(root[i])) for i, (key, _) in enumerate(rows)], root


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d e", "A B  c\td e", "a b c d e f", "x y", "y x"]
    for n in (6, 9, 20, 60, 150, 400):
        base = [word() for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, n // 18))):
                copy[rnd.randrange(n)] = word()
            texts.append(" ".join(copy + [word() for _ in range(rnd.randint(0, n // 10))]))
    for _ in range(30):  # one passage that many documents share
        texts.append(" ".join([word() for _ in range(rnd.randint(20, 90))] + shared + [word() for _ in range(40)]))
    drift = [word() for _ in range(200)]  # neighbours are near, ends are not
    for i in range(25):
        drift = drift[4:] + [word() for _ in range(4)]
        texts.append(" ".join(drift))
    rows = list(enumerate(texts, 100))
    rnd.shuffle(rows)
    return rows + [(7, texts[30]), (7, texts[30]), (None, texts[31]), (None, "alone in the world of null ids")]


def test_near_duplicates(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, row string").repartition(5)
    got = sorted(map(tuple, parity_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted(components(rows)[0], key=repr)
    assert parity_join.near_duplicates(df.limit(0)).count() == 0


def test_copies_without_ids_make_one_link(spark):
    """A thousand copies of two near texts: as sets they are one pair, whatever their ids."""
    words = [f"w{i}" for i in range(80)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, a)] * 500 + [(None, b)] * 500 + [(None, "five words of another text")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("row", F.lit(None).cast("string")).repartition(4)
    joined = parity_join._Join(df, 5, 75)
    x, y = (r[0] for r in joined.classes.filter("n_shingles > 1").select("set_id").collect())
    assert joined.linked(spark.createDataFrame([(x, y)], "a long, b long")).count() == 1
    assert joined.components().count() == 1


def join_of(spark, texts, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("row", F.lit(None).cast("string"))
    return parity_join._Join(df.repartition(parts, "id"), 5, 75)


def words_of(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(n)]


def test_a_passage_in_some_documents_makes_no_group(spark):
    """Far fewer than a fixed share of all shingles; the documents have enough of their own to meet by."""
    rnd = random.Random(3)
    shared = words_of(rnd, 60)
    joined = join_of(spark, [" ".join(words_of(rnd, 50) + shared + words_of(rnd, 50)) for _ in range(40)])
    assert joined.groups().count() == 0


def test_copies_are_in_a_group_once(spark):
    rnd = random.Random(4)
    text = words_of(rnd, 90)
    groups = join_of(spark, [" ".join(text), " ".join([*text[:-1], "other"])] * 8, 8).groups()
    assert groups.count() == groups.select("key", "set_id").distinct().count() > 0


@pytest.mark.parametrize("block", [8, 512])
def test_sets_around_a_component(spark, monkeypatch, block):
    """Near copies, and others not near enough, some of which are near each other; in blocks and at once."""
    monkeypatch.setattr(parity_join, "MEET", block)
    rnd = random.Random(5)
    base, texts = words_of(rnd, 200), []
    for changed in [1] * 30 + [7, 8, 9, 10, 11] * 6:
        copy = list(base)
        for at in rnd.sample(range(200), changed):
            copy[at] = words_of(rnd, 1)[0]
        texts.append(" ".join(copy))
        if changed == 9:
            copy[rnd.randrange(200)] = "edit"
            texts.append(" ".join(copy))
    joined, rows = join_of(spark, texts), list(enumerate(texts))
    got = {r.id: r.component_id for r in parity_join._labelled(joined.docs, 5, 75).collect()}
    assert [(i, n, got[i]) for i, n, _ in components(rows)[0]] == components(rows)[0]
    named = {}
    for i, component in got.items():
        named.setdefault(component, []).append(i)
    assert max(map(len, named.values())) >= 30 and len(named) >= 6


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component string")
    kept = parity_join.keep_one(df)
    assert kept.columns == df.columns
    _, root = components(rows)
    want = {}
    for i, (key, text) in enumerate(rows):
        k = (root[i] if shingles(text) else ("none", i))
        want[k] = min(want.get(k, (True, 0)), (key is None, key or 0))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted(want.values())


def test_sketch_is_a_lower_bound():
    rnd = np.random.default_rng(2)
    for n in (1, 5, 70, 300, 5000):
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rnd.integers(0, 2**63, n // 8 + 1).astype(np.uint64)]))
        x, y = parity_join.bit_sketch(a), parity_join.bit_sketch(b)
        m = min(len(x), len(y))
        fold = lambda s: np.bitwise_xor.reduce(s.reshape(-1, m), axis=0)
        distance = sum(int(v).bit_count() for v in (fold(x) ^ fold(y)).view(np.uint64))
        assert distance <= len(np.setxor1d(a, b))
        frequent = np.zeros(parity_join.BUCKETS, bool)
        if len(np.intersect1d(a, b)) * 100 >= 75 * len(np.union1d(a, b)):
            assert set(parity_join.segment_keys(a, frequent, 75)) & set(parity_join.segment_keys(b, frequent, 75))


def test_sets_with_too_few_segments_still_meet(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "lacks_segments", lambda s, p: len(s) > 50)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, parity_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted(components(rows)[0], key=repr)


PAGES = [
    (1, "https://a.example.edu/x", '<link href="https://b.example.edu/y#top" rel="canonical">'),
    (2, "https://b.example.edu/y", "<META HTTP-EQUIV=refresh content='0; URL=http://Bad.net/z'>"),
    (3, "https://c.example.edu/q", '<link rel="canonical" href="/other">'),
    (4, "https://c.example.edu/other", None),
    (5, "https://d.example.edu/a", '<link rel="canonical" href="https://e.example.org/fr/1"><link rel=canonical href=http://x.net/>'),
    (6, "https://e.example.org/fr/1", ""), (7, "https://www.example.net/en/1?x", '<link rel="canonical" href="http://www.example.net/de/">'),
    (8, "http://www.example.net/de/", "<p>"), (9, None, '<link rel="canonical" href="http://bad.net/">'), (10, "no scheme.net/", "x"),
    (11, "http://Shop.Example.COM/de/?a=b", None), (12, "http://example.com/en", None), (13, "http://net/", ""), (14, "http://net", ""),
    (1, "https://a.example.edu/x", '<link href="https://b.example.edu/y#top" rel="canonical">'), (15, "x://y://z.net/", "<link rel=stylesheet href=http://bad.net/>"),
]
VERDICTS = {
    1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("org/fr/", "allow"),
    7: ("example.net/en/", "allow"), 8: ("net/", "block"), 9: (None, "allow"), 10: (None, "allow"), 11: ("example.com/de/", "block"),
    12: (None, "allow"), 13: ("net/", "block"), 14: (None, "allow"), 15: (None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = filter_urls(df).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert (r.rule, r.verdict) == VERDICTS[r.page_id], r.page_id
    assert {r.host for r in got if r.page_id == 11} == {"shop.example.com"}
    assert filter_urls(df.limit(0)).count() == 0
    assert filter_urls(df.filter("page_id = 12")).first().verdict == "allow"
    links = {tuple(r) for r in page_links(df).collect()}
    assert ("https://a.example.edu/x", "https://b.example.edu/y") in links and ("https://c.example.edu/q", "https://c.example.edu/other") in links
    assert not any("stylesheet" in v for _, v in links)
