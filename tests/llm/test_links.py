"""Golay fingerprints, letter signatures and the R-tree against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haulgrid.llm import golay_simhash, grouped_pairs, rtree_negatives, variant_groups
from tests.llm.test_graphs import WORD, roots


def test_golay_code_is_perfect():
    x = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    near, fresh = golay_simhash.near_codewords(x, 23)
    assert set(fresh.sum(axis=1).tolist()) == {1, 6}
    words = {int(golay_simhash.decode(np.array([v]))[0]) for v in range(1 << 11)}
    assert max(words) < 1 << 12
    # all 4,096 codewords are at least seven bits apart: none of weight below seven but zero
    code = [v << 11 for v in range(1 << 12)]
    rest = golay_simhash._LOW[np.array(code) & 0xFFF] ^ golay_simhash._HIGH[np.array(code) >> 12]
    weights = np.bitwise_count(np.array(code) ^ rest)
    assert sorted(set(weights.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]


def test_linked_fingerprints_share_a_key_on_opposite_sides():
    rnd = random.Random(3)
    pairs = []
    for errors in [(0, 0, 4), (4, 0, 0), (0, 4, 0), (2, 2, 0), (0, 2, 2), (2, 0, 2), (1, 1, 2), (2, 1, 1), (1, 2, 1), (1, 3, 0), (0, 1, 3)] * 20:
        x = y = rnd.getrandbits(64)
        for (at, n), e in zip(golay_simhash.SEGMENTS, errors):
            for bit in rnd.sample(range(at, at + n), e):
                y ^= 1 << bit
        pairs.append((x, y))
    for x, y in pairs:
        rows, keys, sides = golay_simhash.golay_keys(np.array([x, y], np.uint64))
        assert len(set(zip(rows.tolist(), keys.tolist()))) == len(keys)
        side = lambda r, s: set(keys[(rows == r) & (sides & s > 0)].tolist())
        assert side(0, golay_simhash.A) & side(1, golay_simhash.B) and side(1, golay_simhash.A) & side(0, golay_simhash.B)


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A b\tc", "a b c d", "a b c d e", "  x"]
    base = [word() for _ in range(1500)]
    for i in range(60):  # near copies drift away from the first one, by a word or two each
        base[rnd.randrange(1500)] = word()
        if i % 3 == 0:
            base[rnd.randrange(1500)] = word()
        texts.append(" ".join(base))
    texts += [" ".join(word() for _ in range(rnd.randint(5, 80))) for _ in range(40)] + texts[20:25]
    return list(enumerate(texts, 50)) + [(50, texts[1]), (None, texts[30]), (None, "alone of all the texts without id")]


def test_fingerprint():
    for _, text in fingerprint_corpus():
        assert golay_simhash.fingerprint(text) == plain_fingerprint(text)
    assert golay_simhash.fingerprint("x y " * 200_000) == plain_fingerprint("x y " * 200_000)


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_components(spark, monkeypatch, block):
    monkeypatch.setattr(grouped_pairs.meet, "__defaults__", (block,))
    rows = fingerprint_corpus()
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root, least = roots(range(len(rows)), edges), {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    assert len({r for r in root.values()}) < len(set(prints))
    want = [(key, f"{prints[i]:016x}", least.get(root[i])) for i, (key, _) in enumerate(rows)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, key string, n int").repartition(3)
    got = golay_simhash.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert golay_simhash.near_duplicates(df.limit(0)).count() == 0


def plain_variants(rows):
    counts = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += len(word) >= 7
            run = ""
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(found[w], key=lambda v: (-words[v], v)) for w in words if found[w]}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(found[w]), words.get(form.get(w))) for w, n in words.items()}


def variant_corpus():
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(7, 9))) for _ in range(12)] + ["aaaaaaa", "ÿ÷×àáâã", "abcdefgh"]
    texts = [None, "", "short words only", "Abcdefgh" * 2000 + " " + "Abcdefgh" * 2000]
    for i, stem in enumerate(stems):
        slips = {stem[:j] + c + stem[j + k :] for j in range(len(stem)) for c in ("", "a", "z") for k in (0, 1)}
        texts.append(" ".join([stem.upper() if i % 2 else stem] * (400 if i % 3 == 0 else 30)))
        texts += [f"{s}-{s}!{s}" for s in sorted(slips)]
        second = stem[:3] + "z" + stem[4:]
        texts.append(" ".join([second] * 36 + [second[:-1]] * 2))
    return list(enumerate(texts, 3)) + [(None, "nullids nullids nullidz"), (3, texts[4]), (3, texts[4])]


@pytest.mark.parametrize("block", [4096, 4])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(grouped_pairs.meet, "__defaults__", (block,))
    monkeypatch.setattr(variant_groups, "HELD", 50)
    rows = variant_corpus()
    want = plain_variants(rows)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] and w[1] for w in want)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = variant_groups.variants(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert variant_groups.variants(df.limit(0)).count() == 0
    assert variant_groups.variants(df.filter("text is null")).count() == 0


def test_near_words_share_a_signature():
    rnd = random.Random(4)
    for _ in range(300):
        a = "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(6, 14)))
        i = rnd.randrange(len(a))
        for b in (a[:i] + a[i + 1 :], a[:i] + "x" + a[i + 1 :], a[:i] + a[0] + a[i:]):
            rows, keys, sides, sketch = variant_groups.signatures([a, b])
            assert int(sketch[0] ^ sketch[1]).bit_count() <= 2
            own = [{(k, s) for r, k, s in zip(rows.tolist(), keys.tolist(), sides.tolist()) if r == n} for n in (0, 1)]
            swap = {0: 0, 1: 2, 2: 1}
            assert a == b or own[0] & {(k, swap[s]) for k, s in own[1]}


def plain_negatives(rows):
    rows = sorted({(i, l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, l, v in rows
                   if None not in (i, l, v) and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, l, v in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if len(w) == len(v))
        for p, j, _ in [s for s in scored if s[1] != i and s[2] == l][:5]:
            fits = [(s, k) for s, k, m in scored if m != l and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits[:10], 1)]
    return sorted(out)


def negative_rows(n=900, dims=6, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((8, dims)) * 0.7
    rows = [(i, int(rnd.integers(4)), [float(x) for x in np.float32(centres[i % 8] + rnd.standard_normal(dims) * 0.3)]) for i in range(n)]
    rows += [(1000 + i, i % 3, [0.5] * dims) for i in range(130)]  # ties beyond a leaf
    rows += [(200, 1, rows[0][2]), rows[100], rows[100], (300, 2, [1.0] * dims)]
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [float("nan")] * dims), (2003, 1, [None] * dims),
             (2004, 0, [float("inf")] * dims), (2100, 0, [0.0] * dims), (2101, 0, [1.0, 2.0]), (2200, 0, [3.0, 1.0]),
             (2201, 1, [1.0, 1.5]), (2300, 0, []), (2301, 0, []), (2302, 1, [])]
    return rows


@pytest.mark.parametrize("leaf, subtree, asked, group", [(64, 2048, 256, 16), (4, 40, 3, 2)])
def test_hard_negatives(spark, monkeypatch, leaf, subtree, asked, group):
    for name, value in zip(("LEAF", "SUBTREE", "ASKED", "GROUP"), (leaf, subtree, asked, group)):
        monkeypatch.setattr(rtree_negatives, name, value)
    rows = negative_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, row string, tile int")
    got = rtree_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 100 == 0)
    want = plain_negatives(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert rtree_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert rtree_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_integer_products_beyond_doubles(spark):
    big = float(1 << 22)
    rows = [(100, 0, [big] * 4), (1, 0, [big] * 4), (2, 1, [big * 0.5, big * 0.5, big, big * 0.25]), (3, 1, [big, big, 1.0, big * 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, rtree_negatives.hard_negatives(df, F.col("vec_id") == 100).collect())) == plain_negatives(rows)
    with pytest.raises(ValueError):
        rtree_negatives.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)), F.lit(True))


def subtree(rows, dims):
    import pyarrow as pa

    x = np.array([r[2] for r in rows], np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
         pa.array(x.tolist(), pa.list_(pa.int64())), pa.array([dims] * len(rows), pa.int32()), pa.array([0] * len(rows))],
        ["id", "row", "label", "v", "dims", "tile"],
    )
    return next(rtree_negatives._packed(len(rows), 64)(iter([batch])))


def test_boxes_are_pruned():
    """With clustered rows most boxes are never opened, and the result is that of a full scan."""
    rnd = np.random.default_rng(0)
    centres = rnd.integers(-300, 300, (32, 3))
    rows = [(i, i % 2, (centres[i % 32] + rnd.integers(-4, 5, 3)).tolist()) for i in range(2048)]
    tree = rtree_negatives.Subtree(subtree(rows, 3), 0, np.float64, 64)
    anchors = rtree_negatives.Subtree(subtree([rows[40]], 3), 0, np.float64, 64)
    search = rtree_negatives.Search(anchors, np.array([[0, -(2**40), 2**40]]), 5, True)
    search.add(tree)
    assert search.visited <= 10  # of 32
    scores = sorted((-int(np.dot(rows[40][2], v)), i) for i, l, v in rows if l == rows[40][1] and i != 40)[:5]
    assert [(s, i) for _, s, i, _ in search.found()] == [(-s, i) for s, i in scores]
