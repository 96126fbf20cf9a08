"""Packing, raking, nearest neighbours and the pipeline against brute force."""

import bisect
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulgrid.llm import adaptive_scan, grouped_packing, raking

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = [
    "It's OK, I'LL §1²³ naïve\xa0x   Éa", "İx ΑΣ ς", "<|endoftext|> a<|startoftext|>", "don't'S ÷× 'S'", "Ⱥb ɏ", "\x1ca\x85b", "", "  ",
    "a_b_c 12 ½ ﬁ ＡＢ 你好 😀", "é ö", "Ÿ ŉ ſ € „x“ – —", "x" * 300, "­​",
]


def test_tokens():
    tokens, real = grouped_packing.WordTokens(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("aé'St 1²#.ßÀſ \n–") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert tokens.encode(t) == np.array(real.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_places_everything(counts):
    runs = grouped_packing.plan_runs(counts, 64, 10)
    placed = Counter()
    for n, lengths in runs:
        assert n > 0 and sum(lengths) <= 64
        for length in lengths:
            placed[length] += n
    assert placed == Counter(counts)
    seen = defaultdict(list)
    for length, first, n, _, _ in grouped_packing.places(runs):
        seen[length].append((first, n))
    for length, ranges in seen.items():
        at = 0
        for first, n in sorted(ranges):
            assert first == at
            at += n
        assert at == counts[length]


def test_plan_is_near_the_bound():
    rnd = random.Random(3)
    counts = Counter(min(2048, max(1, int(rnd.lognormvariate(6, 1)))) for _ in range(20_000))
    needed = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(n for n, _ in grouped_packing.plan_runs(counts)) <= 1.02 * needed


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = Counter(min(2048, 1 + int(rnd.lognormvariate(5.8, 1.0 + seed / 10))) for _ in range(6000))
    rooms = []  # plain best fit, piece by piece
    for length in sorted(lengths.elements(), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else 2048
        bisect.insort(rooms, room - length)
    runs = grouped_packing.plan_runs(lengths)
    placed = Counter()
    for n, own in runs:
        assert sum(own) <= 2048
        for length in own:
            placed[length] += n
    assert placed == lengths and sum(n for n, _ in runs) <= len(rooms)


def check_packing(rows, pieces, capacity=2048):
    real = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for key, text in rows:
        ids = [*real.encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want[key, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "on", "ingesh", "a."]) for _ in range(rnd.choice([0, 1, 40, 300, 900, 5000]))) for _ in range(60)]
    rows = [*enumerate(texts + ODD), (0, None), (None, "null id"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length int").repartition(3)
    check_packing(rows, grouped_packing.pack(df, TOKENIZER).collect())
    assert grouped_packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_raking_meets_targets(spark):
    rnd = random.Random(4)
    rows = [
        (i, rnd.choice([None, "s0", "s0", "s1", "s2"]), rnd.choice(["en", "en", "de", None]), "w " * rnd.choice([3, 150, 1200]) + rnd.choice(["", " | x"]))
        for i in range(600)
    ] + [(900, "s9", "xx", None), (None, "s1", "en", ""), (3, "s1", "en", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("weight", F.lit(7))
    got = raking.mix_sources(df, share=0.01, sweeps=20).collect()
    assert len(got) == len(rows) and all(r["weight"] == 7 and 0 <= r["__probability"] <= 1 for r in got)
    total = sum(r["__tokens"] for r in got)
    for dim in ("__source", "__lang", "__topic"):
        real, weighed = Counter(), Counter()
        for r in got:
            real[r[dim]] += r["__tokens"]
            weighed[r[dim]] += r["__tokens"] * r["__weight"]
        roots = sum(v**0.5 for v in real.values())
        for value, n in real.items():
            assert weighed[value] / total == pytest.approx(n**0.5 / roots, abs=0.01), (dim, value)
    assert all(r["__sampled"] == (raking_draw(r.doc_id) < r["__probability"]) for r in got)
    assert raking.sample(df).columns == df.columns and raking.sample(df.limit(0)).count() == 0


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 1, "de": 1}, "topic": {"short": 3, "prose": 5, "absent": 9}}])
def test_margins_hold_as_registered(spark, targets):
    """At the registered share and sweeps every margin is near its target and the sample near the share that is feasible."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = raking.mix_sources(docs, targets=targets).select(
        "__source", "__lang", "__topic", "__tokens", "__weight", "__probability", "__sampled"
    ).toPandas()
    n, total = got["__tokens"], got["__tokens"].sum()
    share = (got["__probability"] / got["__weight"]).min()
    assert got["__probability"].max() <= 1 and 0.05 < share <= raking.SHARE
    for name in raking.DIMENSIONS:
        own = n.groupby(got["__" + name]).sum() / total
        want = own**0.5 / (own**0.5).sum()
        if targets and name in targets:
            listed = {k: v for k, v in targets[name].items() if k in own}
            rest = 1 - own.drop(list(listed)).sum()
            want = own.copy()
            for k, v in listed.items():
                want[k] = v / sum(listed.values()) * rest
        reached = (n * got["__weight"]).groupby(got["__" + name]).sum() / total
        assert (reached - want).abs().max() < 0.005, name
        for _, part in got.groupby("__" + name):  # drawn once: within five standard deviations of what is expected
            m, p = part["__tokens"], part["__probability"]
            assert abs(m[part["__sampled"]].sum() - (m * p).sum()) <= 5 * (m**2 * p * (1 - p)).sum() ** 0.5 + m.max()
    assert abs((n * got["__probability"]).sum() / total - share) < 0.01 * share + 0.005
    with pytest.raises(ValueError):
        raking.mix_sources(docs, targets={"colour": {"red": 1}})


def raking_draw(key):
    import hashlib

    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:13], 16) / 16**13


def brute_nearest(rows, asks, k=20):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and usable(v)}
    out = {}
    for q in ok:
        if asks(q):
            scored = sorted((-float(ok[q] @ x), i) for i, x in ok.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def run_nearest(spark, rows, **more):
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    out = defaultdict(list)
    for r in adaptive_scan.nearest(df, F.col("vec_id") % 20 == 0, **more).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    for v in out.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
    return out


def test_nearest_recall_and_scores(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (2080, [float("inf")] * 24), (None, x[0].tolist())]
    want, got = brute_nearest(rows, lambda i: i % 20 == 0), run_nearest(spark, rows)
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 20
        assert found == sorted(found, key=lambda r: (-r[2], r[1]))
        for _, i, s in found:
            assert s == pytest.approx(float(np.array(vectors[q], float) @ np.array(vectors[i], float)), abs=1e-12)
    assert [i for _, i, _ in got[120]] == [i for i, _ in want[120]]  # all of them copies: ties go to the smaller ids


def test_nearest_of_few(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (7, [-1.0, 0.0]), (9, [0.5, 0.5]), (20, [0.0, 2.0]), (40, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    got = run_nearest(spark, rows)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {0: [5, 9, 20, 7], 20: [5, 9, 0, 7]}
    assert run_nearest(spark, []) == {} and run_nearest(spark, [(20, [1.0])]) == {}


def test_tests_abandon_most_and_keep_the_best():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = adaptive_scan.Index(x, 1.0, 40)
    turned, lost, kept = index.rotate(x), 0, 0
    for q in x[:40]:
        scores = x @ q
        best = np.argsort(-scores)[:20]
        _, found = adaptive_scan.survivors(index.rotate(q[None], True), turned, np.array([2 - 2 * scores[best[-1]]]))
        lost += len(set(best) - set(found))
        kept += len(found)
    assert lost <= 8 and kept < 0.1 * 40 * 3000


def test_pairs_are_met_one_by_one_only_when_few_live(monkeypatch):
    """Uniform vectors under a loose bound: the first tests abandon next to nothing, so they are matrix products."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(512, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = adaptive_scan.Index(x, 1.0, 20)
    turned, asked = index.rotate(x), index.rotate(x[:64], True)
    bounds = np.sort(2 - 2 * x[:64] @ x.T, axis=1)[:, 21]
    want, width = set(), turned.shape[1]
    for i, q in enumerate(asked):
        for j, v in enumerate(turned):
            far = np.cumsum((q - v) ** 2)
            if all(far[d - 1] * width / d <= bounds[i] * ((1 + adaptive_scan.TRUST / d**0.5) ** 2 if d < width else 1 + 1e-5) + 1e-6
                   for d in (16, 32, 48, 64, width)):
                want.add((i, j))
    singly, plain = [], np.einsum
    monkeypatch.setattr(adaptive_scan.np, "einsum", lambda how, a, b: singly.append(len(a)) or plain(how, a, b))
    rows, cols = adaptive_scan.survivors(asked, turned, bounds)
    assert set(zip(rows.tolist(), cols.tolist())) == want
    assert sum(singly) < 64 * 512 / adaptive_scan.SPARSE


def test_best_of_a_tile_keeps_ties_to_smaller_ids():
    rnd = np.random.default_rng(10)
    plain, queries = rnd.integers(-2, 3, (300, 6)).astype(float), rnd.integers(-2, 3, (40, 6)).astype(float)
    least, scores = rnd.permutation(300), queries @ plain.T
    every = tuple(c.ravel() for c in np.indices(scores.shape))
    some = np.flatnonzero(rnd.random(scores.size) < 0.5)
    for pick in (np.arange(every[0].size), some, some[:50], some[:0]):
        rows, cols, found = adaptive_scan.best(queries, plain, every[0][pick], every[1][pick], least, 7)
        want = []
        for q in range(40):
            mine = sorted((-scores[q, c], least[c], c) for r, c in zip(every[0][pick], every[1][pick]) if r == q)
            want += [(q, c, -s) for s, _, c in mine[:7]]
        assert list(zip(rows.tolist(), cols.tolist(), found.tolist())) == want


def test_neither_lists_nor_queries_are_broadcast(spark, monkeypatch):
    """Queries are there once a list, but Spark would guess that table's size from the queries alone."""
    plans, plain = [], adaptive_scan.map_arrow

    def noted(df, function, schema):
        if {"plain", "queries"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, function, schema)

    monkeypatch.setattr(adaptive_scan, "map_arrow", noted)
    run_nearest(spark, [(i, [float(i), 1.0]) for i in range(50)])
    assert len(plans) == 2 and all("SortMergeJoin" in p.split("MapInArrow")[0] for p in plans)


def test_lists_and_queries_travel_in_large_blocks():
    """Whatever batches they come in: a list's pieces are joined, and up to 1,024 queries meet it in one row."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(1100, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = adaptive_scan.Index(x, 1.01, 6)
    batches = [pa.record_batch({"v": pa.array(p.tolist(), pa.list_(pa.float32())), "ids": [[int(i)] for i in n]})
               for p, n in zip(np.array_split(x, 50), np.array_split(np.arange(1100), 50))]
    table = pa.Table.from_batches(list(adaptive_scan._lists(index)(iter(batches)))).sort_by("list").combine_chunks()
    blocks = pa.Table.from_batches(list(adaptive_scan._blocks(iter(table.to_batches())))).to_pylist()
    own, seen = index.order(index.rotate(x), 1)[:, 0], []
    assert len(blocks) == sum(-(-int(n) // adaptive_scan.BLOCK) for n in np.bincount(own))
    for b in blocks:
        ids = [i for i, in b["ids"]]
        seen += ids
        assert len(ids) <= adaptive_scan.BLOCK and (own[ids] == b["list"]).all()
        assert (np.frombuffer(b["plain"], "<f4").reshape(-1, 8) == x[ids]).all()
        assert np.allclose(np.frombuffer(b["turned"], "<f4").reshape(-1, 9), index.rotate(x[ids]), atol=1e-6)
    assert sorted(seen) == list(range(1100))
    asking = pa.record_batch({"key": np.arange(1100), "v": pa.array(x.tolist(), pa.list_(pa.float32())), "bound": np.arange(1100.0)})
    sizes = np.bincount(own, minlength=6)
    both = [pa.Table.from_batches(list(adaptive_scan._probes(index, sizes, 6, 100, first)(iter([asking])))).to_pylist() for first in (True, False)]
    assert len(both[0]) <= 2 * 6 and len(both[1]) <= 2 * 6
    pairs = [(r["list"], k) for part in both for r in part for k in r["keys"]]
    assert sorted(pairs) == [(i, k) for i in range(6) for k in range(1100)]
    for r in both[1]:
        assert (np.frombuffer(r["bounds"], "<f8") == r["keys"]).all()
        assert (np.frombuffer(r["queries"], "<f4").reshape(-1, 8) == x[r["keys"]]).all()


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_pipeline(spark):
    """Every stage's rows from its predecessor's, and the whole from run()."""
    import corpus_pipeline
    from tests.llm.brute import draw_share, keep_one, mask

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    from haulgrid.llm import pairwise_quality
    from haulgrid.llm.tables import write_table

    model = pairwise_quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = write_table(stages["quality"](spark, docs, DATA), "t1")
    scored = pairwise_quality.score(docs, model, keep=["doc_id"]).collect()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored if r.score >= 0.3}
    single = write_table(stages["near_duplicates"](spark, good, DATA), "t2")
    assert {r.doc_id for r in single.collect()} == keep_one([(r.doc_id, r.text) for r in good.collect()])
    clean = write_table(stages["secrets"](spark, single, DATA), "t3")
    assert {(r.doc_id, r.text, r.n_chars) for r in clean.collect()} == {(r.doc_id, t := mask(r.text), len(t)) for r in single.collect()}
    mixed = write_table(stages["mixing"](spark, clean, DATA), "t4")
    assert {r.doc_id for r in mixed.collect()} == draw_share(clean.collect())
    for stage in (good, single, clean, mixed):
        assert stage.columns == docs.columns
    last = corpus_pipeline.run(spark, DATA).collect()
    check_packing([(r.doc_id, r.text) for r in mixed.collect()], last)
