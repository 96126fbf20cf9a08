"""Secrets, repetition and word arrays against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import entropy_secrets as secrets
from haulgrid.llm import suffix_repetition as repetition
from haulgrid.llm.word_arrays import Words, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def entropy_spans(text):
    """Every window counted from scratch."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        c = m[0]
        if len(c) < 20 or not re.search("[0-9]", c) or not re.search("[A-Za-z]", c):
            continue
        runs = []
        for i in range(len(c) - 19):
            w = judged = c[i : i + 20]
            if w.isalnum():
                a, b = i, i + 20
                while a and c[a - 1].isalnum():
                    a -= 1
                while b < len(c) and c[b].isalnum():
                    b += 1
                judged = c[a:b]
            if judged == w and not w.isalnum() or not (re.search("[0-9]", judged) and re.search("[A-Za-z]", judged)):
                judged = c
            if any(re.search(p, judged) for p in secrets.ALLOWED):
                continue
            bits = next(b for p, b in secrets.CLASS_BITS if re.search(p, judged))
            if sum(round(n * math.log2(n) * secrets.UNIT) for n in map(w.count, set(w))) <= secrets.entropy_limit(bits):
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 20
                else:
                    runs.append([i, i + 20])
        out += [(m.start() + a, 3, m.start() + b) for a, b in runs]
    return out


def spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out + entropy_spans(t))


TEXTS = [
    None, "", " ", "password=abcdefghijkl", "PASSWORD = 'Zm9vYmFyYmF6cXV4MTIz' and token: short", "éé token=" + "x" * 40,
    "token: api_key: 0123456789abc", "AKIA" + "Q" * 14 + " AKIAXX AKIA" + "A1" * 20, "0123456789abcdef" * 3 + "g0123456789abcde",
    "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "id 550e8400-e29b-41d4-a716-446655440000 at 2024-05-06T10-11-12",
    "key kJ8s9Qw2Zx7Lm4Np1Rt6Vb3YcD5 end", "sk-" + "aB3dE5fG7hI9" * 4, "mixed-words-and-2024-numbers-in-a-row", "\U0001f600 secret=\"abcd.efgh/ijkl=\"",
    "aaaaaaaaaaaaaaaaaaaa1" + "kJ8s9Qw2Zx7Lm4Np1Rt6", "pwd=5F3A9C07E1B2D4865F3A9C07E1B2D486 sample=kJ8s9Qw2Zx7Lm4Np1Rt6Vb3Y",
    "example/kJ8s9Qw2Zx7Lm4Np1Rt6/dummy_A7C4E9B2D1F60835A7C4 examplekJ8s9Qw2Zx7Lm4Np1Rt6 x=550e8400-e29b-41d4-a716-446655440000", "word " * 30000 + "api-key apikey=0011223344556677",
]


def test_spans(spark):
    rnd = random.Random(3)
    noise = ["".join(rnd.choice("abAB01+/=_-. :'token") for _ in range(200)) for _ in range(60)]
    noise += ["".join(rnd.choice("0123456789abcdefXYZ") for _ in range(rnd.randint(15, 90))) for _ in range(60)]
    rows = [(i, t, "keep") for i, t in enumerate(TEXTS + noise)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, secret_spans string")
    got = secrets.scan_secrets(df).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert [tuple(s) for s in r.secret_spans] == spans(r.text), r.text
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_values_behind_names_and_paths(spark):
    """What is found alone is found behind a name or path; numbers, words and ids there stay."""
    rnd = random.Random(11)
    values = ["".join(rnd.choices("0123456789ABCDEF", k=k)) for k in (32, 40, 64) for _ in range(40)]
    values += ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)) for _ in range(40)]
    fronts = ["pwd=", "auth=", "signature=", "/v1/files/", "a_b-c=", ""]
    rows = [(i, f + v + end) for i, v in enumerate(values) for f in fronts for end in ("", "/x")]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    alone = {r.doc_id: [(s.s, s.e) for s in r.secret_spans] for r in got if r.text == values[r.doc_id]}
    assert sum(map(bool, alone.values())) > 0.95 * len(values)
    for r in got:
        at = r.text.index(values[r.doc_id])
        held = {p for s in r.secret_spans for p in range(s.s - at, s.e - at)}
        assert all(p in held for a, b in alone[r.doc_id] for p in range(a, b)), r.text
    clean = ["id=12345678901234567890123", "x1=" + "internationalizationsupport", "id=550e8400-e29b-41d4-a716-446655440000"]
    df = spark.createDataFrame(enumerate(clean), "doc_id int, text string")
    assert not [s for r in secrets.scan_secrets(df).collect() for s in r.secret_spans if s.k == 3]


def test_allow_list_goes_by_parts(spark):
    """Random keys behind an allowed word are found as they are alone; the word inside the key's own part still allows it."""
    rnd = random.Random(8)
    keys = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(60)]
    fronts = ["", "sample=", "example/", "dummy_", "path/to/example/"]
    rows = [(i, j, front + key) for i, key in enumerate(keys) for j, front in enumerate(fronts)] + [(-1, 0, "example" + keys[0])]
    df = spark.createDataFrame(rows, "doc_id int, f int, text string")
    got = {(r.doc_id, r.f): {(s.s, s.e) for s in r.secret_spans if s.k == 3} for r in secrets.scan_secrets(df).collect()}
    assert not got.pop((-1, 0))
    for (i, j), own in got.items():
        assert own and own == {(s + len(fronts[j]), e + len(fronts[j])) for s, e in got[i, 0]}


def test_redact(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in secrets.redact(df).collect():
        text, at, want = TEXTS[r.doc_id], 0, ""
        merged = []
        for s, _, e in spans(text):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            want += text[at:s] + "[SECRET]"
            at = e
        assert r.text == (None if text is None else want + text[at:])


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest = 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    return n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), longest


def test_repetition():
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a", "a b\na b\n \n \nc", "é ü\x0bé ü", "x " * 70, "# * $\x0c| <>\n\n#"]
    for size in (1, 2, 3, 8):
        texts += [rnd.choice(" \n\t").join(rnd.choice("abcdefgh"[:size]) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    found = repetition.measure(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
    for i, text in enumerate(texts):
        assert tuple(int(found[k][i]) for k in names) == brute(text), repr(text)
        edges = found["repeat_spans"][i]
        assert sum(edges[1::2]) - sum(edges[::2]) == found["n_repeat_words"][i]


def test_judgement(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, "a b c d e " * 20), (5, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {(r.doc_id, r.base_failed, r.kept) for r in repetition.judge_repetition(df).collect()}
    assert got == {(1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, True, False)}
    assert repetition.judge_repetition(df.limit(0)).count() == 0
    long = good + " x" * 3 + " " + " ".join(f"v{i % 70}" for i in range(90)) + " " + " ".join(f"u{i}" for i in range(900))
    assert repetition.judge_repetition(spark.createDataFrame([(1, long)], "doc_id long, text string"), max_longest=10).first().kept is False


def brute_characters(text, min_chars):
    """Characters of words in repeats, the longest repeat in characters and the text's, all by comparing pairs of places."""
    words = list(WORD.finditer(text or ""))
    if not words:
        return 0, 0, 0
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k].group() == words[j + k].group():
                k += 1
                size = words[i + k - 1].end() - words[i].start()
                longest = max(longest, size)
                if k >= 5 or size >= min_chars:
                    covered |= set(range(i, i + k))
    return sum(len(words[i].group()) for i in covered), longest, words[-1].end() - words[0].start()


def test_repetition_in_characters():
    rnd = random.Random(6)
    texts = [None, "", " ", "a", "éé éé éé", " the" * 30 + "\n", "abcdefgh ijklmnop\tabcdefgh ijklmnop", "abcdefgh  ijklmnop abcdefgh ijklmnop"]
    texts += [rnd.choice([" ", "\n", "  "]).join(rnd.choice(["a", "bé", "c" * 9, "ü" * 17]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    for floor in (3, 16):
        found = repetition.measure(pa.array(texts, pa.string()), min_chars=floor)
        for i, text in enumerate(texts):
            got = tuple(int(found[k][i]) for k in ("covered_chars", "longest_chars", "text_chars"))
            assert got == brute_characters(text, floor), repr(text)


def test_verdict_differs_from_the_base_rule(spark):
    words = [f"word{i}" for i in range(60)]
    stutter = " ".join(" ".join([w] * 4) for w in words)
    link = "https://example.org/" + "a" * 80
    rows = [(1, " ".join(words)), (2, stutter), (3, " ".join([link, *words[:10], link])), (4, " ".join([*words, *[w + "x" for w in words], *[w + "y" for w in words], link, link]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.judge_repetition(df).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, True)}
    loose = repetition.judge_repetition(df, max_covered_percent=100, max_longest_percent=100)
    assert all(r.kept for r in loose.collect())


@pytest.mark.parametrize("text", ["", "a", " Ab  cD\n", "é" * 5 + " \x0b z", "\x85x\xa0y"])
def test_words(text):
    for _, data, offsets in chunks(pa.array([text, None, text])):
        found = Words(data, offsets)
        words = [data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
        assert words == WORD.findall(text) * 2
        h = found.hashes(lower=True)
        assert len(np.unique(h)) == len({w.translate({i: i + 32 for i in range(65, 91)}) for w in words})
