"""Plain Python versions of the pipeline's stages."""

import hashlib
import re
from collections import Counter

from haulgrid.llm import raking

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    words = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def keep_one(rows):
    """The smallest id of each component of texts with a similarity of 0.75 or more."""
    sets = {k: _shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {find(k) for k in sets}


def mask(text):
    from tests.llm.test_text_rules import spans

    out, at, merged = "", 0, []
    for s, _, e in spans(text):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += text[at:s] + "[SECRET]"
        at = e
    return out + text[at:]


def draw_share(rows):
    """Raking and sampling over all rows, cell by cell."""
    def topic(t, n):
        return "table" if " | " in t else "long" if n >= raking.LONG else "short" if n < raking.SHORT else "prose"

    info = [(r.doc_id, n := len(WORD.findall(r.text)), (r.source, r.lang, topic(r.text, n))) for r in rows]
    cells = Counter()
    for _, n, cell in info:
        cells[cell] += n
    total = sum(cells.values())
    weight, targets = dict.fromkeys(cells, 1.0), []
    for d in range(3):
        sums = Counter()
        for cell, n in cells.items():
            sums[cell[d]] += n
        roots = sum(v**0.5 for v in sums.values())
        targets.append({k: v**0.5 / roots for k, v in sums.items()})
    own = [Counter() for _ in range(3)]
    for cell, n in cells.items():
        for d in range(3):
            own[d][cell[d]] += n
    scarce = [own[d][k] / total / t for d in range(3) for k, t in targets[d].items() if t > 0]
    share = min([raking.SHARE, *[raking.HEADROOM * r for r in scarce if r > 0]])
    for _ in range(raking.SWEEPS):
        for d in range(3):
            mass = Counter()
            for cell, n in cells.items():
                mass[cell[d]] += n * weight[cell]
            for cell in cells:
                factor = targets[d][cell[d]] * total / mass[cell[d]] if mass[cell[d]] else 1.0
                weight[cell] = min(weight[cell] * factor, 1 / share)
    draw = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:13], 16) / 16**13
    return {k for k, _, cell in info if draw(k) < min(weight[cell] * share, 1)}
