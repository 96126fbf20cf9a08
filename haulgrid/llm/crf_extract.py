"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each block has binary features of
its ancestors' tags, of the words in their class, id and role attributes, and of its text. Two labels, main or not, form
the chain; weights are learned by maximum likelihood (forward-backward) and pages are decoded by Viterbi.

Labelled pages come from two places: pages of the table with exactly one ``article`` or ``main`` element label themselves, and
``made_pages`` composes pages of known parts, so that parts the table lacks are known too. On half of the pages the two
telling tags are hidden from the features, so that the rest of the features must carry the decision alone.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chosen_by_hash, map_arrow

#: Pages of the table and composed pages that are learned from.
PAGES = 400
MADE = 400

#: A comment, a declaration, a tag, or what looks like the start of one. Quotes count right after an equals sign only, and
#: a tag has no other ``<`` outside them: such a start is text.
_TAG = re.compile(
    r"""<!--|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/<>]*+)((?>[^<>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<(?=/?[A-Za-z!?])"""
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "template", "svg", "iframe", "textarea", "title", "annotation", "select", "button"}
_VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr input math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder "
    "munderover mstyle semantics".split()
)
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
TELLING = ("article", "main")
_TAGS = (
    "nav header footer aside form ul ol li table p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption section div dl address "
    "details dialog fieldset menu"
).split()
_NOT_MAIN = set(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login share sharing social related recommended "
    "sidebar side widget widgets comment comments disqus reply replies respond menu nav navbar navigation breadcrumb "
    "breadcrumbs footer foot header masthead topbar toolbar popup modal overlay dialog tags pagination pager search banner "
    "contentinfo complementary copyright legal skip author-box meta toc outbrain taboola trending popular".split()
)
_MAIN = set("article content post entry story body main text prose paragraph".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A leaf block: its text, the characters of it in links, and its ancestors' tags and marks."""

    text: str
    linked: int
    tags: frozenset
    marks: frozenset


def _marks(attributes: str) -> frozenset:
    """``not``, ``main`` and ``hidden``, as the words of class, id and role and the hiding attributes say."""
    out = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape("".join(values))
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & _NOT_MAIN:
                out.add("not")
            if words & _MAIN:
                out.add("main")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            out.add("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add("hidden")
    return frozenset(out)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; character references are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset]] = [("", frozenset(), frozenset())]
    parts: list[str] = []
    linked, in_link, at, head = 0, False, 0, False

    def close():
        nonlocal linked, parts
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, stack[-1][1], stack[-1][2]))
        linked, parts = 0, []

    def add(piece: str):
        nonlocal linked
        if piece and not head:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    while True:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found.group() == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if found.group() == "<":
            if page.find(">", at) < 0:  # a tag that the page's end cuts off
                break
            add("<")
            continue
        if found.group(2) is None:
            continue
        ends, tag, attributes = found.group(1) == "/", found.group(2).lower(), found.group(3)
        if tag in _RAW and not ends:
            if tag not in ("button", "textarea", "select", "annotation"):
                close()
            if not attributes.endswith("/"):
                shut = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = len(page) if not shut else shut.end()
            add(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            in_link = not ends
            continue
        if tag in _INLINE:
            continue
        close()
        in_link = False
        if tag == "head":
            head = not ends
            continue
        if tag == "body":
            head = False
        if tag in _VOID:
            continue
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if stack[-1][0] in _CLOSES.get(tag, ()):
            stack.pop()
        marks = _marks(attributes) if attributes else frozenset()
        stack.append((tag, stack[-1][1] | {tag}, stack[-1][2] | marks if marks else stack[-1][2]))
    close()
    return out


_NAMES = (
    ["bias", *TELLING, *_TAGS, "not", "main_mark", "hidden", "header_inside", "in_list_links"]
    + [f"words{k}" for k in range(4)] + [f"links{k}" for k in range(3)]
    + ["sentence", "copyright", "shouts"]
)
_AT = {n: i for i, n in enumerate(_NAMES)}


def block_features(blocks: list[Block]) -> list[list[int]]:
    """The numbers of the features that hold for each block."""
    out = []
    for b in blocks:
        n, share = len(b.text.split()), b.linked / max(len(b.text), 1)
        own = [0, *[_AT[t] for t in b.tags if t in _AT]]
        own += [_AT[m] for m in ("not", "hidden") if m in b.marks] + [_AT["main_mark"]] * ("main" in b.marks)
        own.append(_AT[f"words{0 if n < 4 else 1 if n < 11 else 2 if n < 26 else 3}"])
        own.append(_AT[f"links{0 if share < 0.3 else 1 if share < 0.7 else 2}"])
        if "header" in b.tags and b.tags & {"article", "main"}:
            own.append(_AT["header_inside"])
        if "li" in b.tags and share >= 0.7:
            own.append(_AT["in_list_links"])
        if b.text[-1] in ".!?…:;\"'”»":
            own.append(_AT["sentence"])
        if "©" in b.text:
            own.append(_AT["copyright"])
        if b.text.isupper():
            own.append(_AT["shouts"])
        out.append(own)
    return out


@dataclass
class Chain:
    """Weights of the label main for each feature, and scores of label pairs; label 1 is main."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely ones, not main."""
        w, ((m00, m01), (m10, m11)) = self.weights, self.moves.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for i, own in enumerate(features):
            gain = sum(w[k] for k in own)
            if i == 0:
                s0, s1 = 0.0, gain
                continue
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0), max(a1, b1) + gain
        if not features:
            return []
        out = [int(s1 > s0)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 150, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps (Adam) over all pages at once; without pages all weights are 0."""
    pages = [p for p in pages if p[0]]
    chain = Chain(np.zeros(len(_NAMES)), np.zeros((2, 2)))
    if not pages:
        return chain
    longest, n = max(len(f) for f, _ in pages), len(pages)
    y, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)], live[i, : len(labels)] = labels, True
    x = np.zeros((live.sum(), len(_NAMES)), np.float32)
    for row, own in zip(x, (own for features, _ in pages for own in features)):
        row[own] = 1
    theta = np.zeros(len(_NAMES) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    true = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            true[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum()
    for step in range(1, rounds + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        gain = np.zeros((n, longest, 2))
        gain[live, 1] = x @ weights
        forward, backward = np.zeros_like(gain), np.zeros_like(gain)
        forward[:, 0] = gain[:, 0]
        for t in range(1, longest):
            go = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + gain[:, t]
            forward[:, t] = np.where(live[:, t, None], go, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(moves + (gain[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(live[:, t + 1, None], go, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[live]
        pair = np.exp(
            forward[:, :-1, :, None] + moves + (gain + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * live[:, 1:, None, None]
        slope = np.concatenate([x.T @ (y[live] - main), (true - pair.sum(axis=(0, 1))).reshape(-1)])
        slope = slope / live.sum() - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def own_labels(blocks: list[Block], page: str) -> list[int] | None:
    """Labels by a page's only ``article`` or ``main`` element; None if it has none or several."""
    if len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
        return None
    apart = {"nav", "footer", "aside", "form", "dialog", "menu"}
    return [int(bool(b.tags & set(TELLING)) and not b.tags & apart and not b.marks & {"not", "hidden"}) for b in blocks]


def made_pages(number: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Composed pages with the label of each leaf block."""
    rnd = random.Random(seed)
    vowels, consonants = "aeiou", "bcdfghklmnprstvw"

    def word():
        return "".join(rnd.choice(consonants) + rnd.choice(vowels) for _ in range(rnd.randint(1, 4)))

    def words(a, b):
        return " ".join(word() for _ in range(rnd.randint(a, b)))

    def sentence(a, b):
        return words(a, b).capitalize() + "."

    def links(n):
        return "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(n))

    def note(tag, *names):
        mark = rnd.choice(names)
        inner = rnd.choice([sentence(3, 14), f"<p>{sentence(4, 20)}</p>", f"<span>{words(1, 4)}</span>"])
        return f'<{tag} {rnd.choice(["class", "id"])}="{mark}">{inner}</{tag}>', [0]

    def apart():
        k, n = rnd.randrange(9), rnd.randint(2, 8)
        if k == 0:
            return f"<nav><ul>{links(n)}</ul></nav>", [0] * n
        if k == 1:
            return f'<div class="{rnd.choice(["menu", "breadcrumbs", "related-posts", "share"])}"><ul>{links(n)}</ul></div>', [0] * n
        if k == 2:
            return note("div", "ad", "ads-box", "advert", "banner", "sponsored", "promo")
        if k == 3:
            return note("div", "cookie-notice", "consent", "newsletter", "popup", "alert")
        if k == 4:
            return f"<form><label>{words(1, 3)}</label><input><p>{words(1, 6)}</p></form>", [0, 0]
        if k == 5:
            return f"<aside><h3>{words(1, 3)}</h3><p>{sentence(5, 25)}</p></aside>", [0, 0]
        if k == 6:
            body = "".join(f"<p>{sentence(3, 30)}</p>" for _ in range(n))
            return f'<div class="{rnd.choice(["comments", "comment-list", "replies"])}"><h3>{words(1, 2)}</h3>{body}</div>', [0] * (n + 1)
        if k == 7:
            return note("div", "sidebar", "widget", "social", "login")
        return note("section", "related", "comments", "newsletter", "promo")

    def main_part():
        k = rnd.randrange(9)
        if k < 5:
            return f"<p>{' '.join(sentence(2, 18) for _ in range(rnd.randint(1, 6)))}</p>", [1]
        if k == 5:
            return f"<h2>{words(1, 6)}</h2>", [1]
        if k == 6:
            n = rnd.randint(2, 5)
            return f"<ul>{''.join(f'<li>{words(2, 12)}</li>' for _ in range(n))}</ul>", [1] * n
        if k == 7:
            return f"<blockquote>{sentence(4, 20)}</blockquote>", [1]
        return f"<p>{words(1, 3)}.</p>", [1]

    out = []
    for _ in range(number):
        parts = [(f"<header><div>{words(1, 3)}</div></header>", [0])] if rnd.random() < 0.5 else []
        parts += [apart() for _ in range(rnd.randint(0, 3))]
        tag = rnd.choice(["<article>", "<main>", '<div class="content">', '<div id="post-body">', "<div>", "<section>"])
        head = f"<h1>{words(2, 8)}</h1>"
        parts.append((tag + (f"<header>{head}</header>" if rnd.random() < 0.2 else head), [1]))
        for _ in range(rnd.randint(1, 14)):
            parts.append(apart() if rnd.random() < 0.08 else main_part())
        parts.append(("</" + re.match(r"<(\w+)", tag).group(1) + ">", []))
        parts += [apart() for _ in range(rnd.randint(0, 3))]
        if rnd.random() < 0.7:
            parts.append((f"<footer>&copy; {word()}.example {sentence(1, 8)}</footer>", [0]))
        out.append(("<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [x for _, y in parts for x in y]))
    return out


def train(pages: DataFrame, html: str = "html", number: int = PAGES, made: int = MADE) -> Chain:
    """Learn from about ``number`` different pages of the table, by the hash of their markup, and ``made`` composed ones."""
    rows = pages.filter(F.col(html).rlike("(?i)<(article|main)[ >]")).select(F.col(html).alias("h"), F.xxhash64(html).alias("k"))
    found = rows.filter(chosen_by_hash(F.col("k"), number, rows.count()))
    taken = sorted(found.groupBy("k").agg(F.first("h").alias("h")).collect())
    known = [(leaf_blocks(r.h), own_labels(leaf_blocks(r.h), r.h)) for r in taken]
    for page, labels in made_pages(made):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a composed page does not have the blocks it was made of")
        known.append((blocks, labels))
    telling = {_AT[t] for t in (*TELLING, "header_inside")}
    sequences = []
    for i, (blocks, labels) in enumerate(k for k in known if k[1] is not None):
        features = block_features(blocks)
        sequences.append(([[k for k in own if i % 2 or k not in telling] for own in features], labels))
    return fit(sequences)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(block_features(blocks))) if label)


def extract(pages: DataFrame, chain: Chain, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` (all but the markup if None) with text and n_chars (code points).

    The whole markup is read. NULL and empty markup, and markup without main blocks, give an empty text. Markup that
    breaks off keeps what comes before. Repeated rows give equal results; result names replace columns of ``pages``.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py(), chain) for h in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    rows = pages.select(*keep, F.col(html).alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_arrow(rows, run, (kinds + ", " if kinds else "") + "text string, n_chars long")
