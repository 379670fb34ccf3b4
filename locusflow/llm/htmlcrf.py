"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each block is described by its ancestors'
tags and class or id words and by its text; a two-state chain (main, rest) is trained on labelled pages by
maximum likelihood (forward-backward, Adam) and decoded by Viterbi. The labelled pages are made here from page
layouts with random words, so nothing but the block's surroundings and the shape of its text can be learned.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map
from locusflow.session import prepare

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>"
    r"|<(?P<cut>/?[a-zA-Z][^>]*+>?)",  # a quote or the tag is never closed: it ends at the next > or with the page, so no text is scanned again from every tag
    re.S | re.I,
)
_CUT = re.compile(r"/?(?P<tag>[a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements that bound a block, and elements without content.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary svg table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the second group.
CLOSES = {t: frozenset("p option optgroup select svg iframe".split()) for t in BLOCKS - {"button", "option", "optgroup", "title", "svg", "iframe"}} | {"option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
for _tag, _more in {"li": "li", "td": "td th", "th": "td th", "tr": "td th tr", "dd": "dd dt", "dt": "dd dt"}.items():
    CLOSES[_tag] |= frozenset(_more.split())


@dataclass
class Block:
    path: tuple[frozenset[str], str]  # words of all open block elements, and of the innermost; shared between blocks, whatever the depth
    text: str
    linked: int  # characters inside links


def _describe(tag: str, attrs: str) -> str:
    words = {tag}
    for name, *values in _ATTR.findall(attrs) if attrs.strip() else ():
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            words.add("#hidden")
        elif name in ("class", "id", "role"):
            words.update(f".{w}" for w in _NAME.findall(value))
    return " ".join(sorted(words))


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: references decoded, white space made single spaces, trimmed. Comments, scripts, styles and text areas are no text; every other element's text is a block's, closed or not."""
    out: list[Block] = []
    stack: list[tuple[str, str, frozenset[str]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block((stack[-1][2], stack[-1][1]) if stack else (frozenset(), ""), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(i: int):
        while len(stack) > i:
            opened[stack.pop()[0]] -= 1

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag, ends, attrs = m["tag"], m["end"], m["attrs"]
        if m["cut"] and m["cut"].endswith(">"):
            tag, ends, attrs = _CUT.match(m["cut"])["tag"], m["cut"].startswith("/"), ""
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if ends:
                if opened[tag] > 0:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                    in_link = 0
            else:
                closes = CLOSES.get(tag, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        close(i)
                    elif stack[i][0] != "p":
                        break
                if tag not in VOID:
                    own, held = _describe(tag, attrs), stack[-1][2] if stack else frozenset()
                    words = own.split()
                    stack.append((tag, own, held if held.issuperset(words) else held.union(words)))
                    opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_STOP = re.compile(r"[.!?…。][\"'»”)]*$")


def path_features(path: tuple[frozenset[str], str]) -> list[str]:
    """Ancestor tags and class words, the parent's once more."""
    words, parent = path
    return sorted({f"a:{w}" for w in words} | ({f"p:{w}" for w in parent.split()} or {"p:none"}))


def text_features(b: Block) -> list[str]:
    size = len(b.text)
    share = b.linked / size
    return [
        "t:len%d" % min(6, size.bit_length() // 2 if size < 4096 else 6),
        "t:link%d" % (0 if share < 0.1 else 1 if share < 0.6 else 2),
        "t:stop" if _STOP.search(b.text) else "t:nostop",
        "t:commas%d" % min(2, b.text.count(",")),
    ]


# ---- labelled pages

_MAIN = ['<article>', '<main>', '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<section class="entry">', '<div class="article-text">', '<article class="post">', '<main id="main"><div class="story">', '<div id="content"><div class="text">', '<div role="main">', '<div>']
_REST = {
    "menu": ['<nav>', '<div class="menu">', '<ul class="navbar">', '<div id="nav">', '<nav class="breadcrumb">', '<div role="navigation">', '<div class="links related">', '<div class="toc">'],
    "top": ['<header>', '<div class="header">', '<div id="masthead">', '<div class="banner">', '<header class="site-header">'],
    "bottom": ['<footer>', '<div class="footer">', '<div id="bottom">', '<footer class="site-footer">', '<div class="copyright">'],
    "side": ['<aside>', '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<div class="promo box">', '<div class="share social">', '<div class="author-bio">', '<div class="tags meta">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div class="alert">', '<div class="consent">', '<div class="popup modal">', '<div class="newsletter subscribe">', '<dialog>', '<div role="alert">', '<div hidden>', '<div style="display:none">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored">', '<div id="ad-slot">', '<aside class="ad">', '<div class="advertisement">', '<div class="promo">'],
    "form": ['<form>', '<form class="search">', '<div class="login"><form>', '<fieldset>', '<form id="newsletter">'],
    "comments": ['<section class="comments">', '<div class="comment">', '<div id="comments">', '<section id="comments"><div class="comment-body">', '<ol class="commentlist">', '<div class="reply">', '<div class="reader-comments">', '<article class="comment">', '<div class="comments"><article>'],
}


def _end(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opened)))


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and, for its leaf blocks in order, 1 if main text. Labels follow from the layout alone."""
    page, labels = [], []
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvéäñ") for _ in range(rng.randint(2, 9)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence() -> str:
        return words(3, 14).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(lo=1, hi=6) -> str:
        return (rng.choice([" ", " ", ", "])).join(sentence() for _ in range(rng.randint(lo, hi)))

    def leaf(tag: str, text: str, y: int):
        page.append(f"<{tag}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.8 else ""))
        labels.append(y)

    def rest(kind: str):
        opened = rng.choice(_REST[kind])
        page.append(opened)
        if kind == "menu" and not opened.startswith("<ul"):
            page.append("<ul>")
        for _ in range(rng.randint(2, 8) if kind == "menu" else rng.randint(1, 4)):
            link = f'<a href="/{word()}">{words(1, 3)}</a>'
            if kind == "menu":
                leaf("li", link, 0)
            elif kind == "form" and rng.random() < 0.3:
                page.append("<select>")
                for _ in range(rng.randint(1, 3)):
                    leaf("option", words(1, 2), 0)
                page.append("</select>")
            elif kind in ("notice", "ad", "side") and rng.random() < 0.1:
                control()
            elif kind in ("comments", "notice", "ad", "side"):
                leaf(rng.choice(["p", "div", "p"]), rng.choice([prose(1, 3), prose(1, 3), link, words(1, 6)]), 0)
            else:
                leaf(rng.choice(["p", "div", "p", "h1", "h2", "h3"][: 6 if kind == "top" else 3]), rng.choice([words(1, 5), prose(1, 2), link, "&copy; " + words(1, 3) + " &middot; " + prose(1, 2)]), 0)
        if kind == "menu" and not opened.startswith("<ul"):
            page.append("</ul>")
        page.append(_end(opened))

    def bare(kind: str):  # text right inside the container
        opened = rng.choice(_REST[kind])
        page.append(opened + rng.choice([words(1, 8), prose(1, 3)]) + _end(opened))
        labels.append(0)

    def control():  # a picture's name, a frame's substitute or a choice
        opened = rng.choice(['<svg><title>', '<iframe src="#">', "<select><option>"])
        page.append(opened + words(1, 6) + _end(opened))
        labels.append(0)

    busy = rng.random() < 0.85  # else a bare page: nothing but the story
    if busy or rng.random() < 0.3:
        page.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a='</p>';</script></head><body>")
        labels.append(0)
    if rng.random() < 0.3:
        page.append(rng.choice(['<div id="page">', '<div class="wrapper">', '<div class="container">']))
    for kind in ("top", "menu", "notice", "ad", "side", "form"):
        if busy and rng.random() < 0.5:
            (bare if kind in ("ad", "notice", "top", "side") and rng.random() < 0.5 else rest)(kind)
    opened = rng.choice(_MAIN[:2]) if rng.random() < 0.4 else rng.choice(_MAIN)
    page.append(opened)
    if rng.random() < 0.8:
        leaf(rng.choice(["h1", "h1", "h2"]), words(2, 10) + rng.choice(["", "", "."]), 1)
    for _ in range(rng.randint(1, 9)):
        z = rng.random()
        if z < 0.72:
            if rng.random() < 0.1:
                control()
            leaf("p", rng.choice(["", "<b>"]) + (prose(1, 8) if rng.random() < 0.85 else words(1, 12)) + rng.choice(["", "", "<br>"]), 1)
        elif z < 0.78:
            leaf(rng.choice(["h2", "h3"]), words(1, 8), 1)
        elif z < 0.86:
            tag = rng.choice(["ul", "ol"])
            page.append(f"<{tag}>")
            for _ in range(rng.randint(1, 5)):
                leaf("li", rng.choice([prose(1, 2), words(1, 8)]), 1)
            page.append(f"</{tag}>")
        elif z < 0.91:
            leaf(rng.choice(["blockquote", "pre"]), prose(1, 4), 1)
        elif z < 0.94:
            page.append("<table><tr>")
            for _ in range(rng.randint(1, 4)):
                leaf("td", words(1, 5), 1)
            page.append("</tr></table>")
        elif rng.random() < 0.4:
            control()
        elif rng.random() < 0.6:
            (bare if rng.random() < 0.5 else rest)(rng.choice(["ad", "side", "notice", "form"]))
    if rng.random() < 0.2:
        rest("comments")
    page.append(_end(opened))
    for kind in ("comments", "side", "ad", "menu", "form", "notice", "bottom"):
        if busy and rng.random() < (0.8 if kind == "bottom" else 0.35):
            (bare if kind in ("ad", "notice", "bottom", "side") and rng.random() < 0.5 else rest)(kind)
    page.append(rng.choice(["</body></html>", ""]))
    return "".join(page), labels


@dataclass
class Chain:
    weights: dict[str, float]  # evidence of a feature for main
    trans: np.ndarray  # [from, to]
    start: np.ndarray

    def labels(self, blocks: list[Block], memo: dict | None = None) -> list[int]:
        """The most likely labels (Viterbi)."""
        memo = {} if memo is None else memo
        w, n = self.weights, len(blocks)
        if not n:
            return []
        (t00, t01), (t10, t11) = self.trans.tolist()
        s0, s1 = self.start.tolist()
        back = []
        for i, b in enumerate(blocks):
            e = memo.get(b.path)
            if e is None:
                if len(memo) > 100_000:
                    memo.clear()
                e = memo[b.path] = sum(w.get(f, 0.0) for f in path_features(b.path))
            for f in text_features(b):
                e += w.get(f, 0.0)
            if i:
                a0, b0, a1, b1 = s0 + t00, s1 + t10, s0 + t01, s1 + t11
                back.append((int(b0 > a0), int(b1 > a1)))
                s0, s1 = max(a0, b0), max(a1, b1)
            s1 += e
        y = [int(s1 > s0)]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]


def fit(pages: list[tuple[str, list[int]]], steps: int = 120, l2: float = 1e-3) -> Chain:
    """Maximum-likelihood chain from (page, labels of its leaf blocks); pages whose labels do not match their blocks are left out."""
    seqs = []
    for page, y in pages:
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(y):
            seqs.append(([path_features(b.path) + text_features(b) for b in blocks], y))
    count: dict[str, int] = {}
    for fs, _ in seqs:
        for f in fs:
            for x in f:
                count[x] = count.get(x, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 3))}
    n, t = len(seqs), max((len(y) for _, y in seqs), default=1)
    mask, gold = np.zeros((n, t), bool), np.zeros((n, t), int)
    x = np.zeros((n, t, len(names)), np.float32)
    for i, (fs, y) in enumerate(seqs):
        mask[i, : len(y)], gold[i, : len(y)] = True, y
        for j, f in enumerate(fs):
            x[i, j, [names[k] for k in f if k in names]] = 1
    flat = x[mask]
    w, tr, st = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    theta_m = theta_v = None
    gt = np.zeros((2, 2))
    for j in range(1, t):
        on = mask[:, j]
        np.add.at(gt, (gold[on, j - 1], gold[on, j]), 1)
    gs = np.bincount(gold[mask[:, 0], 0], minlength=2) if n else np.zeros(2)
    for step in range(1, steps + 1):
        e = np.zeros((n, t, 2))
        e[mask, 1] = flat @ w.astype(np.float32)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = st + e[:, 0]
        for j in range(1, t):
            a[:, j] = np.where(mask[:, j, None], np.logaddexp(a[:, j - 1, 0, None] + tr[0], a[:, j - 1, 1, None] + tr[1]) + e[:, j], a[:, j - 1])
        for j in range(t - 2, -1, -1):
            nxt = e[:, j + 1] + b[:, j + 1]
            b[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(tr[:, 0] + nxt[:, 0, None], tr[:, 1] + nxt[:, 1, None]), b[:, j])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])
        g = flat.T @ (gold[mask] - p1[mask]).astype(np.float32) - l2 * n * w
        et = np.zeros((2, 2))
        for j in range(1, t):
            on = mask[:, j]
            pair = a[on, j - 1, :, None] + tr[None] + (e[on, j] + b[on, j])[:, None] - z[on, None, None]
            et += np.exp(pair).sum(0)
        first = np.stack([1 - p1[:, 0], p1[:, 0]], 1).sum(0)
        grad = np.concatenate([g, (gt - et).ravel(), gs - first]) / max(n, 1)
        theta = np.concatenate([w, tr.ravel(), st])
        theta_m = grad * 0.1 if theta_m is None else 0.9 * theta_m + 0.1 * grad
        theta_v = grad**2 * 0.01 if theta_v is None else 0.99 * theta_v + 0.01 * grad**2
        theta += 0.15 * (theta_m / (1 - 0.9**step)) / (np.sqrt(theta_v / (1 - 0.99**step)) + 1e-8)
        w, tr, st = theta[: len(names)], theta[len(names) : -2].reshape(2, 2), theta[-2:]
    return Chain({f: float(w[i]) for f, i in names.items()}, tr.copy(), st.copy())


@lru_cache(maxsize=2)
def default_chain(pages: int = 400, seed: int = 11) -> Chain:
    rng = random.Random(seed)
    return fit([labelled_page(rng) for _ in range(pages)])


def main_text(page: str | None, chain: Chain, memo: dict | None = None) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, y in zip(blocks, chain.labels(blocks, memo), strict=True) if y)


def extract(pages: DataFrame, chain: Chain | None = None, html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page's html, read whole whatever its length. Null or empty html, or a page without main text, gives an empty
    text. Labels of equal likelihood go to the rest. One row per row, repeats included; an empty table gives none; further columns play no part. No shuffle."""
    prepare(pages.sparkSession)
    model, memo = chain or default_chain(), {}
    kinds = dict(pages.dtypes)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(p, model, memo) for p in b.column("html").to_pylist()]
        return pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})

    return arrow_map(pages.select("page_id", "url", F.col(html_column).alias("html")), f, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
