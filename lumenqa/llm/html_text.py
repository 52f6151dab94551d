"""HTML main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags.  Features of a block come
from its ancestor tags (names, classes, ids, roles) and from its text (length, link share,
punctuation).  A two-label chain, trained on labelled pages by gradient ascent on the conditional
likelihood and decoded by Viterbi, keeps the article's blocks.

The labelled pages are made here (:func:`labelled_pages`): layouts of many kinds with made-up words,
where the truth of each block is known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, tidied

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Formulas are text of the paragraph they stand in; of an annotation (their source in another notation) nothing is shown.
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics".split()
)
ANNOTATION = ("annotation", "annotation-xml")
#: What may stand in a head; any other start tag, or text, ends an open one.
IN_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template svg head title object iframe canvas audio video textarea select option datalist button".split())
RAW = frozenset("script style textarea title".split())
#: Without an end tag these would hide the rest of the page; such a start tag is passed over.
NEEDS_END = HIDDEN - {"script", "style", "svg", "head"}
#: A start tag here ends an open p; the others end an open element of their own kind.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What can't stand in a drawing: a start tag here ends an open one, unless that holds foreign content.
NO_DRAWING = CLOSES_P | frozenset("body br center dd dt embed img li td th tr".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("td", "th", "li", "div", "section", "article", "main", "body", "aside", "blockquote")}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str
    names: tuple[str, ...]
    linked: int


class _Open:
    """The open elements, the names of all of them and how many are hidden, kept up at each step."""

    def __init__(self) -> None:
        self.items: list[tuple[str, tuple[str, ...]]] = []
        self.names: dict[str, int] = {}
        self.hidden = 0

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        self.items.append((tag, marks))
        self.hidden += tag in HIDDEN
        for name in ("t:" + tag, *marks):
            self.names[name] = self.names.get(name, 0) + 1

    def cut(self, at: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.items) > at:
            tag, marks = self.items.pop()
            self.hidden -= tag in HIDDEN
            for name in ("t:" + tag, *marks):
                self.names[name] -= 1
                if not self.names[name]:
                    del self.names[name]

    def has(self, tag: str) -> bool:
        return "t:" + tag in self.names

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Closes the innermost of ``tags``, if one is open inside the innermost of ``scope``."""
        if any(map(self.has, tags)):
            for i in range(len(self.items) - 1, -1, -1):
                if self.items[i][0] in tags:
                    self.cut(i)
                    return
                if self.items[i][0] in scope:
                    return

    def end_head(self) -> None:
        if self.items and self.items[-1][0] == "head":
            self.cut(len(self.items) - 1)


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order; null and empty pages have none.

    Broken markup is read about as browsers do: an end tag closes what is open inside its element
    and is ignored if there is none, a peer or a block ends an open item or paragraph, the first
    content ends an open head, and ``<svg/>`` is empty.  Content goes on after a hidden element that
    is never closed (a script or style sheet excepted: it is the rest of the page).
    """
    page = page or ""
    out: list[Block] = []
    stack = _Open()
    buffer: list[str] = []
    linked = depth = at = 0
    last_ends: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append(Block(text, stack.items[-1][0] if stack.items else "body", tuple(stack.names), min(linked, len(text))))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if stack.hidden and piece.strip():
            stack.end_head()
        if piece and not stack.hidden:
            buffer.append(piece)
            if depth:
                linked += len(piece)

    def ends_later(tag: str) -> bool:
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_ends[tag] >= at

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, start)
        if not m:  # a bare "<" is text
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag not in IN_HEAD:
            stack.end_head()
        if tag in ANNOTATION:
            end = None if closing else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else at
            continue
        if not closing and tag in NO_DRAWING and stack.has("svg") and not stack.has("foreignobject"):
            stack.close(("svg",))
        if tag in INLINE or tag in MATH:
            if tag == "br":
                text(" ")
            elif tag == "a":
                depth = 0 if closing else 1
            continue
        flush()
        depth = 0
        if closing:
            stack.close((tag,))
            continue
        if tag in VOID or (tag == "svg" and m[3].endswith("/")) or (tag in NEEDS_END and not ends_later(tag)):
            continue
        for peers, scope in _closed_by(tag):
            stack.close(peers, scope)
        stack.push(tag, _marks(m[3]))
        if tag in RAW:  # no tags inside
            end = re.compile(rf"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


@lru_cache(maxsize=256)
def _closed_by(tag: str) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    out = []
    if tag in CLOSES_P:
        out.append((("p",), SCOPES["p"]))
    if tag in PEERS:
        out.append((PEERS[tag], SCOPES.get(tag, ())))
    return tuple(out)


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[str, ...]:
    """The words of classes, ids and roles."""
    names = (word.lower() for m in ATTRIBUTE.finditer(attributes) for word in NAME.findall(m[2] or m[3] or m[4] or ""))
    return tuple(dict.fromkeys("c:" + n for n in names))


def features(found: list[Block]) -> list[list[str]]:
    """The feature names of each block."""
    out = []
    first = next((i for i, b in enumerate(found) if b.tag in ("h1", "h2")), len(found))
    for i, b in enumerate(found):
        n, link = len(b.text.split()), b.linked / max(1, len(b.text))
        out.append(
            [
                "bias", "own:" + b.tag, *b.names,
                f"words:{min(7, n.bit_length())}", "links:" + ("none" if not link else "some" if link < 0.5 else "most"),
                "end:" + (b.text[-1] if b.text[-1] in ".!?:;" else "a" if b.text[-1].isalnum() else "o"),
                "copyright" if "©" in b.text else "plain", "before" if i < first else "after",
            ]
        )
    return out


class Chain:
    """Weights by feature name for label 1 against label 0, and the transition scores."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels."""
        (a00, a01), (a10, a11) = self.moves.tolist()
        get, back, s0, s1 = self.weights.get, [], 0.0, 0.0
        for i, names in enumerate(rows):
            e = sum(get(x, 0.0) for x in names)
            if i:
                f0, f1 = s0 + a00 >= s1 + a10, s0 + a01 > s1 + a11
                s0, s1 = (s0 + a00 if f0 else s1 + a10), (s0 + a01 if f1 else s1 + a11)
                back.append((0 if f0 else 1, 0 if f1 else 1))
            s1 += e
        if not rows:
            return []
        out = [int(s1 > s0)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 250, rate: float = 0.2, decay: float = 0.0002) -> Chain:
    """Adam on the mean conditional log-likelihood, by forward and backward over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = {n: i for i, n in enumerate(sorted({n for rows, _ in pages for r in rows for n in r}))}
    longest = max((len(r) for r, _ in pages), default=0)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, mask = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, (rows, labels) in enumerate(pages):
        for t, r in enumerate(rows):
            x[p, t, [names[n] for n in r]] = 1
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    n = max(1, mask.sum())
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, rounds + 1):
        emit = np.stack([np.zeros(mask.shape), x @ w], axis=2) * mask[:, :, None]
        ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], nxt, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            later = emit[:, t + 1] + behind[:, t + 1]
            prev = np.logaddexp(later[:, None, 0] + moves[:, 0], later[:, None, 1] + moves[:, 1])
            behind[:, t] = np.where(mask[:, t + 1, None], prev, 0)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * mask
        grad = np.einsum("pt,ptf->f", (y - one) * mask, x)
        joint = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.where(pairs[:, :, None, None], joint, -np.inf))).sum((0, 1))
        g = np.concatenate([grad, (seen - expected).ravel()]) / n - decay * np.concatenate([w, moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    return Chain({k: float(w[i]) for k, i in names.items()}, moves)


#: Names that page authors give to what is not the article; used to lay out labelled pages.
ASIDE = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination toc links tabs",
    "header": "header masthead banner top topbar logo branding site-header",
    "footer": "footer bottom copyright legal site-footer colophon credits",
    "aside": "sidebar aside widget related recommended popular trending more tags rail author-box",
    "notice": "cookie cookie-notice consent notice alert gdpr banner-cookie privacy popup modal overlay disclaimer toast warning",
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad commercial sponsor adsbox partner",
    "form": "newsletter subscribe signup login search contact form feedback register poll survey",
    "comments": "comments comment comment-list reader-comments discussion replies reply disqus responses user-comment",
    "social": "share social sharing follow buttons like",
}
MAIN = "article post content entry entry-content story body-text main-content article-body text post-body page".split()


def labelled_pages(n: int = 600, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """Made-up pages and the texts of their article's blocks; words are any letters."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouäéó") for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int, dot: str = ".") -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + (dot if rng.random() < 0.9 else "")

    def mark(kind: str) -> str:
        return rng.choice(ASIDE[kind].split())

    def links(k: int) -> str:
        if rng.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3, "")}</a></li>' for _ in range(k)) + "</ul>"
        return " ".join(f'<a href="#">{words(1, 2, "")}</a>' for _ in range(k))

    def boxed(kind: str, inner: str) -> str:
        named = f'{rng.choice(("class", "class", "id"))}="{mark(kind)}{rng.choice(("", " box", "-wrapper", "-1"))}"'
        real = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if real and rng.random() < 0.65:
            return f"<{real}{rng.choice(('', ' ' + named))}>{inner}</{real}>"
        tag = rng.choice(("div", "div", "section", "aside" if kind in ("ad", "notice", "social") else "div", cell or "ul"))
        return f"<{tag} {named}>{inner}</{tag}>"

    def block(kind: str) -> str:
        if kind == "nav":
            return boxed(kind, links(rng.randint(2, 8)))
        if kind == "form":
            return boxed(kind, f"<p>{words(2, 12)}</p><label>{words(1, 2, '')}</label><input type=text><button>{word()}</button>")
        if kind == "comments":
            each = "".join(rng.choice((f"<p>{words(4, 40)}</p>", f'<div class="comment"><b>{word()}</b><p>{words(3, 50)}</p></div>', f"<li>{words(4, 30)}</li>")) for _ in range(rng.randint(1, 4)))
            return boxed(kind, f"<h{rng.randint(2, 4)}>{words(1, 2, '')}</h3>" * (rng.random() < 0.5) + each)
        if kind == "footer":
            return boxed(kind, rng.choice((f"&copy; {word()}.example.com &middot; {words(3, 14)}", f"<p>{words(3, 20)}</p>", links(3) + f"<p>&copy; {words(2, 6)}</p>", words(3, 10))))
        if kind == "header":
            return boxed(kind, rng.choice((f"<div>{words(1, 4, '')}</div>", f"<p>{words(1, 6, '')}</p>", links(3), f"<h2>{words(1, 3, '')}</h2><p>{words(3, 9)}</p>")))
        inner = rng.choice((words(3, 30), f"<p>{words(3, 40)}</p>", f"<h3>{words(1, 4, '')}</h3><p>{words(3, 25)}</p>", links(rng.randint(2, 5))))
        return boxed(kind, inner)

    cell = ""  # in pages laid out as a table, its cells are boxes
    for _ in range(n):
        truth: list[str] = []
        cell = "td" if rng.random() < 0.12 else ""

        def own(tag: str, a: int, b: int, truth: list[str] = truth) -> str:
            text = words(a, b)
            truth.append(text)
            shown = text
            if rng.random() < 0.25:
                cut = text.split(" ", 1)
                shown = f"<{(t := rng.choice(('b', 'i', 'em', 'a')))}>{cut[0]}</{t}> {cut[1]}" if len(cut) > 1 else text
            if rng.random() < 0.2:  # inline elements that are never closed, or hold a whole block
                shown = rng.choice(("<b>{}", "<i>{}<br>", "<span>{}<br/>", "<font size=2>{}", "<a name=x></a>{}", "<em><b>{}</b>", "{}<br><br>", "<strong>{}</strong>")).format(shown)
            return f"<{tag}>{shown}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "")

        inner = own("h1", 1, 9) if rng.random() < 0.85 else ""
        kinds = [k for k in ASIDE if rng.random() < 0.3]
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.75:
                inner += own("p", 1, 70)
            elif r < 0.82:
                inner += own("h2", 1, 6)
            elif r < 0.9:
                inner += "<ul>" + "".join(own("li", 2, 20) for _ in range(rng.randint(1, 4))) + "</ul>"
            elif r < 0.94:
                inner += "<blockquote>" + own("p", 3, 30) + "</blockquote>"
            elif r < 0.96:
                inner += "<table><tr>" + own("td", 1, 6) + own("td", 1, 6) + "</tr></table>"
            elif r < 0.97:
                inner += "<dl>" + own("dt", 1, 4) + own("dd", 3, 20) + "</dl>"
            elif r < 0.985:
                inner += own("pre", 1, 12)
            else:
                inner += "<figure><img src=x>" + own("figcaption", 2, 12) + "</figure>"
            if rng.random() < 0.12 and (inside := rng.choice(("ad", "aside", "form", "social", "notice", "nav"))):
                inner += block(inside)
        if "comments" in kinds and rng.random() < 0.5:
            inner += block("comments")
            kinds.remove("comments")
        if rng.random() < 0.25:
            inner = f"<section>{inner}</section>"
        elif rng.random() < 0.2:
            inner = f'<div class="{rng.choice(MAIN)}">{inner}</div>'
        shape = rng.random()
        if shape < 0.55:
            body = f"<article>{inner}</article>"
        elif shape < 0.7:
            body = f"<main>{inner}</main>"
        elif shape < 0.9:
            body = f'<div class="{rng.choice(MAIN)}">{inner}</div>'
        else:
            body = inner
        if rng.random() < 0.2:
            body = f'<div class="{rng.choice(("wrapper", "container", "page", "layout", "row"))}">{body}</div>'
        above = [block(k) for k in kinds if k in ("nav", "header", "notice", "ad", "aside", "form") and rng.random() < 0.7]
        below = [block(k) for k in kinds if k in ("footer", "aside", "ad", "comments", "form", "notice", "social", "nav") and rng.random() < 0.8]
        rng.shuffle(below)
        if cell:
            tr = lambda x: f"<tr>{x if x.startswith('<td') else f'<td>{x}</td>'}</tr>"
            above, body, below = ["<table>", *map(tr, above)], tr(f"<td>{body}</td>"), [*map(tr, below), "</table>"]
        yield f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(above)}{body}{''.join(below)}</body></html>", truth


def aligned(page: str, truth: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page: the true texts are found in order."""
    found, at, labels = blocks(page), 0, []
    for b in found:
        hit = at < len(truth) and b.text == truth[at]
        labels.append(int(hit))
        at += hit
    return features(found), labels


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return fit([aligned(p, t) for p, t in labelled_pages()])


def main_text(page: str | None, chain: Chain) -> str:
    """The kept blocks, one a line; the empty string if there are none."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, chain.decode(features(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null, empty and textless pages give the empty text; broken markup is read as :func:`blocks` says.
    Repeated rows give repeated results, null ids and addresses stay null, and an empty table gives
    an empty result.  Only the three columns are read.
    """
    chain = chain or default_chain()
    shared = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.moves))  # a few hundred numbers
    types = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Batches) -> Batches:
        model = Chain(*shared.value)
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tidied(run), f"page_id {types[0]}, url {types[1]}, text string, n_chars long")
