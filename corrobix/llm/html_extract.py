"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of text blocks, each with the path of open elements. A bidirectional LSTM in numpy reads the hashed
path and words of every block and labels it as article or not, with the whole page as context. It is trained here, on
generated page layouts and on a bounded sample of the table's own pages labelled by their semantic elements.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bounds of the training set: the table's own pages (and their length), generated pages.
OWN_PAGES, OWN_CHARS, MADE_PAGES = 200, 60_000, 800
BUCKETS, EMBED, HIDDEN, EPOCHS = 1024, 16, 20, 12
_NUMBERS = 5
#: Tokens pooled apart as the innermost elements; the whole path is pooled beside them.
_INNER = 12
#: What is pooled for a block, in the order of `features`, and by which power of their number tokens share.
_POOLED = (("path", 1), ("word", 1), ("whole", 0.5), ("name", 0.5))

# Every part is possessive, so a match takes one pass. Quotes bind after an equals sign only; the second form knows none.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element kinds of HTML.
_RAW = ("script", "style", "noscript", "template", "iframe", "svg")
_CODE = ("script", "style")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_OTHER_TAGS = ("nav", "footer", "aside", "form", "button")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_CLOSES_P = _BREAKS - frozenset("button label legend option optgroup select summary textarea title td th tr caption tbody thead tfoot body head html".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tr td th tbody thead tfoot div section article nav aside header footer main form body blockquote".split())


@dataclass
class Block:
    text: str
    linked: float
    inner: list[int]  # hashed tokens of the innermost elements
    whole: list[int]  # those of all open elements, each once
    names: list[int]  # of these the ones that many pages use for parts
    own: bool | None  # in an article and in no named other part; none if no article is open
    node: tuple | None = field(default=None, repr=False)

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of the open elements from the outside in."""
        out, node = [], self.node
        while node:
            out.append(node[1])
            node = node[0]
        return tuple(t for tokens in reversed(out) for t in tokens)


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            for word in re.split(r"[\s_-]+", next((v for v in values if v), "").lower()):
                if word:
                    out.append(f"{name.lower()}:{word}")
    return tuple(out)


_known: dict[str, int] = {}


def _bucket(token: str) -> int:
    if token not in _known:
        if len(_known) > 200_000:
            _known.clear()
        _known[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
    return _known[token]


class _Open:
    """The open elements of a page. Every change takes time in proportion to the elements it opens or closes."""

    def __init__(self):
        self.stack: list[tuple[str, list[int], list[int]]] = []
        self.nodes: list[tuple] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.other: list[int] = []  # elements that are no article text inside an article
        self.apart: list[int] = []  # elements that are none around an article either
        self.held: dict[int, int] = {}
        self.names: dict[int, int] = {}

    def push(self, tag: str, attributes: str) -> None:
        tokens = _tokens(tag, attributes)
        hashed = [_bucket(t) for t in tokens]
        at = len(self.stack)
        names = [t.split(":", 1)[1] for t in tokens[1:]]
        named = [_bucket(t) for t in (tag, *names) if t in _PARTS]
        self.stack.append((tag, hashed, named))
        self.nodes.append((self.nodes[-1] if self.nodes else None, tokens))
        self.places[tag].append(at)
        if tag in _SCOPE:
            self.scopes.append(at)
        if tag in _OTHER_TAGS or any(n in _OUTSIDE for n in names):
            self.other.append(at)
        if tag in ("nav", "footer", "aside") or any(n in _COMMENTS for n in names):
            self.apart.append(at)
        for held, own in ((self.held, hashed), (self.names, named)):
            for h in own:
                held[h] = held.get(h, 0) + 1

    def cut(self, at: int) -> None:
        """Close the element at that place and all inside it."""
        while len(self.stack) > at:
            tag, hashed, named = self.stack.pop()
            self.nodes.pop()
            for places in (self.places[tag], self.scopes, self.other, self.apart):
                if places and places[-1] >= len(self.stack):
                    places.pop()
            for held, own in ((self.held, hashed), (self.names, named)):
                for h in own:
                    held[h] -= 1
                    if not held[h]:
                        del held[h]

    def last(self, *tags: str) -> int:
        """Place of the innermost of these elements, -1 without any or behind another scope."""
        at = max((self.places[t][-1] for t in tags if self.places[t]), default=-1)
        return at if not self.scopes or at >= self.scopes[-1] else -1

    def close(self, tag: str) -> None:
        places = self.places[tag]
        if not places:
            return
        if tag not in _BREAKS and self.scopes and self.scopes[-1] > places[-1]:
            places.pop()  # an inline element does not close the blocks inside it
        else:
            self.cut(places[-1])

    def block(self, text: str, linked: float) -> Block:
        inner: list[int] = []
        for _, hashed, _ in reversed(self.stack):
            inner = hashed + inner
            if len(inner) >= _INNER:
                break
        article = self.places["article"]
        own = not self.apart and not (self.other and self.other[-1] >= article[0]) if article else None
        return Block(text, linked, inner[-_INNER:] or [0], list(self.held) or [0], list(self.names) or [0], own, self.nodes[-1] if self.nodes else None)


def parse_blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, in time that grows with the page's length whatever its markup.

    Scripts, styles, comments and markup are no text; unclosed elements are tolerated. A tag that the page's end cuts off goes.
    """
    elements, blocks, parts = _Open(), [], []
    linked = total = at = 0
    begun: Block | None = None
    broken: int | None = None  # the place behind the block's last line break
    endless: set[str] = set()
    pattern, last = _TAG, page.rfind(">")

    def end() -> None:
        nonlocal linked, total, begun, broken
        if begun is not None:
            raw = "".join(parts)
            begun.text, begun.linked = " ".join((html.unescape(raw) if "&" in raw else raw).split()), linked / max(1, total)
            if begun.text:
                blocks.append(begun)
        parts.clear()
        linked = total = 0
        begun = broken = None

    def add(text: str) -> None:
        nonlocal linked, total, begun
        if begun is None and text and not text.isspace():
            begun = elements.block("", 0.0)
        parts.append(text)
        total += len(text)
        if elements.places["a"]:
            linked += len(text)

    while at < len(page):
        lt = page.find("<", at)
        add(page[at : lt if lt >= 0 else len(page)])
        if lt < 0:
            break
        kind = page[lt + 1 : lt + 2]
        if not (kind in ("!", "?", "/") or kind.isascii() and kind.isalpha()):
            add("<")
            at = lt + 1
            continue
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 2)
            at = close + 3 if close >= 0 else len(page)
            continue
        if lt > last:
            break
        m = None
        if kind not in ("!", "?"):
            m = pattern.match(page, lt)
            if m is None and pattern is _TAG and page[lt + 1 : lt + 3].strip("/")[:1].isalpha():
                pattern = _LOOSE  # a quote that nothing closes
                m = pattern.match(page, lt)
        if m is None:
            at = page.find(">", lt) + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if not closing and tag in _RAW:
            close = None if tag in endless else _CLOSING[tag].search(page, at)
            if close:
                to = page.find(">", close.end())
                at = to + 1 if to >= 0 else len(page)
            elif tag in _CODE:
                break
            else:
                endless.add(tag)
            continue
        if tag in _BREAKS:
            end()
        elif tag == "br":  # two with nothing but white space between them part paragraphs
            if broken is not None and not "".join(parts[broken:]).strip():
                end()
            parts.append(" ")
            broken = len(parts)
        if tag in _VOID:
            continue
        if closing:
            elements.close(tag)
            continue
        if tag in _CLOSES_P and (i := elements.last("p")) >= 0:
            elements.cut(i)
        if tag in _SIBLINGS and (i := elements.last(*_SIBLINGS[tag])) >= 0:
            elements.cut(i)
        elements.push(tag, attributes)
    end()
    return blocks


def features(blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], list[list[int]], list[list[int]], np.ndarray]:
    """Hashed tokens of the innermost elements, words, tokens of the whole path and names of parts in it, and numbers of each block."""
    words = [[_bucket(w) for w in {w.lower() for w in b.text.split()}] for b in blocks]
    n = max(1, len(blocks))
    numbers = np.array([(min(1.0, np.log1p(len(b.text)) / 8), b.linked, i / n, 1.0 if b.text[-1] in ".!?" else 0.0, min(1.0, len(b.text.split()) / 50)) for i, b in enumerate(blocks)]).reshape(-1, _NUMBERS)
    return [b.inner for b in blocks], words, [b.whole for b in blocks], [b.names for b in blocks], numbers


def _scatter(lists: list[list[int]], power: float = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat tokens, their rows and 1 / tokens of the row, to a power: under 1, a token counts for more among many."""
    n = np.array([len(x) for x in lists])
    flat = np.fromiter((t for x in lists for t in x), np.int64, int(n.sum()))
    row = np.repeat(np.arange(len(lists)), n)
    return flat, row, (1 / np.maximum(n, 1) ** power)[row]


def _mean(table: np.ndarray, tokens: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    flat, row, share = tokens
    out = np.zeros((n, table.shape[1]), table.dtype)
    if len(flat):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(table[flat] * share[:, None].astype(table.dtype), first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors; a logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = len(_POOLED) * EMBED + _NUMBERS

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"path": np.zeros((BUCKETS, EMBED), np.float32), "word": init(BUCKETS, EMBED) * np.float32(np.sqrt(BUCKETS) / 3), "whole": np.zeros((BUCKETS, EMBED), np.float32), "name": np.zeros((BUCKETS, EMBED), np.float32), "out": init(2 * HIDDEN + width, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(width + HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _inputs(self, pages):
        tokens = [_scatter([x for f in pages for x in f[k]], power) for k, (_, power) in enumerate(_POOLED)]
        n = sum(len(f[0]) for f in pages)
        flat = np.hstack([*(_mean(self.p[name], own, n) for (name, _), own in zip(_POOLED, tokens, strict=True)), np.concatenate([f[-1] for f in pages])]).astype(np.float32)
        lengths = np.array([len(f[0]) for f in pages])
        return flat, lengths, tokens

    @staticmethod
    def _padded(flat, lengths, back=False):
        """Time-major steps, and where each block goes; for the backward direction every page is reversed."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if back:
            step = np.repeat(lengths, lengths) - 1 - step
        x = np.zeros((int(lengths.max()), len(lengths), flat.shape[1]), np.float32)
        x[step, row] = flat
        return x, step, row

    def _run(self, x, d, keep=False):
        w, c = self.p[f"w{d}"], self.p[f"c{d}"]
        n = x.shape[2]
        given = x.reshape(-1, n) @ w[:n] + c
        given = given.reshape(*x.shape[:2], -1)
        h = s = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, tape = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            g = given[t] + h @ w[n:]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, last = s, h
            s = f * s + i * u
            e = np.tanh(s)
            h = o * e
            out[t] = h
            if keep:
                tape.append((i, f, o, u, before, e, last))
        return out, tape

    def predict(self, pages) -> list[np.ndarray]:
        """Probability of being article text for every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at) < 128 and len(pages[order[to]][0]) * (to - at) < 20_000:
                to += 1
            ids = order[at:to]
            flat, lengths, _ = self._inputs([pages[i] for i in ids])
            hs = []
            for d in "fb":
                x, step, row = self._padded(flat, lengths, d == "b")
                hs.append(self._run(x, d)[0][step, row])
            p = _sigmoid(np.hstack([*hs, flat]) @ self.p["out"] + self.p["bias"])[:, 0]
            for i, own in zip(ids, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = own
            at = to
        return out

    def gradients(self, pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        flat, lengths, tokens = self._inputs(pages)
        runs, hs = {}, []
        for d in "fb":
            x, step, row = self._padded(flat, lengths, d == "b")
            h, tape = self._run(x, d, keep=True)
            runs[d] = x, step, row, h, tape
            hs.append(h[step, row])
        top = np.hstack([*hs, flat])
        error = ((_sigmoid(top @ self.p["out"] + self.p["bias"])[:, 0] - labels) / len(labels)).astype(np.float32)[:, None]
        g = {"out": top.T @ error, "bias": error.sum(axis=0)}
        back = error @ self.p["out"].T
        d_flat = back[:, 2 * HIDDEN :].copy()
        for k, d in enumerate("fb"):
            x, step, row, h, tape = runs[d]
            n, w = x.shape[2], self.p[f"w{d}"]
            d_h = np.zeros_like(h)
            d_h[step, row] = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            carry_h = carry_s = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                i, f, o, u, before, e, last = tape[t]
                dh = d_h[t] + carry_h
                ds = dh * o * (1 - e * e) + carry_s
                gates[t] = np.hstack([ds * u * i * (1 - i), ds * before * f * (1 - f), dh * e * o * (1 - o), ds * i * (1 - u * u)])
                carry_h, carry_s = gates[t] @ w[n:].T, ds * f
            flat_gates = gates.reshape(-1, 4 * HIDDEN)
            lasts = np.stack([step_[6] for step_ in tape]).reshape(-1, HIDDEN)
            g[f"w{d}"] = np.vstack([x.reshape(-1, n).T @ flat_gates, lasts.T @ flat_gates])
            g[f"c{d}"] = flat_gates.sum(axis=0)
            d_flat += (gates @ w[:n].T)[step, row]
        for k, ((name, _), (tok, r, share)) in enumerate(zip(_POOLED, tokens, strict=True)):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], tok, d_flat[r, k * EMBED : (k + 1) * EMBED] * share[:, None].astype(np.float32))
        return g

    def fit(self, pages, labels: list[np.ndarray], seed: int = 5, rate: float = 0.01) -> None:
        """Adam over shuffled batches of 32 pages."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        count = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                ids = order[at : at + 32]
                g = self.gradients([pages[i] for i in ids], np.concatenate([labels[i] for i in ids]))
                count += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 1 / max(norm, 1e-9)) + 1e-6 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= rate * (0.5 if epoch >= EPOCHS - 4 else 1) * (m[k] / (1 - 0.9**count)) / (np.sqrt(v[k] / (1 - 0.999**count)) + 1e-8)


# How pages name their parts.
_OTHER = {
    "nav": "nav navbar menu breadcrumb navigation topnav", "header": "header masthead banner topbar logo", "aside": "sidebar aside widget related rail recommended",
    "footer": "footer copyright legal bottom", "ad": "ad ads advert advertisement sponsored promo", "notice": "notice cookie consent gdpr alert popup modal", "form": "form newsletter subscribe signup login search",
    "comments": "comments comment reply replies discussion respond responses disqus commentlist thread", "share": "share social tags pagination meta",
}
_COMMENTS = frozenset(_OTHER["comments"].split())
_MAIN = "article post content entry story main body text"
_SYLLABLES = "an er in on re ti es or th ou la de que ción ß ung lich tre é ai"
# What such parts often say.
_SAYS = {
    "nav": "home about contact us news archive blog shop login help start kontakt inicio accueil", "header": "welcome to our site magazine daily journal", "aside": "related popular latest posts read more recommended",
    "footer": "copyright © 2019 2024 all rights reserved terms privacy imprint powered by last updated webmaster", "ad": "advertisement sponsored buy now offer sale", "notice": "we use cookies accept settings this site", "form": "subscribe newsletter email search submit sign up",
    "comments": "reply says comments posted by guest on at leave a comment thanks great agree", "share": "share tweet facebook tags filed under previous next page",
}
_MARK = "\x02"


def _made_page(rng: np.random.Generator) -> str:
    """A generated layout; blocks of article text carry a mark."""
    syllables = _SYLLABLES.split()

    def pick(words: str) -> str:
        own = words.split()
        return own[int(rng.integers(len(own)))]

    def say(n: int) -> str:
        made = [syllables[i] for i in rng.integers(0, len(syllables), 3 * max(1, n)).tolist()]
        return " ".join("".join(made[3 * i : 3 * i + k]) for i, k in enumerate(rng.integers(1, 4, max(1, n)).tolist())).capitalize() + ("." if rng.random() < 0.8 else "")

    def line(kind: str, n: int) -> str:
        """Words of no meaning, often with some that such parts hold."""
        own = rng.choice(_SAYS[kind].split(), min(n, int(rng.integers(1, 5)))).tolist() if rng.random() < 0.7 else []
        return " ".join([*own, say(max(1, n - len(own)))]).capitalize()

    def named(kind: str) -> str:
        return f' {pick("class class class id")}="{pick(kind)}{pick("  -box -wrap _area").strip()}"' if rng.random() < 0.9 else ""

    def deep(inner: str) -> str:
        """The same in up to 12 elements that say nothing, on some pages."""
        n = int(rng.integers(3, 13)) if nested and rng.random() < 0.6 else 0
        return "".join(f'<div class="{say(1).strip(".").lower()} {pick("row col grid inner block layout box wrap area")} {pick("inner grid w col box")}{pick("- _")}{rng.integers(12)}">' for _ in range(n)) + inner + "</div>" * n

    def other(kind: str) -> str:
        name = named(_OTHER[kind])
        if kind == "nav":
            tag = pick("nav nav ul div")
            return f"<{tag}{name if tag in ('ul', 'div') else ''}>" + "".join(f'<li><a href="/x">{line("nav", int(rng.integers(1, 3)))}</a></li>' for _ in range(rng.integers(3, 9))) + f"</{tag}>"
        if kind == "form":
            return f"<form{name}><label>{line('form', 2)}</label><input><button>{line('form', 1)}</button><p>{line('form', 8)}</p></form>"
        if kind == "comments":
            tag = pick("div div li article")
            inner = "".join(f"<{tag}{named('comment reply')}>" + (f"<h4>{line('comments', 3)}</h4>" if rng.random() < 0.4 else "") + f"<p>{say(rng.integers(4, 60))}</p>" + (f'<a href="#r">{line("comments", 1)}</a>' if rng.random() < 0.3 else "") + f"</{tag}>" for _ in range(rng.integers(1, 6)))
            outer = pick("section div div ol" if tag != "li" else "ol ul")
            return f'<{outer} {pick("class class id")}="{pick(_OTHER["comments"])}{pick("  -list _area -section")}">' + (f"<h3>{line('comments', 2)}</h3>" if outer in ("section", "div") else "") + f"{deep(inner)}</{outer}>"
        tag = {"header": "header", "aside": "aside", "footer": "footer"}.get(kind, "div")
        tag, name = (tag, "") if tag != "div" and rng.random() < 0.6 else ("div", f' class="{pick(_OTHER[kind])}"')
        inner = f'<a href="/">{line(kind, 2)}</a>' * int(rng.integers(0, 3)) + pick("p div span").join(["<", ">"]) + line(kind, int(rng.integers(2, 30)))
        return f"<{tag}{name}>{deep(inner if rng.random() < 0.6 else line(kind, int(rng.integers(2, 20))))}</{tag}>"

    def body_text() -> list[str]:
        """Paragraphs of a page whose elements have no names."""
        out = [f"<h{rng.integers(1, 3)}>{_MARK}{say(rng.integers(2, 12))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(2, 14))):
            n = int(rng.integers(1, 6)) if rng.random() < 0.12 else int(rng.integers(8, 120))
            out.append(f"<p>{_MARK}{say(n)}" + (f' <a href="/y">{say(2)}</a> {say(6)}' if rng.random() < 0.2 else "") + pick("</p> <p></p>"))
            if rng.random() < 0.1:
                out.append("<ul>" + "".join(f"<li>{_MARK}{say(rng.integers(3, 20))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
        return out

    def plain(kind: str) -> str:
        """The other parts of such a page: lists of links, short lines, what readers say under a heading of theirs."""
        if kind == "nav":
            tag = pick("li p span div")
            return "".join(f'<{tag}><a href="/x">{line("nav", int(rng.integers(1, 3)))}</a></{tag}>' for _ in range(rng.integers(3, 9)))
        if kind == "aside":
            return f"<b>{line('aside', 2)}</b>" + "".join(f'<p><a href="/x">{say(rng.integers(2, 9))}</a></p>' for _ in range(rng.integers(2, 6)))
        return f"<{(tag := pick('p div span center'))}>{line(kind, int(rng.integers(2, 14)))}" + (f' <a href="/z">{line(kind, 2)}</a>' if rng.random() < 0.5 else "") + f"</{tag}>"

    def broken_text() -> str:
        """Paragraphs that only line breaks part, under a heading or a line in bold."""
        head = pick("b h1 h2 font center strong")
        rest = [f"{_MARK}{say(int(rng.integers(1, 4)) if rng.random() < 0.15 else int(rng.integers(6, 110)))}" for _ in range(int(rng.integers(2, 12)))]
        return f"<{head}>{_MARK}{say(rng.integers(2, 9))}</{head}>{pick('<br><br> <p> <br><br><br>')}" + "<br><br>".join(rest)

    def old_page() -> str:
        """A page of plain text in one element, with a line of links above or below and a note at its end."""
        links = pick("| - &middot; &nbsp;").join(f'<a href="/x">{line("nav", int(rng.integers(1, 3)))}</a>' for _ in range(rng.integers(3, 9)))
        note = pick("<hr> <br><br> <p>") + pick("<i> <small> <font>") + line("footer", int(rng.integers(3, 9)))
        parts = [*([f"<{(t := pick('h1 center b'))}>{line('header', 3)}</{t}>"] if rng.random() < 0.4 else []), links, broken_text() if rng.random() < 0.7 else "".join(body_text()), *([links] if rng.random() < 0.3 else []), note]
        wrap = pick("center center font div body td")
        return f"<{wrap}>" + pick("<br><br> <hr> <p>").join(parts) + f"</{wrap}>"

    def columns() -> str:
        """Columns and boxes whose classes say how they look, not what they hold."""
        def box(inner: str) -> str:
            return f'<div class="{pick("wrap col row inner box left right grid block cell main-col w100 c1 c2 half")}">{inner}</div>'

        text = "".join(f"<{(t := pick('p p p div'))}>{_MARK}{say(int(rng.integers(1, 4)) if rng.random() < 0.2 else int(rng.integers(5, 110)))}</{t}>" for _ in range(int(rng.integers(2, 12))))
        text = (f"<h{(n := rng.integers(1, 3))}>{_MARK}{say(rng.integers(2, 10))}</h{n}>" if rng.random() < 0.8 else "") + text
        order = [*([box(plain("header"))] if rng.random() < 0.6 else []), *([box(plain("nav"))] if rng.random() < 0.7 else []), box(text), *([box(plain("aside"))] if rng.random() < 0.4 else []), box(plain("footer"))]
        return box("".join(order)) if rng.random() < 0.7 else "".join(order)

    def unnamed() -> str:
        """A layout of tables, or of elements without names."""
        r = rng.random()
        if r < 0.3:
            return old_page()
        if r < 0.55:
            return columns()
        text = "".join(body_text()) if rng.random() < 0.8 else broken_text()
        side = [plain("nav"), *([plain("aside")] if rng.random() < 0.4 else [])]
        if rng.random() < 0.5:
            cells = [f"<td{pick('  width=200 valign=top').strip() and ' valign=top'}>{x}</td>" for x in side] + [f"<td>{text}</td>"]
            if rng.random() < 0.3:
                cells = cells[::-1]
            top = f"<tr><td colspan=3>{plain('header')}</td></tr>" if rng.random() < 0.7 else ""
            return f"<table border=0>{top}<tr>{''.join(cells)}</tr><tr><td colspan=3>{plain('footer')}</td></tr></table>"
        order = [plain("header"), side[0], text, *side[1:], plain("footer")]
        wraps = [pick("div div center span") for _ in order]
        return "".join(f"<{w}>{x}</{w}>" for w, x in zip(wraps, order, strict=True))

    def main() -> str:
        tag = pick("article article article main div div section")
        name = f' class="{pick(_MAIN)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        head = f"<{tag}{name}>"
        out = [f"<h1>{_MARK}{say(rng.integers(2, 12))}</h1>"]
        for _ in range(int(rng.integers(1, 18))):
            r = rng.random()
            n = int(rng.integers(1, 120))
            if r < 0.6:
                out.append(f"<p>{_MARK}{say(n)}</p>")
            elif r < 0.7:
                out.append(f"<p><b>{_MARK}{say(n)}<br>")
            elif r < 0.77:
                out.append(f"<h{rng.integers(2, 4)}>{_MARK}{say(rng.integers(1, 9))}</h2>")
            elif r < 0.84:
                out.append("<ul>" + "".join(f"<li>{_MARK}{say(rng.integers(1, 20))}</li>" for _ in range(rng.integers(1, 6))) + "</ul>")
            elif r < 0.88:
                out.append(f"<blockquote>{_MARK}{say(n)}</blockquote>")
            elif r < 0.92:
                out.append(f'<p>{_MARK}{say(5)} <a href="/y">{say(2)}</a> {say(9)}</p>')
            elif r < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{_MARK}{say(2)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(other(pick("ad ad share notice")))
        if rng.random() < 0.35:  # readers' comments and notes inside the article's element, behind its text
            out.append("".join(other(k) for k in (["share"] if rng.random() < 0.3 else []) + ["comments"] + (["form"] if rng.random() < 0.3 else [])))
        elif rng.random() < 0.3:
            out.append(other(pick("aside footer share form")))
        cuts = sorted({0, *rng.integers(0, len(out), int(rng.integers(0, 3))).tolist(), len(out)}) if nested else [0, len(out)]
        return head + "".join(deep("".join(out[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)) + f"</{tag}>"

    nested = rng.random() < 0.5
    if rng.random() < 0.45:
        return f"<html><head><title>{say(6)}</title></head><body>{unnamed()}</body></html>"
    before = [other(k) for k in ("nav", "header", "ad", "notice", "aside", "form") if rng.random() < 0.5]
    after = [other(k) for k in ("comments", "aside", "ad", "form", "share", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    title = say(6)
    wrap = pick("none none div main")
    body = main()
    body = {"none": body, "div": f'<div class="container">{body}</div>', "main": f"<main>{body}</main>"}[wrap]
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(before)}{body}{''.join(after)}" + ("</body></html>" if rng.random() < 0.7 else "")


_OUTSIDE = frozenset(w for v in _OTHER.values() for w in v.split())
_PARTS = _OUTSIDE | frozenset(_MAIN.split()) | frozenset("nav header footer aside article main form section table button li".split())


def semantic_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that names its article by element, else None: what lies in it, but not in a named other part."""
    return np.array([bool(b.own) for b in blocks], np.float32) if any(b.own for b in blocks) else None


def train_labeller(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Labeller:
    """Fit on MADE_PAGES generated layouts and at most OWN_PAGES pages of the table, chosen by a hash of their ids.

    Of rows that repeat an id one is taken, the one with the smallest hash of its page. Null ids, null and empty pages, pages
    longer than OWN_CHARS and pages without an article element are not fitted on. Without any page the layouts alone decide.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where(f"page_id is not null and html > '' and length(html) <= {OWN_CHARS}")
    own = own.withColumn("h", F.xxhash64("html"))
    chosen = own.groupBy("page_id").agg(F.min("h").alias("h")).orderBy(F.xxhash64(F.lit(23), "page_id"), "page_id").limit(OWN_PAGES)
    sample = own.join(F.broadcast(chosen), ["page_id", "h"]).groupBy("page_id").agg(F.min("html").alias("html")).collect()
    rng = np.random.default_rng(11)
    data, labels = [], []
    for _ in range(MADE_PAGES):
        blocks = parse_blocks(_made_page(rng))
        labels.append(np.array([b.text.startswith(_MARK) for b in blocks], np.float32))
        for b in blocks:
            b.text = b.text.replace(_MARK, "") or "x"
        data.append(features(blocks))
    for r in sorted(sample):
        blocks = parse_blocks(r.html)
        y = semantic_labels(blocks)
        if y is not None:
            data.append(features(blocks))
            labels.append(y)
    model = Labeller()
    model.fit(data, labels)
    return model


def extract_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html.

    Blocks labelled as article are joined by an empty line; a probability of exactly one half counts. A null or empty page, or
    one without article text, has empty text; an empty table gives no rows. Pages of any length are parsed and labelled whole,
    in time that grows with it. Repeated rows and null ids give a row each. Other columns are not read, whatever their names.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    given = spark.sparkContext.broadcast(model)

    def extracted(batches):
        for b in batches:
            parsed = [parse_blocks(h) if h else [] for h in b.column(2).to_pylist()]
            chosen = given.value.predict([features(p) for p in parsed])
            texts = ["\n\n".join(x.text for x, y in zip(p, s, strict=True) if y >= 0.5) if p else "" for p, s in zip(parsed, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
