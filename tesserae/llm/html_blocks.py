"""Main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks, runs of text that no block-level tag
interrupts.  Each block has a hashed vector of its tag path (names, classes and
ids of the open elements), one of its words, and a few figures.  A
bidirectional LSTM in numpy reads the whole page's sequence and labels every
block, so a block is judged by what stands before and after it.  The network is
trained here, on generated pages of many layouts.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

PATH, WORDS, FIGURES, HIDDEN = 96, 64, 10, 24
_TAG_REST = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"']))[^>=]*+)*+>")
#: Elements whose content is characters up to their end tag, none of it the page's text.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose content isn't shown; one that is never closed hides nothing.
_HIDDEN = frozenset("noscript template select datalist svg canvas audio video object".split())
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle mpadded mphantom menclose semantics annotation".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_CLOSES |= dict.fromkeys("address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split(), ("p",))
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An open element: its parent, its marks (name, classes, id, role) and the sum of its path's hashed marks."""

    __slots__ = ("parent", "marks", "kids", "total", "leaf")
    made = 0

    def __init__(self, parent: Node | None, marks: tuple[str, ...]) -> None:
        self.parent, self.marks = parent, marks
        self.kids: dict[tuple[str, ...], Node] = {}
        self.total = np.zeros(PATH, np.int32) if parent is None else None
        self.leaf: np.ndarray | None = None
        Node.made += 1

    def child(self, marks: tuple[str, ...]) -> Node:
        node = self.kids.get(marks)
        if node is None:
            node = self.kids[marks] = Node(self, marks)
        return node

    def path(self) -> tuple[str, ...]:
        """The marks of all open elements, outermost first."""
        chain, node = [], self
        while node is not None:
            chain.append(node.marks)
            node = node.parent
        return tuple(m for marks in reversed(chain) for m in marks)

    def vector(self) -> np.ndarray:
        """Hashed marks of the whole path, and of its last two once more."""
        if self.leaf is None:
            chain, node = [], self
            while node.total is None:
                chain.append(node)
                node = node.parent
            for node in reversed(chain):
                node.total = _hashed(node.parent.total.copy(), node.marks, b"")
            last = self.marks if len(self.marks) > 1 or self.parent is None else self.parent.marks + self.marks
            self.leaf = np.clip(_hashed(self.total.copy(), last[-2:], b"leaf "), -3, 3).astype(np.float32)
        return self.leaf


def _hashed(v: np.ndarray, marks: tuple[str, ...], salt: bytes) -> np.ndarray:
    for m in marks:
        h = zlib.crc32(salt + m.encode())
        v[h % PATH] += 1 if h & 0x80000000 else -1
    return v


_ROOT: list[Node] = []


def _root() -> Node:
    """The root of the paths, shared by pages until it has grown large."""
    if not _ROOT or Node.made > 50_000:
        _ROOT[:] = [Node(None, ())]
        Node.made = 0
    return _ROOT[0]


def blocks(page: str | None) -> tuple[list[str], list[Node], list[float]]:
    """Texts, tag paths and shares of link text of a page's leaf blocks, in page order.

    Character references are decoded and white space is single spaces; scripts,
    styles, comments and what isn't shown give no block; formulas are text.
    Unclosed and stray tags are borne, an unclosed quotation mark ends at its tag's
    `>`, and where no `>` follows the rest is text.  Time is in proportion to the
    page, whatever its markup.  A null or empty page has no blocks.
    """
    texts: list[str] = []
    paths: list[Node] = []
    links: list[float] = []
    if not page:
        return texts, paths, links
    node = _root()
    stack: list[tuple[str, Node]] = []
    opened: dict[str, int] = {}
    closers: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, hidden, loose = 0, 0, 0, False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                texts.append(text)
                paths.append(node)
                links.append(min(1.0, linked / len(text)))
            parts.clear()
            linked = 0

    def pop() -> None:
        nonlocal node, hidden
        name, node = stack.pop()
        opened[name] -= 1
        hidden -= name in _HIDDEN

    def last_close(name: str) -> int:
        """Where the last end tag of `name` begins."""
        if name not in closers:
            closers[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])", page, re.I)), default=-1)
        return closers[name]

    def words(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not hidden:
            parts.append(page[a:b])
            if in_link:
                linked += b - a

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= end:
            words(at, end)
            break
        c = page[lt + 1]
        close = c == "/"
        first = page[lt + 2 : lt + 3] if close else c
        if not (first.isascii() and first.isalpha()):
            if close or c in "!?":
                words(at, lt)
                mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
                stop = page.find(mark, lt + 2)
                at = end if stop < 0 else stop + len(mark)
                if stop < 0 and mark == ">":
                    words(lt, end)
                    break
            else:
                words(at, lt + 1)
                at = lt + 1
            continue
        words(at, lt)
        name_end = lt + 2 + close
        while name_end < end and page[name_end] not in " \t\n\r\f/>":
            name_end += 1
        found = None if loose else _TAG_REST.match(page, name_end)
        if found is None:
            loose = True
            gt = page.find(">", name_end)
            if gt < 0:
                words(lt, end)
                break
            at = gt + 1
        else:
            at = found.end()
        name = page[lt + 1 + close : name_end].lower()
        if name in _RAW:
            if not close:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                gt = page.find(">", stop.end()) if stop else -1
                at = end if gt < 0 else gt + 1
                parts.append(" ")
            continue
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if close else 1
            continue
        if name in _HIDDEN:
            if not close and page[at - 2] != "/" and last_close(name) >= at:
                stack.append((name, node))
                opened[name] = opened.get(name, 0) + 1
                hidden += 1
                parts.append(" ")
            elif close and opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if hidden and (not close or stack[-1][0] == name):
            # What a hidden element holds has no blocks, but must be opened so that it is closed.
            if close:
                pop()
            elif name not in _VOID and page[at - 2] != "/":
                stack.append((name, node))
                opened[name] = opened.get(name, 0) + 1
            continue
        flush()
        if close:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            in_link = 0
            continue
        if name in _VOID:
            continue
        shut = _CLOSES.get(name)
        while shut and stack and stack[-1][0] in shut:
            pop()
        attrs = page[name_end : at - 1]
        marks = [name]
        if "=" in attrs:
            for kind, x, y, z in _ATTR.findall(attrs):
                marks += [f"{kind[0].lower()}:{w}" for w in _SPLIT.split((x or y or z).lower()) if w]
        stack.append((name, node))
        opened[name] = opened.get(name, 0) + 1
        node = node.child(tuple(marks))
    flush()
    return texts, paths, links


def features(texts: list[str], paths: list[Node], links: list[float], index: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Input vectors of blocks; `index` is a block's place in its page and `size` the page's number of blocks."""
    n = len(texts)
    data, off = T.column(pa.array(texts, pa.large_string()))
    starts, ends, first = T.words(data, off)
    lower = data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    h = T.hash_slices(T.running(lower), starts, ends)
    row = T.row_of(first)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    count = np.diff(first)
    words = np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), weights=sign, minlength=n * WORDS).reshape(n, WORDS) / np.sqrt(np.maximum(count, 1))[:, None]
    chars = np.maximum(np.diff(off), 1)
    stops = T.sums(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), off)
    digits = T.sums((data >= 48) & (data <= 57), off)
    link = np.array(links)
    figures = np.stack([np.log1p(count) / 4, np.log1p(chars) / 6, link, stops / np.maximum(count, 1), digits / chars, T.sums(upper, off) / chars, index / np.maximum(size, 1), 1.0 * (index == 0), 1.0 * (index == size - 1), np.log1p(size) / 4], axis=1)
    return np.concatenate([np.array([p.vector() for p in paths], np.float32).reshape(n, PATH), words, figures], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output for each block."""

    def __init__(self, seed: int = 1, width: int = PATH + WORDS + FIGURES, hidden: int = HIDDEN) -> None:
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = r.normal(0, 0.1, (width, 4 * hidden))
            self.p[f"{d}h"] = r.normal(0, 0.1, (hidden, 4 * hidden))
            self.p[f"{d}b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"] = r.normal(0, 0.1, (2 * hidden, 1))
        self.p["ob"] = np.zeros(1)
        self.hidden = hidden

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (time x page x unit) of one direction; a masked step keeps the state."""
        t, n, _ = x.shape
        k = self.hidden
        z = x.reshape(t * n, -1) @ self.p[f"{d}x"] + self.p[f"{d}b"]
        z = z.reshape(t, n, 4 * k)
        h, c = np.zeros((n, k)), np.zeros((n, k))
        out, kept = np.zeros((t, n, k)), [None] * t
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[s] + h @ self.p[f"{d}h"]
            i, f, o, u = _sigmoid(g[:, :k]), _sigmoid(g[:, k : 2 * k]), _sigmoid(g[:, 2 * k : 3 * k]), np.tanh(g[:, 3 * k :])
            m = mask[s][:, None]
            new = f * c + i * u
            tc = np.tanh(new)
            kept[s] = (h, c, i, f, o, u, tc, m)
            h, c = m * (o * tc) + (1 - m) * h, m * new + (1 - m) * c
            out[s] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        f, kf = self._run("f", x, mask)
        b, kb = self._run("b", x, mask)
        both = np.concatenate([f, b], axis=2)
        return _sigmoid((both @ self.p["o"])[:, :, 0] + self.p["ob"]), both, kf, kb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients, by back-propagation through time."""
        p, both, kf, kb = self.forward(x, mask)
        k, total = self.hidden, mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        dz = mask * (p - y) / total
        g = {"o": np.einsum("tnk,tn->k", both, dz)[:, None], "ob": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.p["o"][:, 0]
        t, n, _ = x.shape
        for d, kept, dout in (("f", kf, dboth[:, :, :k]), ("b", kb, dboth[:, :, k:])):
            dh, dc = np.zeros((n, k)), np.zeros((n, k))
            da = np.zeros((t, n, 4 * k))
            wh = np.zeros_like(self.p[f"{d}h"])
            for s in range(t - 1, -1, -1) if d == "f" else range(t):
                h, c, i, f, o, u, tc, m = kept[s]
                dh = dh + dout[s]
                dn = m * dh
                dnew = m * dc + dn * o * (1 - tc**2)
                a = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), dn * tc * o * (1 - o), dnew * i * (1 - u**2)], axis=1)
                da[s] = a
                wh += h.T @ a
                dh = (1 - m) * dh + a @ self.p[f"{d}h"].T
                dc = (1 - m) * dc + dnew * f
            flat = da.reshape(t * n, -1)
            g[f"{d}x"], g[f"{d}h"], g[f"{d}b"] = x.reshape(t * n, -1).T @ flat, wh, flat.sum(axis=0)
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 1) -> float:
        """Adam on (vectors, labels) of pages; the last epoch's mean loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, mean = 0, 0.0
        for _ in range(epochs):
            losses = []
            for at in range(0, len(pages), batch):
                chosen = [pages[i] for i in r.permutation(len(pages))[:batch]]
                x, mask, y = pad([a for a, _ in chosen], [b for _, b in chosen])
                loss, g = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum((q**2).sum() for q in g.values()))
                for k, q in g.items():
                    q = q * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q**2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean


def pad(vectors: list[np.ndarray], labels: list[np.ndarray] | None = None):
    """Pages of several lengths as time x page arrays, a mask, and labels."""
    t = max(map(len, vectors))
    x = np.zeros((t, len(vectors), vectors[0].shape[1]), np.float32)
    mask, y = np.zeros((t, len(vectors)), np.float32), np.zeros((t, len(vectors)), np.float32)
    for i, v in enumerate(vectors):
        x[: len(v), i] = v
        mask[: len(v), i] = 1
        if labels is not None:
            y[: len(v), i] = labels[i]
    return (x, mask, y) if labels is not None else (x, mask)


_CHROME = "home about contact login sign in register subscribe newsletter privacy policy terms of use cookie cookies accept all rights reserved copyright share tweet follow us related posts popular read more next previous search menu categories tags archive advertisement sponsored buy now sale offer free comments reply leave a comment posted by says submit email name download app accueil connexion recherche startseite anmelden suche inicio buscar".split()


def _prose(r: random.Random, low: int, high: int) -> str:
    """Invented words, plain or with one of many kinds of decoration."""
    style = r.random()
    words = ["".join(r.choice("aeiouéäöüñ" if k % 2 else "bcdfghlmnprstvwz") for k in range(r.randint(1, 10))) for _ in range(r.randint(low, high))]
    if style < 0.1:
        tails = ["".join(r.choice(["!", "?", "#", "$", "%", "*", "+", "=", "~", "^", "_", "@", "&amp;", "&lt;"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))]
        words = [w + r.choice(tails) for w in words]
    elif style < 0.14:
        words = [w.upper() + r.choice(["", "!", "!!", "?"]) for w in words]
    elif style < 0.18:
        between = r.choice(["|", "/", "-", ";", "&middot;", "&ndash;"])
        words = [x for w in words for x in (w, between)]
    elif style < 0.22:
        words = [r.choice([w, str(r.randint(0, 10 ** r.randint(1, 9)))]) for w in words]
    else:
        words = [w + r.choice(["", "", "", "", "", ",", ".", ""]) for w in words]
    return " ".join(words).capitalize() + r.choice([".", ".", "", "?"])


def _chrome(r: random.Random, low: int, high: int) -> str:
    own = r.random() < 0.5
    return " ".join(r.choice(_CHROME) if own else _prose(r, 1, 1).strip(".?") for _ in range(r.randint(low, high)))


def _head(r: random.Random) -> str:
    return "".join(r.choice([f"<style>.{_prose(r, 1, 1)} {{ width: {r.randint(1, 99)}px }}</style>", f"<script>var x = '<p>{_prose(r, 1, 5)}</p>';</script>", f'<meta name=description content="{_prose(r, 1, 9)}">', "<link rel=stylesheet href=a.css>"]) for _ in range(r.randint(0, 3)))


def generated_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and the texts of its main blocks."""
    main: list[str] = []
    out = []

    def add(text: str) -> str:
        main.append(" ".join(_html.unescape(re.sub(r"<[^>]*>", " ", text) if "<" in text else text).split()))
        return text

    def menu(tag: str, attrs: str) -> str:
        items = "".join(f"<li><a href='/x'>{_chrome(r, 1, 3)}</a></li>" if r.random() < 0.9 else f"<a href=y>{_chrome(r, 1, 2)}</a>" for _ in range(r.randint(2, 9)))
        return f"<{tag}{attrs}><ul>{items}</ul></{tag}>"

    def mark(*names: str) -> str:
        return r.choice(["", ""]) if not names else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def boiler(tag: str, attrs: str, low: int, high: int) -> str:
        body = r.choice([lambda: _prose(r, low, high), lambda: _chrome(r, low, min(high, 14)), lambda: f"<p>{_prose(r, low, high)}</p>", lambda: f"<h3>{_chrome(r, 1, 4)}</h3><p>{_prose(r, low, high)}</p>", lambda: f"<a href=z>{_prose(r, low, high)}</a>"])()
        return f"<{tag}{attrs}>{body}</{tag}>"

    if r.random() < 0.5:
        out.append(r.choice([lambda: boiler("header", mark("header", "site-header", "top"), 1, 8), lambda: boiler("div", mark("header", "site-header", "masthead", "banner"), 1, 8)])())
    if r.random() < 0.85:
        out.append(menu(*r.choice([("nav", ""), ("nav", mark("menu", "main-nav")), ("div", mark("menu", "nav", "navbar", "navigation", "breadcrumbs")), ("header", "")])))
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        out.append(r.choice([lambda: boiler("div", mark("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"), 2, 25), lambda: boiler("div", mark("cookie-notice", "cookie", "notice", "alert", "consent", "gdpr", "popup", "newsletter"), 3, 25), lambda: boiler("aside", mark("sidebar", "widget"), 2, 25)])())
    if r.random() < 0.3:
        out.append(f"<form{mark('search', 'login', 'signup', 'form')}><label>{_chrome(r, 1, 3)}</label><input name=q><button>{_chrome(r, 1, 2)}</button><p>{_prose(r, 2, 12)}</p></form>")
    head = f"<h1>{add(_prose(r, 2, 12))}</h1>"
    body = []
    for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14, 25])):
        kind = r.random()
        if kind < 0.72:
            body.append(f"<p>{add(_prose(r, 1, r.choice([3, 20, 60, 150])))}" + r.choice(["</p>", "</p>", "</p>", ""]))
        elif kind < 0.8:
            t, tag = _prose(r, 1, 30), r.choice(["b", "i", "em", "strong", "span", "code"])
            body.append(r.choice(["<p>", "<div>", "<p class=lead>"]) + f"<{tag}>{add(t)}" + r.choice(["<br>", "<br/>", f"</{tag}>", ""]))
        elif kind < 0.87:
            level = r.randint(2, 4)
            body.append(f"<h{level}>{add(_prose(r, 1, 8))}</h{level}>")
        elif kind < 0.93:
            body.append("<ul>" + "".join(f"<li>{add(_prose(r, 1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.97:
            body.append(f"<blockquote>{add(_prose(r, 3, 40))}</blockquote>")
        else:
            body.append(f"<pre>{add(_prose(r, 3, 30))}</pre>")
        if r.random() < 0.05:
            body.append(boiler("div", mark("ad", "advert", "promo", "related", "share", "social"), 1, 20))
        if r.random() < 0.03:
            body.append(boiler("aside", mark("related", "pullquote-ad", "sidebar"), 1, 20))
    wrap = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{mark('content', 'post', 'entry', 'article', 'main', 'story', 'article-body', 'post-content')}>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>")])
    out += [wrap[0], head, *body, wrap[1]]
    if r.random() < 0.3:
        tag, attrs = r.choice([("section", mark("comments", "reader-comments", "discussion")), ("div", mark("comments", "comment-list", "responses", "disqus")), ("ol", mark("commentlist", "comments"))])
        one = lambda: r.choice([f"<div class='comment'><b>{_chrome(r, 1, 2)}</b><p>{_prose(r, 2, 50)}</p></div>", f"<li class=comment>{_prose(r, 2, 50)}</li>", f"<p>{_prose(r, 2, 50)}</p>", f"<article class='comment'><p>{_prose(r, 2, 50)}</p></article>"])
        out.append(f"<{tag}{attrs}>" + r.choice(["", f"<h2>{_chrome(r, 1, 3)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 6))) + f"</{tag}>")
    if r.random() < 0.3:
        out.append(r.choice([lambda: menu("div", mark("related", "sidebar", "widget", "recommended", "tags")), lambda: menu("aside", mark("sidebar", "related")), lambda: boiler("aside", "", 2, 40), lambda: boiler("div", mark("sidebar", "widget-area", "newsletter"), 2, 40)])())
    if r.random() < 0.85:
        out.append(r.choice([lambda: boiler("footer", "", 2, 20), lambda: f"<footer>&copy; {_chrome(r, 1, 3)} &middot; {_prose(r, 2, 12)}</footer>", lambda: menu("footer", ""), lambda: boiler("div", mark("footer", "site-footer", "copyright", "bottom"), 2, 20)])())
    if r.random() < 0.1:
        out.insert(0, "<div class='wrapper'>")
    page = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_prose(r, 2, 6)}</title>{_head(r)}</head><body>{''.join(out)}</body></html>"
    return page, main


_TRAINED: dict[tuple[int, int], Labeller] = {}


def trained(pages: int = 1000, seed: int = 11) -> Labeller:
    """The labeller fitted to `pages` generated pages; the same on every machine, and kept for the session."""
    if (pages, seed) not in _TRAINED:
        r = random.Random(seed)
        data = []
        for _ in range(pages):
            page, main = generated_page(r)
            texts, paths, links = blocks(page)
            wanted = list(main)
            y = np.zeros(len(texts), np.float32)
            for i, t in enumerate(texts):
                if t in wanted:
                    wanted.remove(t)
                    y[i] = 1
            n = len(texts)
            data.append((features(texts, paths, links, np.arange(n), np.full(n, n)), y))
        model = Labeller(seed)
        model.fit(data)
        _TRAINED[pages, seed] = model
    return _TRAINED[pages, seed]


def label(model: Labeller, pages: list[tuple[list[str], list[Node], list[float]]], most_cells: int = 200_000) -> list[np.ndarray]:
    """Probability that a block is main text, for each block of each page; pages of like length run together."""
    size = np.array([len(p[0]) for p in pages], np.int64)
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = [i for i in np.argsort(size, kind="stable").tolist() if size[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * size[order[end]] * (PATH + WORDS + FIGURES) <= most_cells * 32:
            end += 1
        group = order[at:end]
        n = size[group]
        first = np.append(0, np.cumsum(n))
        texts = [t for i in group for t in pages[i][0]]
        x = features(texts, [q for i in group for q in pages[i][1]], [q for i in group for q in pages[i][2]], np.arange(first[-1]) - np.repeat(first[:-1], n), np.repeat(n, n))
        padded, mask = pad([x[a:b] for a, b in zip(first[:-1], first[1:])])
        p = model.forward(padded, mask)[0]
        for k, i in enumerate(group):
            out[i] = p[: size[i], k]
        at = end
    return out


def main_texts(model: Labeller, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    """The main text of each page: its main blocks in page order, joined by single spaces."""
    parsed = [blocks(p) for p in pages]
    return [" ".join(t for t, q in zip(b[0], p) if q >= threshold) for b, p in zip(parsed, label(model, parsed))]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.5) -> DataFrame:
    """`keep` columns, text and n_chars (code points) of every page; nothing is cut or dropped.

    A null or empty page, or one without main blocks, gives an empty text.
    Repeated rows give repeated results; an empty table an empty one; other
    columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = main_texts(shared.value, b.column("_html").to_pylist(), threshold)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, f"{kinds}text string, n_chars long")
