"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the boundaries of block elements, each
with its tag path.  A block's vector holds its path's hashed tags and class or id words, its
hashed words, and a few measures (length, links, punctuation).  A bidirectional LSTM in numpy
reads the page's whole sequence of blocks, and every block is labelled as main text or not
with the context of all others.  The network is trained here, on pages made from a seed:
articles among menus, headers, footers, sidebars, notices, adverts, forms and comments in many
arrangements of mark-up; nothing of the tables enters the training.

Scripts, styles and comments of the mark-up are no text at all.  Character references are
decoded, white space in a block becomes one space, and the kept blocks are joined in order
by empty lines; nothing else is dropped or cut.

Reading is linear in the page: an element carries the hashed marks of its ancestors as bits,
and every failed look for the end of a tag ends the looking.  Pages of very many blocks go
through the network piece by piece, with the state carried on.

Defined cases: null or empty html, and pages without main text, give empty text; broken mark-up
is read as browsers roughly do (unclosed elements end with their parents, a head without end
tag ends where the body must have begun, a stray ``<`` is text); pages of any length and depth
are read whole; formulae (math, svg) are text of their block; rows with equal page_id, and
repeated rows, are extracted each on its own; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from random import Random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import map_rows

QUERY = "op7_block_labeller"
ORACLE_SQL = None

#: Sizes of the hashed parts of a block's vector, measures, and units of each direction.
TAGS, MARKS, WORDS, MEASURES, UNITS = 32, 32, 16, 8, 16
SIZE = 2 * TAGS + MARKS + WORDS + MEASURES
#: Blocks of a page that go through the network at a time.
PIECE = 1 << 16

#: Elements whose content is no text, elements inside a block, elements without an end tag.
SILENT = frozenset("script style noscript template head title annotation annotation-xml iframe object canvas audio video select textarea option".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is part of the line, and elements that may stand in a head.
FOREIGN = frozenset(("math", "svg"))
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that end an open one of the same group.
GROUPS = {"li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "cell", "th": "cell", "option": "option"}
SCOPES = {"li": {"ul", "ol", "menu"}, "d": {"dl"}, "tr": {"table"}, "cell": {"tr", "table"}, "option": {"select"}}

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[^\W\d_]+|[©|»•]")


class Block:
    """A leaf block: its text, and what its vector is made of: hashed tags and marks of its path as bits,
    the nearest block element, the number of these, and the share of text in links."""

    __slots__ = ("depth", "last", "linked", "marks", "tags", "text")

    def __init__(self, text: str, tags: int = 0, marks: int = 0, last: str = "", depth: int = 0, linked: float = 0.0) -> None:
        self.text, self.tags, self.marks, self.last, self.depth, self.linked = text, tags, marks, last, depth, linked


class Reader:
    """Reads one page into leaf blocks.  A frame of the stack is an open element (name, whether it is
    part of the line, tags, marks, last, depth), the latter four with those of its ancestors."""

    ROOT = ("", False, 0, 0, "", 0)

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.stack: list[tuple] = []
        self.open: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked = self.silent = self.foreign = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, tags, marks, last, depth = self.stack[-1] if self.stack else self.ROOT
                self.found.append(Block(text, tags, marks, last, depth, min(1.0, self.linked / len(text))))
            self.parts.clear()
        self.linked = 0

    def close(self, depth: int) -> None:
        """Close all elements from that place in the stack on."""
        if any(not line for _, line, *_ in self.stack[depth:]):
            self.flush()
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.open[name].pop()
            self.silent -= name in SILENT
            self.foreign -= name in FOREIGN

    def place(self, *names: str) -> int:
        """Place in the stack of the innermost open element of these names, or -1."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def text(self, text: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not text.isspace():
            self.close(self.place("head"))
        if not self.silent:
            text = references.unescape(text)
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += len(text.strip())

    def end(self, name: str) -> None:
        if (depth := self.place(name)) >= 0:
            self.close(depth)
        elif name not in INLINE:
            self.flush()

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append("\n")
            return
        if name not in HEAD and self.open.get("head"):
            self.close(self.place("head"))
        line = name in INLINE or name in FOREIGN or self.foreign > 0
        if not line:
            if (depth := self.place("p")) >= 0:  # a block element ends a paragraph
                self.close(depth)
            if group := GROUPS.get(name):
                depth = self.place(*(n for n, g in GROUPS.items() if g == group))
                if depth > self.place(*SCOPES[group]):
                    self.close(depth)
            self.flush()
        if name in VOID or attributes.endswith("/"):
            return
        _, _, tags, marks, last, depth = self.stack[-1] if self.stack else self.ROOT
        if not line:
            tags, last, depth = tags | 1 << slot(name, TAGS), name, depth + 1
        if "class" in attributes or "id" in attributes or "role" in attributes.lower():
            for found in MARK.findall(attributes):
                for word in re.findall(r"[a-z]+", "".join(found).lower()):
                    marks |= 1 << slot(word, MARKS)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, line, tags, marks, last, depth))
        self.silent += name in SILENT
        self.foreign += name in FOREIGN


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    reader, at, tag, last_end = Reader(), 0, TAG, page.rfind(">")
    while at < len(page):
        opened = page.find("<", at)
        if opened < 0 or opened > last_end and not page.startswith("<!--", opened):
            reader.text(page[at:])
            break
        if opened > at:
            reader.text(page[at:opened])
        if page.startswith("<!--", opened):
            end = page.find("-->", opened + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), opened):
            at = page.find(">", opened) + 1
            continue
        m = tag.match(page, opened)
        if not m and tag is TAG and PLAIN_TAG.match(page, opened):
            m, tag = PLAIN_TAG.match(page, opened), PLAIN_TAG  # quotes do not close; from here on they are not looked at
        if not m:
            reader.text("<")
            at = opened + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            reader.end(name)
        elif name in RAW and not m[3].endswith("/"):
            if name not in INLINE and not reader.foreign:
                reader.flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            reader.start(name, m[3])
    reader.flush()
    return reader.found


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


_SLOTS: dict[tuple[str, int], int] = {}


class _Slots(dict):
    """Places of words; frequent ones are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = _slot(word, WORDS)
        return found


_WORD_SLOTS = _Slots()
_BITS = np.arange(max(TAGS, MARKS))


def slot(word: str, size: int) -> int:
    """Hashed place of a word; frequent ones are remembered."""
    key = (word, size)
    if key not in _SLOTS:
        if len(_SLOTS) > 100_000:
            _SLOTS.clear()
        _SLOTS[key] = _slot(word, size)
    return _SLOTS[key]


def vectors_of(found: list[Block]) -> np.ndarray:
    """Vectors of a page's blocks."""
    out = np.zeros((len(found), SIZE), np.float32)
    for i, b in enumerate(found):
        row = out[i]
        row[:TAGS] = b.tags >> _BITS[:TAGS] & 1
        if b.last:
            row[TAGS + slot(b.last, TAGS)] = 1
        row[2 * TAGS : 2 * TAGS + MARKS] = b.marks >> _BITS[:MARKS] & 1
        counts = [0] * WORDS
        words = WORD.findall(b.text.lower())
        for word in words:
            counts[_WORD_SLOTS[word]] += 1
        if words:
            row[2 * TAGS + MARKS : -MEASURES] = np.array(counts, np.float32) / len(words)
        n = len(b.text)
        stops = sum(map(b.text.count, ".!?;,"))
        row[-MEASURES:] = (np.log1p(n) / 6, b.linked, min(1, 20 * stops / n), n < 25, n > 120, b.text[-1] in ".!?:\"”»", min(8, b.depth / 8), 1)
    return out


class Labeller:
    """Bidirectional LSTM over block vectors, one output a block."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.RandomState(seed)
        self.w: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.w[way + "x"] = (draw.randn(SIZE, 4 * UNITS) / np.sqrt(SIZE) * 2).astype(np.float32)
            self.w[way + "h"] = (draw.randn(UNITS, 4 * UNITS) / np.sqrt(UNITS)).astype(np.float32)
            self.w[way + "c"] = np.r_[np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)].astype(np.float32)
        self.w["o"] = (draw.randn(2 * UNITS + SIZE) / np.sqrt(SIZE)).astype(np.float32)
        self.w["oc"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states (T, B, UNITS) of x (T, B, SIZE); padded steps keep the state, which ``state`` carries on."""
        steps, batch = x.shape[:2]
        z = x.reshape(-1, SIZE) @ self.w[way + "x"] + self.w[way + "c"]
        z = z.reshape(steps, batch, -1)
        h, c = state or (np.zeros((batch, UNITS), np.float32), np.zeros((batch, UNITS), np.float32))
        out = np.empty((steps, batch, UNITS), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[way + "h"]
            gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * UNITS], -30, 30)))
            i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
            g = np.tanh(a[:, 3 * UNITS :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds (T, B) of main text."""
        return np.concatenate((self._run(x, mask, "f"), self._run(x, mask, "b"), x), 2) @ self.w["o"] + self.w["oc"]

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._run(x, mask, way, kept[way]) for way in "fb"}
        both = np.concatenate((states["f"], states["b"], x), 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["oc"], -30, 30)))
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        out = {"o": np.einsum("tb,tbu->u", d, both), "oc": np.array([d.sum()])}
        for k, way in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * UNITS), np.float32)
            dwh = np.zeros_like(self.w[way + "h"])
            dh = np.zeros((x.shape[1], UNITS), np.float32)
            dc = np.zeros_like(dh)
            direct = d[:, :, None] * self.w["o"][k * UNITS : (k + 1) * UNITS]
            for t, h0, c0, i, f, o, g, tanh, m in reversed(kept[way]):
                dh = dh + direct[t]
                dn = m * (dc + dh * o * (1 - tanh * tanh))
                do = m * dh * tanh
                dz = np.concatenate((dn * g * i * (1 - i), dn * c0 * f * (1 - f), do * o * (1 - o), dn * i * (1 - g * g)), 1)
                dwh += h0.T @ dz
                dz_all[t] = dz
                dh = dz @ self.w[way + "h"].T + (1 - m) * dh
                dc = dn * f + (1 - m) * dc
            out[way + "x"] = x.reshape(-1, SIZE).T @ dz_all.reshape(-1, 4 * UNITS)
            out[way + "h"], out[way + "c"] = dwh, dz_all.sum((0, 1))
        return out

    def learn(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, rate: float = 1e-2, seed: int = 7) -> None:
        """Adam over pages of (vectors, labels), pages of like length together."""
        draw, t = np.random.RandomState(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            sized = sorted(range(len(pages)), key=lambda i: len(pages[i][0]) + draw.rand() * 4)
            groups = [sized[a : a + 64] for a in range(0, len(sized), 64)]
            for at in draw.permutation(len(groups)):
                some = [pages[i] for i in groups[at]]
                x, mask = padded([p[0] for p in some])
                y = np.zeros(mask.shape, np.float32)
                for b, (_, labels) in enumerate(some):
                    y[: len(labels), b] = labels
                t += 1
                for k, g in self.slopes(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = rate * 0.75**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.w[k] = (self.w[k] - step).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Labels of the blocks of some pages."""
        if len(pages) == 1 and len(pages[0]) > PIECE:
            return [self.label_long(pages[0])]
        x, mask = padded([vectors_of(p) for p in pages])
        good = self.scores(x, mask) > 0
        return [good[: len(p), b].tolist() for b, p in enumerate(pages)]


    def label_long(self, page: list[Block], piece: int | None = None) -> list[bool]:
        """The same for one page of many blocks, piece by piece: only hidden states are kept of each block."""
        piece = piece or PIECE
        states = {way: np.empty((len(page), UNITS), np.float32) for way in "fb"}
        starts = range(0, len(page), piece)
        for way in "fb":
            carried: list = []
            for a in starts if way == "f" else reversed(starts):
                x, mask = padded([vectors_of(page[a : a + piece])])
                states[way][a : a + piece] = self._run(x, mask, way, state=carried)[:, 0]
        good = []
        for a in starts:
            both = np.concatenate((states["f"][a : a + piece], states["b"][a : a + piece], vectors_of(page[a : a + piece])), 1)
            good += (both @ self.w["o"] + self.w["oc"] > 0).tolist()
        return good


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pages as one array (T, B, SIZE), and which steps are theirs."""
    steps = max(1, *map(len, pages)) if len(pages) > 1 else max(1, len(pages[0]))
    x = np.zeros((steps, len(pages), SIZE), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for b, p in enumerate(pages):
        x[: len(p), b] = p
        mask[: len(p), b] = 1
    return x, mask


#: How the made pages mark their parts.
KEPT_BY = ("article", "main", "article", "article", "section class=post", "div class=content", "div id=content", "div class=article-body", "div class=entry-content", "main article", "div class=post-text")
LEFT_BY = {
    "menu": ("nav", "nav", "div class=nav", "div id=menu", "ul class=menu", "header nav", "div role=navigation", "div class=breadcrumbs"),
    "header": ("header", "header", "div class=header", "div id=header", "div class=masthead", "div class=banner top"),
    "footer": ("footer", "footer", "div class=footer", "div id=footer", "div class=copyright", "div class=site-info"),
    "sidebar": ("aside", "aside", "div class=sidebar", "div id=sidebar", "div class=related", "div class=widget", "section class=recommended"),
    "notice": ("div class=notice", "div class=cookie-notice", "div id=cookie-banner", "div class=alert", "div class=gdpr-consent", "div role=alert", "p class=notice", "dialog"),
    "advert": ("div class=ad", "div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "aside class=promo", "div id=ad"),
    "form": ("form", "form", "div class=newsletter form", "form class=search", "div class=subscribe form", "form id=login"),
    "comments": ("div class=comments", "section class=comments", "div id=comments", "ol class=comment-list", "section id=comments", "div class=comment", "section id=respond", "ul class=reader-comments"),
}
SAID = {
    "menu": ("Home", "News", "Contact", "About us", "Login", "Archive", "Sport"), "header": ("Welcome", "Daily", "Search"),
    "footer": ("© 2024", "All rights reserved.", "Privacy policy", "Terms", "Imprint"), "sidebar": ("Related", "Most read", "Popular", "Read more"),
    "notice": ("We use cookies.", "Accept", "By continuing you agree.", "Important notice"), "advert": ("Advertisement", "Sponsored", "Buy now", "Sale"),
    "form": ("Subscribe", "Your e-mail", "Send", "Search", "Name"), "comments": ("Reply", "Comments", "says:", "Great article!", "Anonymous"),
}


def made_page(draw: Random) -> tuple[str, set[str]]:
    """A made page and the texts of its main blocks (texts in it do not repeat)."""
    used: set[str] = set()
    sounds = ["".join(draw.choice("bcdfghklmnprstvzéüñ") + draw.choice("aeiouyäó") for _ in range(draw.randint(1, 3))) for _ in range(60)]

    def say(low: int, high: int) -> str:
        while True:
            n = draw.randint(low, high)
            words = ["".join(draw.choice(sounds) for _ in range(draw.choice((1, 1, 1, 2)))) for _ in range(n)]
            if draw.random() < 0.04:
                words = [w + draw.choice(("!!", "###", "***", " |")) for w in words]
            text = " ".join(words)
            text = (text.upper() if draw.random() < 0.03 else text[0].upper() + text[1:]) + draw.choice((".", ".", ".", "", "!", "?"))
            text = " ".join(text.split())
            if text not in used:
                used.add(text)
                return text

    def wrap(how: str, inside: str) -> str:
        opened = closed = ""
        for part in re.findall(r"(\w+)((?: (?:class|id|role)=[\w -]+?)?)(?= \w+(?: |$)|$)", how) if " " in how and "=" not in how else [(how.partition(" ")[0], how.partition(" ")[2])]:
            mark = part[1].strip()
            if "=" in mark:
                key, _, value = mark.partition("=")
                mark = f' {key}="{value}"' if draw.random() < 0.9 else ""
                if not mark and part[0] in ("div", "section", "p", "ul", "ol"):
                    mark = f' {key}="{value}"'
            opened += f"<{part[0]}{mark}>"
            closed = f"</{part[0]}>" + closed
        for _ in range(draw.choice((0, 0, 1))):
            inside = f"<div>{inside}</div>"
        return opened + inside + closed

    def left(kind: str) -> str:
        lines = [draw.choice(SAID[kind]) if draw.random() < 0.35 else say(1, 5 if kind in ("menu", "form") else draw.choice((8, 16, 40))) for _ in range(draw.randint(1, 8 if kind in ("menu", "comments") else 4))]
        used.update(lines)
        if kind == "menu" or kind in ("footer", "sidebar") and draw.random() < 0.5:
            inside = "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(lines)) + "</ul>"
        elif kind == "comments":
            inside = "".join(f"<{c}>{t}</{c.split()[0]}>" for t in lines for c in [draw.choice(("p", "p", "li", "div class='comment-body'"))])
        else:
            inside = "".join(t if draw.random() < 0.5 and len(lines) == 1 else f"<{c}>{t}</{c}>" for t in lines for c in [draw.choice(("p", "div", "h3", "label" if kind == "form" else "p"))])
        how = draw.choice(LEFT_BY[kind])
        return f'<p class="{how[8:]}">{" ".join(lines)}</p>' if how.startswith("p ") else wrap(how, inside)

    kept: list[str] = []

    def main() -> str:
        lines = []
        for i in range(draw.choice((1, 2, 3, 5, 8, 13, 20))):
            tag = draw.choice(("p",) * 12 + ("h2", "h3", "li", "blockquote", "pre", "td", "div"))
            text = say(1, 9) if tag in ("h2", "h3") or draw.random() < 0.35 else say(6, draw.choice((20, 60, 150)))
            kept.append(text)
            first, _, more = text.partition(" ")
            shown = f"{first} <a href='#'>{more}</a>" if draw.random() < 0.04 else text
            if tag == "p" and draw.random() < 0.15:
                lines.append(f"<p><b>{shown}<br>")
            elif tag == "li":
                lines.append(f"<ul><li>{shown}</li></ul>")
            elif tag == "td":
                lines.append(f"<table><tr><td>{shown}</td></tr></table>")
            else:
                lines.append(f"<{tag}>{shown}</{tag}>" if draw.random() < 0.9 or tag != "p" else f"<p>{shown}")
            if i and draw.random() < 0.06:
                lines.append(left(draw.choice(("advert", "advert", "notice", "form", "sidebar"))))
        if draw.random() < 0.75:
            kept.append(say(2, 12))
            lines.insert(0, f"<h1>{kept[-1]}</h1>")
        if draw.random() < 0.15:
            lines.append(left("comments"))
        return wrap(draw.choice(KEPT_BY), "".join(lines))

    body = [left(k) for k in ("menu", "header", "advert", "notice", "sidebar", "form") if draw.random() < {"menu": 0.85}.get(k, 0.35)]
    draw.shuffle(body)
    if draw.random() < 0.95:
        body.append(main())
    tail = [left(k) for k in ("comments", "sidebar", "advert", "form", "menu", "notice") if draw.random() < 0.3]
    draw.shuffle(tail)
    body += tail
    if draw.random() < 0.85:
        body.append(left("footer"))
    return "<html><body>" + "".join(body) + ("</body></html>" if draw.random() < 0.8 else ""), set(kept)


def training(pages: int = 1500, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made pages."""
    draw, found = Random(seed), []
    for _ in range(pages):
        page, kept = made_page(draw)
        own = blocks_of(page)
        if own:
            found.append((vectors_of(own), np.array([b.text in kept for b in own], np.float32)))
    return found


_LABELLER: list[Labeller] = []


def labeller() -> Labeller:
    """The trained labeller, trained once in a process."""
    if not _LABELLER:
        made = Labeller()
        made.learn(training())
        _LABELLER.append(made)
    return _LABELLER[0]


def main_texts(pages: DataFrame, batch: int = 64) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    known = pages.sparkSession.sparkContext.broadcast(labeller())

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def out() -> Iterator[tuple]:
            for (page_id, url, own), labels in zip(held, known.value.label([h[2] for h in held]), strict=True):
                text = "\n\n".join(b.text for b, good in zip(own, labels, strict=True) if good)
                yield page_id, url, text, len(text)

        size = 0
        for page_id, url, page in rows:
            own = blocks_of(page or "")
            if held and (len(held) == batch or max(size, len(own)) * (len(held) + 1) > 64 * 1024):
                yield from out()
                held, size = [], 0
            held.append((page_id, url, own))
            size = max(size, len(own))
        if held:
            yield from out()

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_rows(own, work, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
