"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags). A bidirectional LSTM in numpy reads the
page's blocks in order, each as the mean vector of its tag path (tags, classes and ids; trained), the mean of
its hashed words' vectors (fixed) and a few counts, and labels every block as main text or not with the whole page as context.

The labeller is trained on PAGES sampled pages of PAGE_BYTES at most. Their blocks are labelled by what markup says outright (what
stands in <article> or <main>, and not in a menu, form, advert, notice or comment there), and their
texts are dealt into made-up page layouts as well, so that it knows containers that these pages don't use.

Defined cases: null and empty html, and pages without main text, give the empty text; markup that is cut off or not
closed is read as far as it goes (a head ends at the first tag or text that can't stand in one; an svg, template, form control or the like
without an end tag is skipped as a tag only); scripts, styles and comments are never text, whatever they hold; pages with the same id or
html are each extracted; no rows give no rows; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Words, append_columns, numbered, slices, small_batches

#: Sampled pages that the labeller is trained on, and made-up layouts to each.
PAGES, LAYOUTS = 120, 3
PATHS, PATH_DIM, WORDS, WORD_DIM, COUNTS, HIDDEN = 4096, 16, 8192, 6, 5, 16
IN = PATH_DIM + WORD_DIM + COUNTS
#: A sampled page's size in bytes at most, so that the driver's sample is bounded.
PAGE_BYTES = 1 << 18
#: Blocks that are labelled at once, and steps whose inputs are worked out together.
CELLS, STEPS = 1 << 14, 1 << 11
OUT = ("text", "n_chars")

#: What may begin here: a comment, an element whose content is no markup, a tag, a declaration.
_BEGIN = re.compile(r"<!--|<(?P<raw>script|style)(?=[\s/>])|<(?P<title>title)(?=[\s/>])|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)|<[!?]", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style")}
_TITLE = re.compile(r"<title(?=[\s/>])[^>]*>(?:(?!<(?:/?title|/?svg|/head|body)(?=[\s/>])).)*</title(?=[\s/>])[^>]*>", re.S | re.I)
_STOP = re.compile(r"[=>]")
_AFTER_STOP = re.compile(r"=\s*([\"'])?")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no text up to their end tag.
SKIPPED = frozenset("noscript template iframe svg textarea select object".split())
_SKIPPED = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})(?=[\s/>])", re.I)
#: A start tag of the first kind ends an open one of the second.
ENDS = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
HEAD = frozenset(("head", "title"))
#: Tags that can stand in a head; any other one ends it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta noscript noframes template".split())

# ---- blocks --------------------------------------------------------------------------------


class Path:
    """Where a block stands: the path above it, and what its innermost tag adds. Blocks share what is above them."""

    __slots__ = ("above", "parts")

    def __init__(self, above: Path | None, parts: tuple[str, ...]):
        self.above, self.parts = above, parts

    def __iter__(self) -> Iterator[str]:
        up, own = [], self
        while own is not None:
            up.append(own.parts)
            own = own.above
        return (p for parts in reversed(up) for p in parts)


def path_parts(tag: str, attrs: str) -> tuple[str, ...]:
    """What a tag brings to the path of the blocks in it."""
    parts = [tag]
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        parts += [f"{'#' if name.lower() == 'id' else '.'}{x}" for x in (a or b or c).lower().split()]
    return tuple(parts)


class _Tags:
    """Where tags end: at the first > that is not in a quoted value, and a quote counts only where a value begins.

    What a = or > means for a tag that is open there doesn't depend on where the tag began, so each is looked at once.
    """

    def __init__(self, html: str):
        self.html = html
        self.stops = [m.start() for m in _STOP.finditer(html)]
        self.known: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The place after the tag that is open at this place; -1 if it isn't closed."""
        seen = []
        while True:
            k = bisect_left(self.stops, at)
            if k == len(self.stops) or k in self.known:
                found = self.known.get(k, -1)
                break
            seen.append(k)
            place = self.stops[k]
            if self.html[place] == ">":
                found = place + 1
                break
            m = _AFTER_STOP.match(self.html, place)
            at = m.end()
            if m[1]:
                at = self.html.find(m[1], at) + 1
                if not at:
                    found = -1
                    break
        self.known.update(dict.fromkeys(seen, found))
        return found


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether it is an end tag, attributes) in order; tag is None for comments and declarations, and \"\" for elements without text of their own."""
    tags, at, last = _Tags(html), 0, html.rfind(">")
    while m := _BEGIN.search(html, at):
        start, at = m.start(), m.end()
        if m["tag"]:
            end = tags.end(at)
            if end >= 0:
                yield start, end, m["tag"].lower(), bool(m["end"]), html[at : end - 1]
                at = end
        elif m["raw"]:
            close = _RAW_END[m["raw"].lower()].search(html, at)
            at = close.end() if close else len(html)
            yield start, at, "", False, ""
        elif m["title"]:
            whole = _TITLE.match(html, start)
            end = whole.end() if whole else tags.end(at)
            if end >= 0:
                yield start, end, "" if whole else "title", False, "" if whole else html[at : end - 1]
                at = end
        else:
            end = html.find("-->", at) + 3 if m[0] == "<!--" else html.find(">", at) + 1 if at <= last else 0
            if m[0] == "<!--" and end < 3:
                end = len(html)
            if end:
                yield start, end, None, False, ""
                at = end


def skipped(html: str) -> dict[int, int]:
    """Where each element of SKIPPED that has an end tag starts, and where that end tag ends."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for start, end, tag, closes, attrs in tokens(html) if _SKIPPED.search(html) else ():
        if tag not in SKIPPED:
            continue
        if not closes:
            if tag != "svg" or not attrs.rstrip().endswith("/"):
                open_.setdefault(tag, []).append(start)
        elif open_.get(tag):
            out[open_[tag].pop()] = end
    return out


def blocks(html: str) -> list[tuple[Path | None, str, int]]:
    """(path, text, characters in links) of each block that has text, in page order."""
    out: list[tuple[Path | None, str, int]] = []
    stack: list[tuple[str, Path]] = []
    text: list[str] = []
    links = heads = 0
    count: Counter[str] = Counter()  # open tags

    def flush() -> None:
        nonlocal text, links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined and not heads:
                out.append((stack[-1][1] if stack else None, joined, links))
            text, links = [], 0

    def pop(at: int) -> None:
        nonlocal heads
        for t, _ in stack[at:]:
            count[t] -= 1
            heads -= t in HEAD
        del stack[at:]

    def end_head() -> None:
        flush()
        pop(next(k for k, (t, _) in enumerate(stack) if t in HEAD))

    def add(part: str) -> None:
        nonlocal links
        if heads and stack[-1][0] == "head" and part.strip():
            end_head()
        text.append(part)
        links += len(part) * (count["a"] > 0)

    at, ends_at = 0, skipped(html)
    for start, end, tag, closes, attrs in tokens(html):
        if start < at:
            continue
        if start > at:
            add(html[at:start])
        at = end
        if not tag:
            if tag is not None:
                flush()
            continue
        if heads and not closes and tag not in IN_HEAD:
            end_head()
        if tag in SKIPPED:
            flush()
            at = ends_at.get(start, at)
            continue
        if tag == "br":
            text.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closes:
            for k in range(len(stack) - 1, -1, -1) if count[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break  # a stray end tag
        elif tag not in VOID:
            if not inline:
                ends = ENDS.get(tag, ("p",))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            stack.append((tag, Path(stack[-1][1] if stack else None, path_parts(tag, attrs))))
            count[tag] += 1
            heads += tag in HEAD
    if at < len(html):
        rest = html[at:]
        add(rest[: rest.rindex("<")] if re.search(r"<[/a-zA-Z!]", rest[rest.rfind(">") + 1 :]) else rest)
    flush()
    return out


# ---- features ------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _path_ids(parts: tuple[str, ...]) -> np.ndarray:
    """Places of tags, classes and ids, and of the words in these names (reader-comments has comment)."""
    words = [f"~{w.rstrip('s')}" for p in parts if p[0] in ".#" for w in re.split(r"[-_:]+", p[1:]) if w]
    return np.array([zlib.crc32(p.encode()) % PATHS for p in (*parts, *words)] or [0])


class Chains:
    """A page's paths: each node's places and the node above it (-1: none), and each block's node. A path's vector is summed from node to node, so that
    blocks far down cost no more than their own tags."""

    def __init__(self, above: list[int], ids: list[np.ndarray], at: list[int]):
        self.above, self.at = np.array(above, np.int64), np.array(at, np.int64)
        self.own = np.array(list(map(len, ids)), np.int64)
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        depth = [0] * len(above)
        for i, a in enumerate(above):
            depth[i] = depth[a] + 1 if a >= 0 else 0
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1])[1:] if len(above) else []
        self.size = self.down(self.own.copy())

    @classmethod
    def of(cls, paths: list[Path | None]) -> Chains:
        number: dict[int, int] = {}
        above, ids, at = [], [], []
        for p in paths:
            new = []
            own = p
            while own is not None and id(own) not in number:
                new.append(own)
                own = own.above
            for one in reversed(new):
                number[id(one)] = len(above)
                above.append(number[id(one.above)] if one.above is not None else -1)
                ids.append(_path_ids(one.parts))
            if p is None and 0 not in number:
                number[0] = len(above)
                above.append(-1)
                ids.append(_path_ids(()))
            at.append(number[id(p) if p is not None else 0])
        return cls(above, ids, at)

    def __len__(self) -> int:
        return len(self.at)

    def down(self, own: np.ndarray) -> np.ndarray:
        """Each node's own values and those of all above it."""
        for level in self.levels:
            own[level] += own[self.above[level]]
        return own

    def up(self, values: np.ndarray) -> np.ndarray:
        """Each node's values and those of all below it."""
        for level in reversed(self.levels):
            np.add.at(values, self.above[level], values[level])
        return values

    def means(self, table: np.ndarray) -> np.ndarray:
        """Each block's path vector: its places' vectors summed, over the root of their number."""
        sums = self.down(np.add.reduceat(table[self.flat], np.cumsum(self.own) - self.own))
        return (sums / np.sqrt(self.size)[:, None])[self.at]

    def spread(self, gradient: np.ndarray, table: np.ndarray) -> None:
        """Adds to table what the blocks' gradients of means say of its vectors."""
        node = np.zeros((len(self.own), gradient.shape[1]), gradient.dtype)
        np.add.at(node, self.at, gradient / np.sqrt(self.size[self.at])[:, None].astype(gradient.dtype))
        np.add.at(table, self.flat, np.repeat(self.up(node), self.own, axis=0))


_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_WORD_VECTORS = np.random.default_rng(17).normal(0, 1, (WORDS, WORD_DIM)).astype(np.float32)


def features(pages: list[list[tuple[Path | None, str, int]]]) -> list[tuple[Chains, np.ndarray]]:
    """For each page its blocks' paths, and the means of their words' vectors with their counts."""
    flat = [b for page in pages for b in page]
    rest = np.zeros((len(flat), WORD_DIM + COUNTS), np.float32)
    for a, b in slices([len(x[1]) for x in flat]):
        part = flat[a:b]
        w = Words([t.encode().translate(LOWER) for _, t, _ in part], _SPACE)
        at = w.bounds[:-1]
        n = np.diff(w.bounds).astype(np.float32)
        ids = (w.hashes >> np.uint64(64 - 13)).astype(np.int64)
        sums = np.add.reduceat(np.append(_WORD_VECTORS[ids], np.zeros((1, WORD_DIM), np.float32), axis=0), at, axis=0) * (n > 0)[:, None]
        n = np.maximum(n, 1)
        size = np.array([len(t) for _, t, _ in part], np.float32)
        rest[a:b, :WORD_DIM] = sums / n[:, None]
        rest[a:b, WORD_DIM] = np.log1p(n) / 3
        rest[a:b, WORD_DIM + 1] = np.minimum(1, np.array([x for _, _, x in part]) / size)
        rest[a:b, WORD_DIM + 2] = np.array([t.count(",") for _, t, _ in part]) / n
        rest[a:b, WORD_DIM + 3] = [t[-1] in ".!?" for _, t, _ in part]
        rest[a:b, WORD_DIM + 4] = np.log1p(size / n) / 3
    out, at = [], 0
    for page in pages:
        out.append((Chains.of([p for p, _, _ in page]), rest[at : at + len(page)]))
        at += len(page)
    return out


# ---- the network ---------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"wx{d}"] = rng.normal(0, 1 / np.sqrt(IN), (IN, 4 * HIDDEN))
            self.p[f"wh{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, forget, out, new
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, pages: list[tuple[Chains, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded to the longest page: (steps, pages, IN), and which are real."""
        steps = max(len(p[0]) for p in pages)
        x, real = np.zeros((steps, len(pages), IN), np.float32), np.zeros((steps, len(pages)), np.float32)
        for j, (paths, rest) in enumerate(pages):
            n = len(paths)
            x[:n, j, :PATH_DIM] = paths.means(self.p["path"])
            x[:n, j, PATH_DIM:] = rest
            real[:n, j] = 1
        return x, real

    def _direction(self, x: np.ndarray, real: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """The states after each step; what training has to know of a step goes on the tape."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, pre = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), np.zeros(0)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            if d == "f" and t % STEPS == 0 or d == "b" and (t == len(x) - 1 or t % STEPS == STEPS - 1):
                a = t - t % STEPS  # inputs of a stretch of steps at once
                pre = x[a : a + STEPS] @ self.p[f"wx{d}"] + self.p[f"b{d}"]
            z = pre[t - a] + h @ self.p[f"wh{d}"]
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = real[t][:, None]
            c1 = (f * c + i * g) * m  # padding holds zeros, before and after a page
            y = np.tanh(c1)
            h1 = o * y * m
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, y, m))
            h, c = h1, c1
            out[t] = h
        return out

    def forward(self, x: np.ndarray, real: np.ndarray, tapes: tuple[list, list] | tuple[None, None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """Each block's probability, and the states of both directions."""
        h = np.concatenate([self._direction(x, real, d, tape) for d, tape in zip("fb", tapes, strict=True)], axis=2)
        return _sigmoid(h @ self.p["out"] + self.p["bias"]), h

    def _back(self, x: np.ndarray, dout: np.ndarray, tape: list, d: str, grad: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
        for t, h, c, i, f, o, g, y, m in reversed(tape):
            dh = (dh + dout[t]) * m
            dc = (dc + dh * o * (1 - y * y)) * m
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * y * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            grad[f"wx{d}"] += x[t].T @ dz
            grad[f"wh{d}"] += h.T @ dz
            grad[f"b{d}"] += dz.sum(axis=0)
            dx[t] = dz @ wx.T
            dh, dc = dz @ wh.T, dc * f
        return dx

    def fit(self, pages: list[tuple[Chains, np.ndarray]], labels: list[np.ndarray], rounds: int = 16, size: int = 24, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the mean log loss over blocks."""
        rng = np.random.default_rng(seed)
        m, v, n = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        order = np.argsort([len(p[0]) for p in pages], kind="stable")  # pages of like length together, so that little is padding
        groups = [order[a : a + size] for a in range(0, len(order), size)]
        for _ in range(rounds):
            for k in rng.permutation(len(groups)).tolist():
                own = [pages[j] for j in groups[k]]
                x, real = self.inputs(own)
                y = np.zeros(real.shape, np.float32)
                for j, i in enumerate(groups[k].tolist()):
                    y[: len(labels[i]), j] = labels[i]
                tf, tb = [], []
                p, h = self.forward(x, real, (tf, tb))
                dz = (p - y) * real / real.sum()
                grad = {k: np.zeros_like(x) for k, x in self.p.items()}
                grad["out"] = np.einsum("tph,tp->h", h, dz)
                grad["bias"] = dz.sum().reshape(1)
                dh = dz[:, :, None] * self.p["out"]
                dx = self._back(x, dh[:, :, :HIDDEN], tf, "f", grad) + self._back(x, dh[:, :, HIDDEN:], tb, "b", grad)
                for j, (paths, _) in enumerate(own):
                    paths.spread(dx[: len(paths), j, :PATH_DIM], grad["path"])
                n += 1
                for key, g in grad.items():
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.999 * v[key] + 0.001 * g * g
                    self.p[key] -= (rate * (m[key] / (1 - 0.9**n)) / (np.sqrt(v[key] / (1 - 0.999**n)) + 1e-6)).astype(np.float32)

    def label(self, pages: list[tuple[Chains, np.ndarray]], size: int = 64, cells: int = CELLS) -> list[np.ndarray]:
        """Each block's probability of being main text; all pages, in their order. size pages of cells blocks, padding included, at once, or one page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][0])), key=lambda i: len(pages[i][0]))
        while order:
            n = 1
            while n < min(size, len(order)) and (n + 1) * len(pages[order[n]][0]) <= cells:
                n += 1
            part, order = order[:n], order[n:]
            p, _ = self.forward(*self.inputs([pages[i] for i in part]))
            for j, i in enumerate(part):
                out[i] = p[: len(pages[i][0]), j].copy()
        return out


# ---- training pages ------------------------------------------------------------------------

#: What containers of main text, and of other things, are called.
MAIN = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", "#content"), ("div", ".article"), ("div", "#main"), ("section", ".post"), ("div", ".entry-content"), ("div", ".article-body"), ("div", ".post-content"), ("div", ".story"), ("div", ".text"), ("td", ".content"), ("div", "#article"), ("section", ".content"), ("div", ".main-content"), ("div", ".body"), ("div", ".page-content"), ("article", ".post")]
OTHER = [("nav", "ul", "li", "a"), ("header",), ("footer",), ("aside",), ("div", ".sidebar"), ("div", "#sidebar"), ("div", ".menu"), ("ul", ".menu", "li", "a"), ("div", ".nav"), ("div", "#nav"), ("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("div", ".advertisement"), ("div", ".sponsored"), ("div", ".banner"), ("div", ".promo"), ("div", ".cookie"), ("div", ".cookie-banner"), ("div", ".notice"), ("div", ".consent"), ("form",), ("form", "label"), ("form", "button"), ("div", ".newsletter"), ("div", ".subscribe"), ("div", ".comments"), ("div", "#comments"), ("section", ".comments"), ("div", ".comment"), ("ol", ".comment-list", "li"), ("section", "#comments", "div", ".comment"), ("div", ".related"), ("div", ".share"), ("div", ".social"), ("div", ".breadcrumb"), ("div", ".breadcrumbs"), ("div", ".header"), ("div", "#header"), ("div", ".footer"), ("div", "#footer"), ("div", ".copyright"), ("div", ".popup"), ("div", ".modal"), ("div", ".widget"), ("div", ".tags"), ("div", ".pagination"), ("div", ".login"), ("div", ".toolbar"), ("div", ".legal"), ("div", ".search"), ("div", ".signup"), ("div", ".reader-comments"), ("div", ".alert"), ("div", ".disclaimer"), ("div", ".sponsor"), ("section", ".feedback"), ("div", ".reply"), ("nav",), ("menu", "li"), ("dialog",), ("fieldset",), ("div", ".privacy"), ("div", ".site-header"), ("div", ".site-footer"), ("div", ".navbar"), ("button",), ("table", ".nav", "tr", "td", "a")]
_OTHER_PARTS = {p for path in OTHER for p in path} - {p for path in MAIN for p in path} - {"ul", "ol", "li", "a", "label", "table", "tr", "td", "div", "section"}


def markup_labels(page: list[tuple[Path | None, str, int]]) -> np.ndarray:
    """What the markup says outright: in an article or main element, and in nothing else's container there."""
    # of each path: the elements of the two that were met, and whether another container was since
    known: dict[int, tuple[frozenset, bool]] = {}
    out = []
    for path, _, _ in page:
        new = []
        own = path
        while own is not None and id(own) not in known:
            new.append(own)
            own = own.above
        for one in reversed(new):
            met, other = known[id(one.above)] if one.above is not None else (frozenset(), False)
            for p in one.parts:
                if p in ("article", "main") and p not in met:
                    met, other = met | {p}, False
                other = other or p in _OTHER_PARTS
            known[id(one)] = met, other
        met, other = known[id(path)] if path is not None else (frozenset(), False)
        out.append(bool(met) and not other)
    return np.array(out, np.float32)


def layout(page: list[tuple[Path | None, str, int]], labels: np.ndarray, rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """The page's texts in a made-up layout."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    main = [t for (_, t, _), y in zip(page, labels, strict=True) if y] or ["Text."]
    other = [t for (_, t, _), y in zip(page, labels, strict=True) if not y] or ["Menu"]
    outer = ("html", "body", *pick([(), ("div",), ("div", ".wrapper"), ("div", "#page"), ("div", ".container"), ("table", "tr")]))
    made: list[tuple[tuple, str, int, bool]] = []

    def aside(base: tuple) -> None:
        path = (*base, *pick(OTHER))
        if rng.random() < 0.3:
            path = (*path, "p")
        for _ in range(int(rng.integers(1, 5))):
            # comments and notices are prose too
            t = pick(main) if rng.random() < 0.4 else pick(other)
            made.append((path, t, len(t) if "a" in path else 0, False))

    for _ in range(int(rng.integers(0, 4))):
        aside(outer)
    body = (*outer, *pick(MAIN))
    for k, t in enumerate(main):
        tag = pick([("h1",), ("header", "h1"), ("h2",)]) if k == 0 and rng.random() < 0.7 else pick([("p",)] * 8 + [("ul", "li"), ("blockquote", "p"), ("div",), ("h2",), ("pre",), ("table", "tr", "td"), ()])
        made.append(((*body, *tag), t, 0, True))
        if rng.random() < 0.08:
            aside(body)
    if rng.random() < 0.3:
        aside(body)
    for _ in range(int(rng.integers(0, 4))):
        aside(outer)
    return [(Path(None, path), t, n) for path, t, n, _ in made], np.array([m[3] for m in made], np.float32)


def train(pages: DataFrame, most: int = PAGES, layouts: int = LAYOUTS, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """A labeller from most pages of PAGE_BYTES at most, chosen by a hash of the id."""
    small_batches(pages.sparkSession)
    plain, number, _ = numbered(pages)
    pages = plain.select(F.col(number(id_col)).alias("id"), F.col(number(html_col)).alias("html")).filter(F.coalesce(F.octet_length("html"), F.lit(0)) <= PAGE_BYTES)
    id_col, html_col = "id", "html"
    ids = pages.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "__id")
    rows = rows.groupBy("__id").agg(F.min("html").alias("html")).collect()  # most rows at most
    rng, shown, labels = np.random.default_rng(9), [], []
    sources = [blocks(r.html or "") for r in sorted(rows, key=lambda r: r[0])]
    sources = [p for p in sources if p] or [[(Path(None, ("html", "body", "article", "p")), "Some text.", 0), (Path(None, ("html", "body", "nav", "a")), "Menu", 4)]]
    for page in sources:
        own = markup_labels(page)
        if own.any():
            shown.append(page)
            labels.append(own)
        for _ in range(layouts):
            made, y = layout(page, own, rng)
            shown.append(made)
            labels.append(y)
    model = Labeller()
    model.fit(features(shown), labels)
    return model


def extract(pages: DataFrame, model: Labeller, html_col: str = "html", html_stays: bool = True) -> DataFrame:
    """pages with text (blocks of main text, two line ends between) and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column, texts = batch.column(batch.schema.get_field_index(html_col)), []
        for a in range(0, len(column), 256):
            own = [blocks(x.as_py() or "") for x in column[a : a + 256]]
            for page, p in zip(own, sent.value.label(features(own)), strict=True):
                texts.append("\n\n".join(t for (_, t, _), y in zip(page, p, strict=True) if y >= 0.5))
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}

    new = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return append_columns(pages, make, new, [] if html_stays else [html_col])
