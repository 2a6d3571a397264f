"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks (stretches of text between block-level tags) with the path of open tags above each.  A
numpy bidirectional LSTM reads the page's blocks in order, each as a vector of its tag path, its hashed words and its
measures, and labels every block as article or not with the whole document as context.

The labeller is trained here, on a bounded sample of the pages (``TRAIN_PAGES`` pages of all sizes, chosen by a hash of
page_id, of each the first ``TRAIN_BYTES``, in windows of ``TRAIN_BLOCKS`` blocks), with weak labels.  On a page with an
article or main element, a block below it and below no boilerplate element or class is article.  On any other page it is
a block below no boilerplate that reads as prose or stands in one container with such blocks.  To see more layouts than a
sample has, training also uses copies of its pages with boilerplate of all kinds spliced in and with the article's own
tags renamed to plain containers.

Edge cases: a null html is empty and has the empty text; a row without page_id is not learned from; if no block of the
sample is labelled article, each that is below no boilerplate is; with no block at all nothing is learned and no page has
text; repeated rows give repeated rows and count once in training; very long pages are labelled whole.  Only ``page_id``,
``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES, TRAIN_BYTES, TRAIN_BLOCKS, TRAIN_WINDOWS = 240, 100_000, 60, 4
EPOCHS = 25
HIDDEN = 16
PATH_BUCKETS, WORD_BUCKETS = 48, 64
_CELLS_AT_ONCE = 20_000
_MEMO_CHARACTERS = 4_000_000
_MEMO_WORDS = 200_000

# HTML's element names.
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_RAW = frozenset("script style noscript textarea title iframe".split())
_CODE = frozenset(("script", "style"))  # hide the rest of the page if they never end
_HIDDEN = frozenset("template object svg canvas audio video".split())  # nested elements whose text is not the page's
_FOREIGN = frozenset(("svg", "math"))
_LEAVE_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES["body"] = {"head"}
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in _RAW | _HIDDEN}
_BARRIERS = _INTEGRATION | _BLOCKS
_SCOPES = frozenset("ul ol dl table div article section aside nav header footer main form body".split())
_MEANT = frozenset("article main nav header footer aside section form".split())
#: Words in tags, classes and ids for what a part of a page is; every category is one measure of a path.
CATEGORIES = {
    "article": ("article", "main", "content", "post", "entry", "story", "body-text"),
    "navigation": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"),
    "header": ("header", "masthead", "banner", "topbar", "branding"),
    "footer": ("footer", "copyright", "colophon", "legal", "bottom"),
    "sidebar": ("aside", "sidebar", "widget", "related", "recommended", "trending", "popular", "rail"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "modal", "popup", "overlay", "warning", "disclaimer"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "dfp"),
    "form": ("form", "fieldset", "button", "select", "option", "legend", "newsletter", "subscribe", "signup", "login", "search"),
    "comments": ("comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "reviews"),
    "social": ("share", "sharing", "social", "follow"),
}
_NAMES = list(CATEGORIES)
_CATEGORY_OF = {word: k for k, words in enumerate(CATEGORIES.values()) for word in words}
_TAGS = ("p", "li", "a", "td", "h1", "h2", "h3", "blockquote", "pre", "figcaption")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_TAG_MARKS = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Path:
    """The open block elements above a text, each "tag" or "tag.name.name", as a chain of shared nodes, so that a path costs one node however deep it is."""

    __slots__ = ("parent", "label", "size", "in_main", "boilerplate", "vector", "_below")

    def __init__(self, parent: Path | None = None, label: str = ""):
        self.parent, self.label, self.vector, self._below = parent, label, None, {}
        words = label.split(".")
        self.size = parent.size + 1 if parent else 0
        self.in_main = bool(parent) and (parent.in_main or words[0] in ("article", "main"))
        self.boilerplate = bool(parent) and (parent.boilerplate or any(_CATEGORY_OF.get(w) for w in words))

    def below(self, label: str) -> Path:
        """The path with one more element; equal paths of one root are one object."""
        if (node := self._below.get(label)) is None:
            node = self._below[label] = Path(self, label)
        return node

    def __bool__(self) -> bool:
        return True

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        labels, node = [], self
        while node.parent:
            labels.append(node.label)
            node = node.parent
        return reversed(labels)


class Block(NamedTuple):
    path: Path
    text: str
    linked: int  # characters inside links


class _Open:
    """The open elements of a page, with the places of each tag and of some groups of tags, so that none is ever searched for."""

    def __init__(self, root: Path):
        self.tags: list[str] = []
        self.paths = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes, self.foreign, self.barriers, self.hidden = self.groups = [], [], [], []

    def push(self, tag: str, label: str) -> None:
        place = len(self.tags)
        self.tags.append(tag)
        self.paths.append(self.paths[-1].below(label) if tag in _BLOCKS else self.paths[-1])
        self.places.setdefault(tag, []).append(place)
        for group, members in zip(self.groups, (_SCOPES, _FOREIGN, _BARRIERS, _HIDDEN), strict=True):
            if tag in members:
                group.append(place)

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.paths.pop()
        for group in self.groups:
            while group and group[-1] >= place:
                group.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost of some tags, or -1."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=-1)

    def in_scope(self, place: int) -> bool:
        return place > (self.scopes[-1] if self.scopes else -1)


def read_blocks(html: str, root: Path | None = None) -> list[Block]:
    """The page's leaf blocks in order, without the text of scripts, styles, comments, embedded objects and the head.

    A hidden element that never ends hides nothing; one that ends does not end the block around it.  Time grows with the
    page's length, whatever is unclosed in it.
    """
    blocks: list[Block] = []
    stack = _Open(root or Path())
    parts: list[str] = []
    links = linked = 0
    outside: Path | None = None  # the path around a hidden element while in one
    next_end: dict[str, tuple[int, int]] = {}
    last_mark = html.rfind(">")  # no tag ends behind it
    ends: dict[int, int] = {}  # from a quotation mark outside quotations to the end of its tag

    def end_block(around: Path | None = None) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip() if parts else ""
        if text:
            blocks.append(Block(stack.paths[-1] if around is None else around, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def ending(tag: str, at: int) -> int | None:
        """Where the element's next end tag ends, if there is one."""
        if next_end.get(tag, (0, 0))[0] < at:
            found = _ENDS[tag].search(html, at, last_mark + 1)
            next_end[tag] = found.span() if found else (len(html), len(html) + 1)
        return next_end[tag][1] if next_end[tag][0] < len(html) else None

    def tag_end(at: int) -> int:
        """Place of the ">" behind a tag's attributes, which may be quoted, or -1."""
        passed, end = [], -1
        while at <= last_mark:
            mark = _TAG_MARKS.search(html, at).start()
            if html[mark] == ">" or mark in ends:
                end = ends.get(mark, mark)
                break
            passed.append(mark)
            close = html.find(html[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        ends.update(dict.fromkeys(passed, end))
        return end

    def add(raw: str) -> None:
        nonlocal linked
        if outside is not None:
            return
        text = entities.unescape(raw)
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            add(html[at:start])
        if start == len(html):
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = end + 1 if end >= 0 else len(html)
            continue
        found = _TAG.match(html, start) if start < last_mark else None
        end = tag_end(found.end()) if found else -1
        if end < 0:
            if start < last_mark and (found or html.startswith("</", start)):
                at = html.find(">", start) + 1
            else:
                add("<")
                at = start + 1
            continue
        closing, tag, attributes = found[1], found[2].lower(), html[found.end() : end]
        at = end + 1
        empty = attributes.endswith("/")
        if tag in _RAW and not closing:
            if not (empty and (tag not in _CODE or stack.foreign)):
                end = ending(tag, at)
                at = end or (len(html) if tag in _CODE else at)
            continue
        around = outside
        if around is None:
            if tag in _BLOCKS:
                end_block()
            elif tag == "br":
                parts.append(" ")
        if tag in _LEAVE_FOREIGN and not closing:
            while stack.foreign and stack.foreign[-1] > (stack.barriers[-1] if stack.barriers else -1):
                stack.cut(stack.foreign[-1])
        if closing:
            place = stack.last(tag)
            if place >= 0 and (tag in _SCOPES or stack.in_scope(place)):
                stack.cut(place)
        elif tag not in _VOID and not empty and (tag not in _HIDDEN or ending(tag, at)):
            if tag in _CLOSES and (place := stack.last(*_CLOSES[tag])) >= 0 and stack.in_scope(place):
                stack.cut(place)
            named = [w.lower() for m in _NAMED.findall(attributes) for w in _PARTS.findall(" ".join(m))] if attributes else []
            if tag in _HIDDEN and outside is None:
                outside = stack.paths[-1]
            stack.push(tag, ".".join([tag, *named]))
        if around is not None and not stack.hidden:
            outside = None
            if tag in _BLOCKS:
                end_block(around)
        if tag == "a":
            links = len(stack.places.get("a", ()))
    end_block(outside)
    return blocks


def weak_labels(blocks: list[Block]) -> list[int]:
    """For each block of a page 1 if it is likely article, else 0.  Boilerplate is what is below an element or class of any kind but article."""
    inside = [b.path.in_main for b in blocks]
    free = [not b.path.boilerplate for b in blocks]
    if any(inside):
        return [int(i and f) for i, f in zip(inside, free, strict=True)]
    prose = [f and len(b.text.split()) >= 10 and 3 * b.linked < len(b.text) and any(c in b.text for c in ".!?") for b, f in zip(blocks, free, strict=True)]
    containers = {id(b.path.parent) for b, p in zip(blocks, prose, strict=True) if p}
    return [int(p or f and id(b.path.parent) in containers and 2 * b.linked < len(b.text)) for b, p, f in zip(blocks, prose, free, strict=True)]


class _Vectors:
    """Blocks as vectors; what paths and words give is kept in memos of bounded size."""

    size = len(_NAMES) + len(_TAGS) + PATH_BUCKETS + WORD_BUCKETS + 6

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def _path(self, path: Path) -> np.ndarray:
        """The parent's measures and the last element's; kept with the path."""
        above = []
        while path.vector is None and path.parent:
            above.append(path)
            path = path.parent
        if path.vector is None:
            path.vector = np.zeros(len(_NAMES) + len(_TAGS) + PATH_BUCKETS, np.float32)
        for node in reversed(above):
            out = path.vector.copy()
            tag, *named = node.label.split(".")
            for word in (tag, *named):
                if word in _CATEGORY_OF:
                    out[_CATEGORY_OF[word]] = 1
            if tag in _TAGS:
                out[len(_NAMES) + _TAGS.index(tag)] = 1
            out[len(_NAMES) + len(_TAGS) + zlib.crc32(node.label.encode()) % PATH_BUCKETS] = 0.3
            node.vector, path = out, node
        return path.vector

    def _word(self, word: str) -> int:
        if (k := self.words.get(word)) is None:
            if len(self.words) > _MEMO_WORDS:
                self.words.clear()
            k = self.words[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
        return k

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), self.size), np.float32)
        n = len(_NAMES) + len(_TAGS) + PATH_BUCKETS
        for k, block in enumerate(blocks):
            words = block.text.split()
            counts = np.bincount([self._word(w) for w in words], minlength=WORD_BUCKETS)
            size = len(block.text)
            marks = sum(block.text.count(c) for c in ".!?,;:")
            out[k, :n] = self._path(block.path)
            out[k, n : n + WORD_BUCKETS] = counts / np.sqrt((counts**2).sum()) * 0.3
            out[k, -6:] = (np.log1p(len(words)) / 5, np.log1p(size) / 8, block.linked / size, min(1.0, 4 * marks / len(words)), len(block.path) / 10, (k + 1) / len(blocks))
        return out


class Labeller:
    """A bidirectional LSTM over a page's blocks with a logistic output; trained with back-propagation and Adam."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "lr":
            self.p[f"x{side}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * hidden)).astype(np.float32)
            self.p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"b{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)  # gates: in, forget, out, new
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, side: str, x: np.ndarray, live: np.ndarray, learn: bool = True):
        """x: time, page, measure; live: time, page.  The states, and what learning needs of every step."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        c, n, trace = h, self.hidden, []
        states = np.zeros((*x.shape[:2], n), np.float32)
        inputs = x @ self.p[f"x{side}"] + self.p[f"b{side}"]
        for t in range(len(x)) if side == "l" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{side}"]
            gates, new = self._sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            on = live[t][:, None]
            c2 = np.where(on, f * c + i * new, c)
            tanh = np.tanh(c2)
            h2 = np.where(on, o * tanh, h)
            if learn:
                trace.append((t, h, c, i, f, o, new, tanh, on))
            h, c, states[t] = h2, c2, h2
        return states, trace

    def forward(self, x: np.ndarray, live: np.ndarray, learn: bool = True):
        left, left_trace = self._run("l", x, live, learn)
        right, right_trace = self._run("r", x, live, learn)
        both = np.concatenate([left, right], axis=2)
        return self._sigmoid(both @ self.p["o"] + self.p["ob"][0]), both, left_trace, right_trace

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, both, *traces = self.forward(x, live)
        error = np.where(live, out - y, 0).astype(np.float32) / max(1, live.sum())
        g = {"o": np.tensordot(error, both, ((0, 1), (0, 1))), "ob": np.array([error.sum()], np.float32)}
        n = self.hidden
        for side, trace, part in zip("lr", traces, (slice(0, n), slice(n, None)), strict=True):
            wx, wh = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(self.p[f"h{side}"])
            b = np.zeros_like(self.p[f"b{side}"])
            dh = dc = np.zeros((x.shape[1], n), np.float32)
            for t, h, c, i, f, o, new, tanh, on in reversed(trace):
                dh = dh + error[t][:, None] * self.p["o"][part]
                inner = np.where(on, dc + dh * o * (1 - tanh**2), 0)
                dz = np.concatenate([inner * new * i * (1 - i), inner * c * f * (1 - f), np.where(on, dh * tanh, 0) * o * (1 - o), inner * i * (1 - new**2)], axis=1)
                wx += x[t].T @ dz
                wh += h.T @ dz
                b += dz.sum(0)
                dh, dc = np.where(on, 0, dh) + dz @ self.p[f"h{side}"].T, np.where(on, inner * f, dc)
            g |= {f"x{side}": wx, f"h{side}": wh, f"b{side}": b}
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02) -> None:
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order, step = sorted(range(len(pages)), key=lambda k: len(pages[k])), 0
        groups = [order[k : k + 48] for k in range(0, len(order), 48)]
        shuffle = random.Random(3)
        for _ in range(epochs):
            shuffle.shuffle(groups)
            for group in groups:
                x, live = padded([pages[k] for k in group])
                y = np.zeros(live.shape, np.float32)
                for column, k in enumerate(group):
                    y[: len(labels[k]), column] = labels[k]
                step += 1
                for name, g in self.gradients(x, live, y).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
        while order:
            some, order = order[: (n := max(1, _CELLS_AT_ONCE // len(pages[order[0]])))], order[n:]
            scores = self.forward(*padded([pages[k] for k in some]), learn=False)[0]
            for column, k in enumerate(some):
                out[k] = scores[: len(pages[k]), column] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    live = np.zeros(x.shape[:2], bool)
    for k, page in enumerate(pages):
        x[: len(page), k], live[: len(page), k] = page, True
    return x, live


def _renamed(root: Path, name: Callable[[str], str]) -> Callable[[Path], Path]:
    """A function of a path: its copy below ``root`` with other labels."""
    copies: dict[int, tuple[Path, Path]] = {}

    def copy(path: Path) -> Path:
        above = []
        while path.parent and id(path) not in copies:
            above.append(path)
            path = path.parent
        found = copies[id(path)][1] if path.parent else root
        for node in reversed(above):
            found = found.below(name(node.label))
            copies[id(node)] = node, found
        return found

    return copy


def _anonymous(blocks: list[Block], rng: random.Random) -> list[Block]:
    """A copy of a page without classes and ids, and in half of the copies with plain containers for all that have a meaning."""
    plain = _MEANT if rng.random() < 0.5 else ("article", "main")
    renamed = _renamed(Path(), lambda label: "div" if (tag := label.split(".")[0]) in plain else tag)
    return [b._replace(path=renamed(b.path)) for b in blocks]


def _spliced(blocks: list[Block], labels: list[int], pool: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A copy of a page in another layout: plain containers for the article's tags, boilerplate of some kinds spliced in."""
    plain = rng.choice([None, "div.content", "div.post", "section", "div"])
    root = Path()
    renamed = _renamed(root, lambda label: plain if plain and label.split(".")[0] in ("article", "main") else label)
    out = [(b._replace(path=renamed(b.path)), y) for b, y in zip(blocks, labels, strict=True)]
    inside = [k for k, (_, y) in enumerate(out) if y]
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(_NAMES[1:])
        word = rng.choice(CATEGORIES[kind])
        tag = word if word in _BLOCKS else rng.choice(["div", "section", "ul", "p"])
        part = tag if tag == word else f"{tag}.{word}"
        within = inside and rng.random() < 0.5  # in the article, else before or behind it
        k = rng.choice(inside) + rng.randint(0, 1) if within else rng.choice([0, len(out)])
        near = out[min(k, len(out) - 1)][0].path if within else root.below("html").below("body")
        above = near.parent if within and len(near) > 2 else near
        texts = [" ".join(rng.choice(pool).split()[: rng.randint(1, 40 if kind in ("comments", "notice", "sidebar") else 12)]) for _ in range(rng.randint(1, 4))]
        leaf = rng.choice(["p", "li", None])
        path = above.below(part).below(leaf) if leaf else above.below(part)
        out[k:k] = [(Block(path, t, len(t) if leaf == "li" and kind in ("navigation", "sidebar") else 0), 0) for t in texts if t]
        inside = [j for j, (_, y) in enumerate(out) if y]
    if not out:
        return [], []
    blocks, labels = zip(*out, strict=True)
    return list(blocks), list(labels)


def _copies(blocks: list[Block], labels: list[int], pool: list[str], rng: random.Random) -> list[tuple[list[Block], list[int]]]:
    """A page and its copies: in two other layouts, and two without names, so that what needs none is learned, too."""
    first, second = (_spliced(blocks, labels, pool, rng) for _ in range(2))
    return [(blocks, labels), first, second, (_anonymous(blocks, rng), labels), (_anonymous(first[0], rng), first[1])]


def training_pages(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> list[str]:
    """The first ``TRAIN_BYTES`` of a bounded sample of the pages."""
    ids = pages.where("page_id is not null").select("page_id").distinct()
    # Ids first: every task sends its smallest to the driver, which must not be whole pages.
    chosen = ids.orderBy(F.xxhash64(F.col("page_id").cast("string"), F.lit("pages")), "page_id").limit(train_pages).collect()
    if not chosen:
        return []
    start = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, TRAIN_BYTES)
    sample = pages.where(F.col("page_id").isin([row.page_id for row in chosen])).groupBy("page_id").agg(F.min(start).alias("html"))
    return [row.html for row in sample.orderBy("page_id").collect()]


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Labeller:
    """Train on a bounded sample of the pages."""
    read = [b for html in training_pages(pages, train_pages) if (b := read_blocks(html))]
    labels = [weak_labels(b) for b in read]
    if not any(map(any, labels)):
        labels = [[int(not x.path.boilerplate) for x in b] for b in read]
    pool = [x.text for b in read for x in b]
    rng, vectors, model = random.Random(1), _Vectors(), Labeller(_Vectors.size)
    data = [s for b, y in zip(read, labels, strict=True) for s in _copies(b, y, pool, rng)]
    # Windows of a page, each with vectors that know its place in the page; of a long page some at even distances.
    windows = []
    for b, y in data:
        x, n = vectors.of(b), -(-len(b) // TRAIN_BLOCKS)
        for k in range(0, n, -(-n // TRAIN_WINDOWS)):
            own = slice(k * TRAIN_BLOCKS, (k + 1) * TRAIN_BLOCKS)
            windows.append((x[own], np.array(y[own], np.float32)))
    if windows:
        model.train(*map(list, zip(*windows, strict=True)))
    else:
        model.p["ob"] -= 30
    return model


def _text_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vectors, root, read = shared.value, _Vectors(), Path(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, pages = batch.slice(at, 512), []
                for h in some.column(2).fill_null("").to_pylist():
                    if read > _MEMO_CHARACTERS:  # a path is never longer than what it was read from
                        root, read = Path(), 0
                    read += len(h)
                    pages.append(read_blocks(h, root))
                labels = model.label([vectors.of(b) for b in pages])
                texts = ["\n".join(b.text for b, y in zip(page, label, strict=True) if y) for page, label in zip(pages, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_text_batches(shared), "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit(pages))
