"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the runs of text between block-level tags. Each block is a vector of its hashed
tag path (with the words of class, id and role), its hashed words, and a few numbers. A bidirectional
LSTM in numpy reads the whole sequence in both directions and labels every block as article or not. Scripts,
styles, comments and markup are never blocks.

The labeller is trained here, on at most ``SAMPLE_PAGES`` pages that are chosen by a hash of their id. Their labels come
from structure: text below ``article`` or ``main`` is article, text below ``nav``, ``footer``, ``aside``,
``form`` or an element whose class says so is not; the rest is left unlabelled. Each sampled page also
lends its words to pages of other layouts, so that the labeller has seen boxes that the sample lacks.

Defined cases: a null or empty page, or one without article, has the empty text; repeated rows are extracted each;
unclosed tags, a cut-off last tag and cut-off references are tolerated: only script, style and textarea reach to the end of
the page, ``head`` ends where the body begins; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 256
#: Longer pages are not trained on; all pages are labelled whole.
SAMPLE_CHARS = 100_000
HIDDEN = 24
EPOCHS = 8
PATH_DIM, WORD_DIM, NUMBERS = 48, 24, 7
DIM = PATH_DIM + WORD_DIM + NUMBERS

# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; without an end tag they reach to the end of the page.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
#: Elements that are never text if they have an end tag.
HIDDEN_TAGS = frozenset("noscript template svg iframe object select button".split())
#: Elements that leave ``head`` open; any other one ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
# Words in class, id and role of boxes that are not article, and of boxes that are.
BOX_WORDS = frozenset("ad ads advert advertisement adbox sponsor sponsored promo promoted banner nav navbar navigation menu "
                      "breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar aside rail widget "
                      "related recommended share sharing social follow comment comments respond reply replies disqus "
                      "discussion notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup "
                      "login form search tags pagination pager toolbar legal disclaimer skip".split())
TEXT_WORDS = frozenset("article content entry post story body text main maincontent articlebody".split())
BOX_TAGS = frozenset("nav footer aside form dialog menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""", re.S)
MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _mark_words(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    words = " ".join(next(filter(None, m), "") for m in MARKS.findall(attributes)).lower()
    return "." + ".".join(re.split(r"[\s_-]+", words)) if words.strip() else ""


def _tags(html: str) -> list[tuple[int, int, str | None, bool, str | None]]:
    """(start, end, tag, closing, attributes) of all markup; no tag for comments and raw elements, which are whole.

    The attributes are None where they are broken.
    """
    found, at, foreign = [], 0, 0
    while m := TOKEN.search(html, at):
        start, at = m.span()
        tag, closing, attributes = m[2] or m[5], bool(m[1] or m[4]), m[3]
        tag = tag and tag.lower()
        empty = attributes is not None and attributes.endswith("/")
        if tag in ("svg", "math") and not empty:
            foreign = max(0, foreign - 1) if closing else foreign + 1
        elif tag in RAW and not closing and not (foreign and empty):
            end = RAW[tag].search(html, at)
            if end or tag != "title":
                tag, at = None, end.end() if end else len(html)
        found.append((start, at, tag, closing, attributes))
    return found


def _hidden(tags: list) -> dict[int, int]:
    """For each hidden element with an end tag, the places of both in ``tags``; a self-closed svg is its own end."""
    pairs, waiting = {}, {tag: [] for tag in HIDDEN_TAGS}
    for k, (_, _, tag, closing, attributes) in enumerate(tags):
        if tag in waiting:
            if closing:
                if waiting[tag]:
                    pairs[waiting[tag].pop()] = k
            elif tag == "svg" and attributes is not None and attributes.endswith("/"):
                pairs[k] = k
            else:
                waiting[tag].append(k)
    return pairs


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, with decoded text."""
    found, path, names, parts, linked, at = [], [], [], [], 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(tuple(path), text, linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if "a" in names[-3:]:
                linked += len(text)

    tags = _tags(html)
    hidden, shown, in_head, before = _hidden(tags), 0, False, None
    for k, (start, end, tag, closing, attributes) in enumerate(tags):
        if k < shown:
            continue
        text, at = html[at:start], end
        if in_head and before != "title" and text.strip():
            in_head = False
        if not in_head:
            add(text)
        before = tag
        if k in hidden:
            if in_head and tag not in HEAD_TAGS:
                in_head = False
            shown, at = hidden[k] + 1, tags[hidden[k]][1]
            continue
        if tag == "head":
            in_head = not closing
            continue
        if in_head and tag and not closing:
            in_head = tag in HEAD_TAGS
        if in_head or tag is None or attributes is None:
            continue
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag in names:
                keep = len(names) - 1 - names[::-1].index(tag)
                del path[keep:], names[keep:]
            continue
        if tag in CLOSES_P and "p" in names:
            keep = names.index("p")
            del path[keep:], names[keep:]
        elif tag in ("li", "td", "tr", "dt", "dd", "option") and names[-1:] == [tag]:
            path.pop()
            names.pop()
        if tag not in VOID and not attributes.endswith("/"):
            path.append(tag + _mark_words(attributes))
            names.append(tag)
    if not in_head or before != "title":
        add(html[at:])
    close()
    return found


def seed_label(path: tuple[str, ...]) -> int:
    """1 for article, 0 for a box, -1 where structure says neither; the innermost word decides."""
    inside = -1
    for step in path:
        tag, *words = step.split(".")
        if tag in BOX_TAGS or (tag == "header" and inside != 1) or BOX_WORDS.intersection(words):
            return 0
        if tag in ("article", "main") or TEXT_WORDS.intersection(words):
            inside = 1
    return inside


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    vector = np.zeros(PATH_DIM, np.float32)
    for depth, step in enumerate(reversed(path)):
        for word in step.split("."):
            h = zlib.crc32(word.encode())
            vector[h % PATH_DIM] += (1.0 if h & 0x10000 else -1.0) / (1 + 0.15 * depth)
            if depth == 0 or word in BOX_WORDS:
                h = zlib.crc32(b"box " + word.encode() if word in BOX_WORDS else b"leaf " + word.encode())
                vector[h % PATH_DIM] += 1.0 if h & 0x10000 else -1.0
    return vector


def features(page: list[Block]) -> np.ndarray:
    """A row for each block, from whole texts."""
    texts = [b.text for b in page]
    words = [t.lower().encode().split() for t in texts]
    n_words = np.array(list(map(len, words)), np.int64)
    n_chars = np.array(list(map(len, texts)), np.float64)
    hashed = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32, int(n_words.sum()))
    spot = np.repeat(np.arange(len(page)) * WORD_DIM, n_words) + hashed % WORD_DIM
    rows = np.zeros((len(page), DIM), np.float32)
    rows[:, :PATH_DIM] = [_path_vector(b.path) for b in page]
    rows[:, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(spot, minlength=len(page) * WORD_DIM).reshape(
        -1, WORD_DIM) / np.sqrt(np.maximum(n_words, 1))[:, None]
    place = np.arange(len(page))
    points = np.array([t.count(".") + t.count(",") for t in texts])
    rows[:, -NUMBERS:] = np.stack([
        np.log1p(n_chars) / 5, np.log1p(n_words) / 4, np.array([b.linked for b in page]) / n_chars,
        points / (1 + n_words), place / len(page), 1 / (1 + place), [t[-1] in ".!?" for t in texts]], axis=1)
    return rows


class Labeller:
    """Bidirectional LSTM with one output for each block; plain numpy, for padded batches in time order."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {}
        for side in ("f", "b"):
            self.weights[f"w{side}"] = rng.normal(0, 0.15, (DIM + hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1.0
            self.weights[f"c{side}"] = bias
        self.weights["out"] = rng.normal(0, 0.15, 2 * hidden + DIM).astype(np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, real: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        cell, out = np.zeros_like(h), np.zeros((*x.shape[:2], n), np.float32)
        w, c = self.weights[f"w{side}"], self.weights[f"c{side}"]
        given = x.reshape(-1, DIM) @ w[:DIM] + c
        given = given.reshape(*x.shape[:2], 4 * n)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ w[DIM:]
            gates = 1 / (1 + np.exp(-z[:, :3 * n]))
            i, f, o, g = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], np.tanh(z[:, 3 * n:])
            on = real[t][:, None]
            new = (f * cell + i * g) * on
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, h, cell, i, f, o, g, squashed, on))
            cell, h = new, o * squashed * on
            out[t] = h
        return out

    def scores(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, real, "f", None), self._run(x, real, "b", None), x], axis=2)
        return both @ self.weights["out"] + self.weights["bias"]

    def gradients(self, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, real, s, kept[s]) for s in "fb"] + [x], axis=2)
        known = (label >= 0) & (real > 0)
        p = 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"])))
        error = np.where(known, p - label, 0).astype(np.float32) / max(1, known.sum())
        grads = {"out": np.einsum("tb,tbk->k", error, both), "bias": error.sum(keepdims=True).reshape(1)}
        n = self.hidden
        for k, side in enumerate("fb"):
            w = self.weights[f"w{side}"]
            dw, dc = np.zeros_like(w), np.zeros(4 * n, np.float32)
            into = error[:, :, None] * self.weights["out"][k * n:(k + 1) * n]
            dh, dcell = np.zeros_like(into[0]), np.zeros_like(into[0])
            for t, h, cell, i, f, o, g, squashed, on in reversed(kept[side]):
                dh = (dh + into[t]) * on
                dcell = (dcell + dh * o * (1 - squashed ** 2)) * on
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f),
                                     dh * squashed * o * (1 - o), dcell * i * (1 - g ** 2)], axis=1)
                dw[:DIM] += x[t].T @ dz
                dw[DIM:] += h.T @ dz
                dc += dz.sum(axis=0)
                dh, dcell = dz @ w[DIM:].T, dcell * f
            grads[f"w{side}"], grads[f"c{side}"] = dw, dc
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 24,
            rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over shuffled batches of pages."""
        rng = random.Random(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        pages, step = sorted(pages, key=lambda p: len(p[0])), 0
        groups = [pages[k:k + batch] for k in range(0, len(pages), batch)]
        for _ in range(epochs):
            rng.shuffle(groups)
            for group in groups:
                x, real = padded([p[0] for p in group])
                label = np.full(real.shape, -1.0, np.float32)
                for k, (_, own) in enumerate(group):
                    label[:len(own), k] = own
                step += 1
                for name, g in self.gradients(x, real, label).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.weights[name] -= (rate * first[name] / (1 - 0.9 ** step) / (
                        np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, rows)), len(rows), DIM), np.float32)
    real = np.zeros(x.shape[:2], np.float32)
    for k, own in enumerate(rows):
        x[:len(own), k] = own
        real[:len(own), k] = 1
    return x, real


def other_layout(page: list[Block], rng: random.Random) -> list[tuple[Block, int]]:
    """The words of a page in boxes of another layout, with the label of each block."""
    words = [w for b in page for w in b.text.split()] or ["-"]

    def some(low: int, high: int) -> str:
        start = rng.randrange(len(words))
        return " ".join((words[start:] + words)[:rng.randint(low, high)])

    def shown(path: tuple[str, ...], text: str) -> Block:
        return Block(path, text, len(text) if path[-1] == "a" else 0)

    def box(outer: tuple[str, ...]) -> list[tuple[Block, int]]:
        word = rng.choice(sorted(BOX_WORDS))
        more = rng.choice(["", ".box", ".block", ".inner", ".list"])
        outer += (rng.choice(["div", "section", "ul", "aside", "p", "div", "div"]) + f".{word}{more}",) if (
            rng.random() < 0.7) else (rng.choice(sorted(BOX_TAGS | {"header", "aside", "nav", "footer"})),)
        inner = rng.choice([(), (), ("p",), ("ul", "li"), ("ul", "li", "a"), ("div",), ("h3",), ("div", "p")])
        return [(shown(outer + inner, some(*rng.choice([(1, 3), (3, 12), (10, 60)]))), 0)
                for _ in range(rng.randint(1, 6))]

    body = ("html", "body") + (() if rng.random() < 0.6 else ("div.page",))
    holder = rng.choice([("article",), ("main",), ("main", "article"), ("div.content",), ("div.post.body",),
                         ("div.entry.content",), ("div.main", "article"), ("section.article",), ("article.post",),
                         ("main", "div.story.text")])
    out = []
    for _ in range(rng.randint(0, 3)):
        out += box(body)
    for k in range(rng.randint(1, 12)):
        inner = ("h1",) if k == 0 and rng.random() < 0.8 else rng.choice(
            [("p",), ("p",), ("p",), ("p", "b"), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div",)])
        out.append((shown(body + holder + inner, some(*rng.choice([(1, 8), (8, 40), (30, 120)]))), 1))
        if rng.random() < 0.3:
            out += box(body + holder)
    if rng.random() < 0.4:
        out += [(shown(body + rng.choice([holder, ()]) + (rng.choice(["section", "div"]) + rng.choice(
            [".comments", ".comment.list", ".respond"]), rng.choice(["div.comment", "p", "li.comment", "h2", "h3"])),
            some(*rng.choice([(1, 3), (3, 60)]))), 0) for _ in range(rng.randint(1, 5))]
    for _ in range(rng.randint(0, 3)):
        out += box(body)
    return out


def train(pages: list[str], seed: int = 5, layouts: int = 3) -> Labeller:
    """A labeller for pages like these, and for other layouts of their words."""
    rng, examples = random.Random(seed), []
    for html in pages:
        page = blocks(html)
        if not page:
            continue
        examples.append((features(page), np.array([seed_label(b.path) for b in page], np.float32)))
        for _ in range(layouts):
            made = other_layout(page, rng)
            examples.append((features([b for b, _ in made]), np.array([y for _, y in made], np.float32)))
    return Labeller(seed).fit(examples) if examples else Labeller(seed)


def label(labeller: Labeller, pages: list[list[Block]], group: int = 128) -> list[np.ndarray]:
    """Whether each block of each page is article; pages of like length go through together."""
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    out = [np.zeros(0, bool)] * len(pages)
    while order:
        some = order[:group if len(pages[order[min(group, len(order)) - 1]]) < 500 else 4]
        order = order[len(some):]
        x, real = padded([features(pages[k]) for k in some])
        scores = labeller.scores(x, real)
        for column, k in enumerate(some):
            out[k] = scores[:len(pages[k]), column] > 0
    return out


def train_on(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, seed: int = 5) -> Labeller:
    """Train on the sampled pages, which come to the driver."""
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()
    ids = [r.page_id for r in chosen if r.page_id is not None]
    sample = pages.where(F.col("page_id").isin(ids) & (F.length("html") <= SAMPLE_CHARS)).select(
        "page_id", "html").orderBy("page_id", "html").limit(sample_pages).collect() if ids else []
    return train([r.html for r in sample], seed)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    labeller = labeller or train_on(pages)

    def run(batches):
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            read = [blocks(h or "") for h in batch.column("html").to_pylist()]
            texts = ["\n".join(b.text for b, keep in zip(page, kept) if keep)
                     for page, kept in zip(read, label(labeller, read))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
