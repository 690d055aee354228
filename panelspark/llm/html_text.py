"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags). Each leaf has its tag path
(names, class, id and role words of its ancestors), its words, hashed, and a few sizes; a
bidirectional LSTM in numpy reads a page's leaves in order and says of each, in the light of the
whole page, whether it is part of the article. It is trained on pages composed by rule from the
kinds of parts that pages have, with and without telling tags, so nothing of the input is learnt from.

Cases: null, empty or text-free html gives an empty text; unclosed, stray and upper-case tags are
read as browsers do, roughly, and what they never end goes to the end of the page; character references
are decoded once, with or without semicolon; white space of any kind inside a block becomes one space.
No text is cut, whatever a page's length; a path is of the innermost 32 elements. Reading a page takes
time in proportion to its length, however deep or broken it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import FOLDED, batches, slices
from panelspark.llm.html_pages import MARK, composed

PATH_BUCKETS, WORD_BUCKETS = 1024, 2048
PATH_SIZE, WORD_SIZE, HIDDEN = 12, 8, 16
SIZES = 6
#: Elements of a path, and names of an element, that the labeller sees.
DEPTH, NAMES = 32, 64
PAGES, STEPS, BATCH, SEED = 3000, 540, 50, 7

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
_SILENT = frozenset("script style noscript template textarea iframe svg object canvas title".split())
#: A comment, a tag or a declaration, as browsers cut them: a quote counts after = only, and what never ends goes to the page's
#: end. Possessive throughout, so that a page is read once whatever is wrong with it.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)>?|<[!?/][^>]*+>?",
    re.S,
)
_SHUT = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in _SILENT}
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def leaves(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text in links) of each block with text. The path is of the innermost DEPTH elements."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: dict[str, int] = {}
    out: list[tuple[tuple[str, ...], str, float]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((tuple(x for _, names in stack[-DEPTH:] for x in names), text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    def shut() -> str:
        name, _ = stack.pop()
        open_[name] -= 1
        return name

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _SILENT:
            if not m[1] and not (name == "svg" and m[3].endswith("/")):
                end = _SHUT[name].search(page, at)
                at = end.end() if end else len(page)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if m[1] else 1
        elif name in _BLOCK:
            flush()
            in_link = 0 if name in ("p", "li", "div", "td") else in_link
            if m[1]:
                while open_.get(name) and shut() != name:
                    pass
            else:
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):
                    shut()
                if name not in _VOID:
                    words = [name]
                    for found in _ATTR.finditer(m[3]):
                        words += ["." + x.lower() for v in found.groups() if v for x in _PART.findall(_CAMEL.sub(" ", v))][: NAMES - len(words)]
                    stack.append((name, tuple(words)))
                    open_[name] = open_.get(name, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _bucket(token: str, n: int) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8", "replace"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h >> 17) % n


_path_buckets: dict[str, int] = {}


def _path_bucket(token: str) -> int:
    if token not in _path_buckets:
        if len(_path_buckets) > 100_000:
            _path_buckets.clear()
        _path_buckets[token] = _bucket(token, PATH_BUCKETS)
    return _path_buckets[token]


@dataclass
class Leaves:
    """Features of the leaves of many pages, one after the other."""

    path: np.ndarray
    path_start: np.ndarray
    word: np.ndarray
    word_start: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(pages: list[list[tuple[tuple[str, ...], str, float]]]) -> Leaves:
        every = [x for page in pages for x in page]
        path = np.array([_path_bucket(t) for p, _, _ in every for t in p], np.int64)
        path_start = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in every])]).astype(np.int64)
        words, starts = [], [0]
        for _, w in batches(pa.array([t for _, t, _ in every], pa.large_string()), FOLDED):
            words.append((w.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64))
            starts += (w.first[1:] + starts[-1]).tolist() if not len(starts) - 1 else (w.first[1:] - w.first[0] + starts[-1]).tolist()
        text = [t for _, t, _ in every]
        n = np.array([len(t) for t in text], float)
        place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages if p] or [np.zeros(0)])
        ends = np.array([t[-1] in ".!?:;…\"”»)" for t in text], float)
        stops = np.array([t.count(".") + t.count(",") for t in text], float)
        sizes = np.stack([np.log1p(n) / 5, np.array([s for _, _, s in every], float), place, ends, np.minimum(stops / np.maximum(n, 1) * 20, 2), np.ones(len(every))], 1) if every else np.zeros((0, SIZES))
        return Leaves(path, path_start, np.concatenate([np.zeros(0, np.int64), *words]), np.array(starts, np.int64), sizes)

    def __len__(self) -> int:
        return len(self.sizes)


def _means(table: np.ndarray, index: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mean rows of a table by runs of indices; an empty run is 0."""
    out = np.zeros((len(start) - 1, table.shape[1]))
    n = np.diff(start)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(table[index], start[some], 0) / n[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """x (time, page, feature) -> hidden (time, page, HIDDEN); past a page's end the state stays."""
    time, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out, steps = np.zeros((time, pages, HIDDEN)), []
    given = x @ w[HIDDEN:]
    for t in range(time):
        z = given[t] + h @ w[:HIDDEN]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            steps.append((h, c, i, f, o, g, tanh))
        m = mask[t][:, None]
        c = np.where(m, new, c)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out, steps


def _lstm_back(x: np.ndarray, w: np.ndarray, mask: np.ndarray, steps: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    time, pages, _ = x.shape
    dw, dz_all = np.zeros_like(w), np.zeros((time, pages, 4 * HIDDEN))
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(time - 1, -1, -1):
        h, c, i, f, o, g, tanh = steps[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        live = np.where(m, dh, 0)
        dnew = np.where(m, dc, 0) + live * o * (1 - tanh**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g**2)], 1)
        dz_all[t] = dz
        dw[:HIDDEN] += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ w[:HIDDEN].T
        dc = np.where(m, dnew * f, dc)
    dw[HIDDEN:] = np.tensordot(x, dz_all, ([0, 1], [0, 1]))
    return dw, dz_all @ w[HIDDEN:].T


class Labeller:
    """Embeddings, two LSTMs and a logistic output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + SIZES
        self.p = {
            "path": r.normal(0, 0.3, (PATH_BUCKETS, PATH_SIZE)),
            "word": r.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)),
            "ahead": r.normal(0, 0.25, (HIDDEN + size, 4 * HIDDEN)),
            "back": r.normal(0, 0.25, (HIDDEN + size, 4 * HIDDEN)),
            "out": r.normal(0, 0.3, (2 * HIDDEN + size, 1)),
        }

    def _padded(self, rows: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(time, page, feature) and which places are leaves."""
        time = max(counts)
        mask = np.arange(time)[:, None] < np.array(counts)[None]
        x = np.zeros((time, len(counts), rows.shape[1]))
        x.transpose(1, 0, 2)[mask.T] = rows
        return x, mask

    def forward(self, some: Leaves, counts: list[int], keep: bool = False):
        rows = np.concatenate([_means(self.p["path"], some.path, some.path_start) * 2, _means(self.p["word"], some.word, some.word_start), some.sizes], 1)
        x, mask = self._padded(rows, counts)
        # backwards, a page's padding comes first and leaves the state at its start
        ahead, steps = _lstm(x, self.p["ahead"], mask, keep)
        back, back_steps = _lstm(x[::-1], self.p["back"], mask[::-1], keep)
        full = np.concatenate([ahead, back[::-1], x], 2)
        p = _sigmoid(full @ self.p["out"])[..., 0]
        return p, (x, mask, steps, back_steps, full)

    def gradients(self, some: Leaves, counts: list[int], y: np.ndarray) -> tuple[dict, float]:
        p, (x, mask, steps, back_steps, full) = self.forward(some, counts, True)
        target, _ = self._padded(y[:, None], counts)
        d = np.where(mask, p - target[..., 0], 0)[..., None] / mask.sum()
        loss = -np.log(np.maximum(np.where(target[..., 0] > 0, p, 1 - p)[mask], 1e-9)).mean()
        g = {"out": np.tensordot(full, d, ([0, 1], [0, 1]))}
        d_full = d @ self.p["out"].T
        g["ahead"], dx = _lstm_back(x, self.p["ahead"], mask, steps, d_full[..., :HIDDEN])
        g["back"], dx_back = _lstm_back(x[::-1], self.p["back"], mask[::-1], back_steps, d_full[::-1, :, HIDDEN : 2 * HIDDEN])
        rows = (dx + dx_back[::-1] + d_full[..., 2 * HIDDEN :]).transpose(1, 0, 2)[mask.T]
        for name, index, start, lo, size, scale in (("path", some.path, some.path_start, 0, PATH_SIZE, 2), ("word", some.word, some.word_start, PATH_SIZE, WORD_SIZE, 1)):
            n = np.diff(start)
            each = np.repeat(rows[:, lo : lo + size] * scale / np.maximum(n, 1)[:, None], n, 0)
            g[name] = np.stack([np.bincount(index, each[:, c], len(self.p[name])) for c in range(size)], 1)
        return g, loss

    def is_article(self, pages: list[list]) -> list[np.ndarray]:
        """Of each page, which leaves are article; pages of like lengths go through together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        lot: list[int] = []
        for k, i in enumerate(order):
            lot.append(i)
            last = k == len(order) - 1
            if last or len(lot) == 64 or len(lot) * len(pages[order[k + 1]]) > 6000:
                p, _ = self.forward(Leaves.of([pages[j] for j in lot]), [len(pages[j]) for j in lot])
                for column, j in enumerate(lot):
                    out[j] = p[: len(pages[j]), column] >= 0.5
                lot = []
        return out


def train(pages: int = PAGES, steps: int = STEPS, seed: int = SEED, rate: float = 0.01) -> Labeller:
    """Adam on composed pages; the same weights every time."""
    r = Random(seed)
    lots = []
    for _ in range(pages // BATCH):
        some = [x for x in (labelled(composed(r)) for _ in range(BATCH)) if x[0]]
        lots.append((Leaves.of([x[0] for x in some]), [len(x[0]) for x in some], np.concatenate([x[1] for x in some])))
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        lot = lots[step % len(lots)]
        g, _ = model.gradients(*lot)
        now = rate * (1 - 0.95 * step / steps)
        for k in g:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            model.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def labelled(page: str) -> tuple[list, np.ndarray]:
    """Leaves of a composed page, and which are article."""
    found = leaves(page)
    return [(p, t.replace(MARK, "").strip(), s) for p, t, s in found if t != MARK], np.array([MARK in t for _, t, _ in found if t != MARK], float)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, steps: int = STEPS, seed: int = SEED) -> Labeller:
    return train(pages, steps, seed)


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [leaves(p or "") for p in pages]
    return ["\n\n".join(t for (_, t, _), keep in zip(page, kept.tolist(), strict=True) if keep) for page, kept in zip(found, model.is_article(found), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(it, column="html"):
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = main_texts(shared.value, batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
