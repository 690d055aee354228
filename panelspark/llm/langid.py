"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. Each language has a probability for every piece, learnt
by expectation-maximisation over its words; a word's probability is the sum over all its
segmentations, by a forward pass, and a text's is the product over its words. Words are runs of
letters, lower-cased, with a mark in front; letters outside the vocabulary have a fixed small
probability. All words of a length go through the passes together, and a word is scored once per
worker however often it occurs.

Cases: ``und`` with score 0 for a null text and for a text without a letter, and where nothing
could be learnt; rows without lang are never learnt from; a null doc_id isn't held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 1e-7
#: Labelled rows learnt from, about so many of each language, and languages at most: the model has a column for each.
ROWS_A_LANGUAGE = 1000
LANGUAGES = 2000
ROUNDS = 3
#: Words whose scores a worker keeps.
CACHE = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def vocabulary(name: str = VOCABULARY) -> list[str]:
    """Lower-case pieces of letters, with or without the mark."""
    import public_tokenizers
    import sentencepiece

    path = name if "/" in name else public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == MARK or (x := p.removeprefix(MARK)).isalpha() and x == x.lower()})


def _hash(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(chars.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):  # of scalars
        for i in range(chars.shape[-1]):
            h = h * _BASE + chars[..., i].astype(np.uint64) + np.uint64(1)
    return h


class Pieces:
    """Finds the pieces at every place of many words."""

    def __init__(self, pieces: list[str]):
        keys = np.array([_hash(np.array([ord(c) for c in p], np.uint64)) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.index = keys[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> np.uint64(44)] = True
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)

    def at(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that starts at each place of each row: its index, or n if none; a length without any is left out, but for 1."""
        out = {}
        width = chars.shape[1]
        h = np.zeros(chars.shape, np.uint64)
        for length in range(1, min(self.longest, width) + 1):
            h = h[:, : width - length + 1] * _BASE + chars[:, length - 1 :].astype(np.uint64) + np.uint64(1)
            found = np.full(h.shape, self.n, np.int64)
            maybe = np.nonzero(self.seen[h >> np.uint64(44)])
            x = h[maybe]
            k = np.minimum(np.searchsorted(self.keys, x), self.n - 1)
            found[maybe] = np.where(self.keys[k] == x, self.index[k], self.n)
            if length == 1 or (found != self.n).any():
                out[length] = found
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, characters with the mark) of words of one length at a time, in bounded runs."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    for lot in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(lot):
            n = int(sizes[lot[0]]) + 1
            step = max(1, 200_000 // n)
            for i in range(0, len(lot), step):
                at = lot[i : i + step]
                joined = "".join(MARK + words[k] for k in at.tolist())
                yield at, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)


#: Places after which sums are brought back to about 1.
RESCALE = 16


def _sums(at: dict[int, np.ndarray], p: np.ndarray, width: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place, row, language): sums over the segmentations of all before a place (or after it, ``backward``), and logs of their scales.

    p: (piece or none, language). A sum is its value times e to its scale.
    """
    rows, langs = at[1].shape[0], p.shape[1]
    sums, scale = np.zeros((width + 1, rows, langs)), np.zeros((width + 1, rows, langs))
    single = p.copy()
    single[-1] = UNKNOWN  # a character outside the vocabulary is a piece of its own
    longest = max(at)
    places = range(width - 1, -1, -1) if backward else range(1, width + 1)
    sums[width if backward else 0] = 1
    for n, j in enumerate(places, 1):
        for length, found in at.items():
            if length <= n:
                start, other = (j, j + length) if backward else (j - length, j - length)
                sums[j] += sums[other] * (single if length == 1 else p)[found[:, start]]
        if n % RESCALE == 0:
            m = sums[j].copy()
            near = slice(j, min(width, j + longest) + 1) if backward else slice(max(0, j - longest), j + 1)
            sums[near] /= m
            scale[near] += np.log(m)
        if n < width:
            scale[j - 1 if backward else j + 1] = scale[j]
    return sums, scale


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    p: np.ndarray  # (piece, language); the last row is 0

    def scorer(self):
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.known = np.zeros((0, len(self.model.langs) + 1))

    def score(self, words: list[str]) -> np.ndarray:
        """(word, language): log probabilities, and in the last column if the word has a letter."""
        out = np.zeros((len(words), len(self.model.langs) + 1))
        for at, chars in by_length(words):
            alpha, scale = _sums(self.pieces.at(chars), self.model.p, chars.shape[1])
            out[at, :-1] = np.log(alpha[-1]) + scale[-1]
        out[:, -1] = [any(map(str.isalpha, w)) for w in words]
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language): log probabilities; which texts have a letter."""
        lots = [words_of(t) for t in texts]
        if len(self.number) > CACHE:
            self._clear()
        new = list({w for lot in lots for w in lot if w not in self.number})
        if new:
            self.known = np.concatenate([self.known, self.score(new)])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        get = self.number.__getitem__
        sums = np.array([self.known[np.fromiter(map(get, lot), np.int64, len(lot))].sum(0) for lot in lots]).reshape(len(lots), -1)
        return sums[:, :-1], sums[:, -1] > 0


def learn(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: of each language, its words and how often they occur."""
    finder = Pieces(pieces)
    langs = sorted(counts)
    p = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        words, times = list(counts[lang]), np.array(list(counts[lang].values()), float)
        lots = [(times[at], chars.shape[1], finder.at(chars)) for at, chars in by_length(words)]
        q = np.zeros(len(pieces) + 1)
        for w, _, at in lots:  # to begin with: how often a piece occurs anywhere
            for found in at.values():
                q += np.bincount(found.ravel(), np.repeat(w, found.shape[1]), len(q))
        for _ in range(rounds):
            q[-1] = 0
            q = (q + 0.1) / (q.sum() + 0.1 * len(pieces))
            q[-1] = 0
            expected = np.zeros(len(q))
            for w, width, at in lots:
                (alpha, up), (beta, down) = (_sums(at, q[:, None], width, backward) for backward in (False, True))
                for length, found in at.items():
                    for j in range(width - length + 1):
                        f = found[:, j]
                        scale = np.exp(up[j, :, 0] + down[j + length, :, 0] - up[width, :, 0]) if width >= RESCALE else 1.0
                        expected += np.bincount(f, w / alpha[width, :, 0] * scale * alpha[j, :, 0] * q[f] * beta[j + length, :, 0], len(q))
            q = expected
        q[-1] = 0
        p[:, k] = (q + 0.1) / (q.sum() + 0.1 * len(pieces))
    p[-1] = 0
    return Model(langs, pieces, p)


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, vocabulary_name: str = VOCABULARY) -> Model:
    """Learns from docs(doc_id, text, lang) that aren't held out, about ``rows_a_language`` of each language, picked by hash of doc_id and text.

    Of a row that is repeated one is learnt from, so a sample's size is bounded however often an id or a text occurs.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()}  # a row a language
    if len(sizes) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    if not sizes:
        return Model([], [], np.zeros((1, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_a_language / n))])
    picked = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    sample = picked.select("lang", "text", "doc_id").dropDuplicates()

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in slices(it):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    table = sample.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, word, n in sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)):
        counts[lang][word] = n
    return learn({k: v for k, v in counts.items() if v}, vocabulary(vocabulary_name))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score (the language's share of the total probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        langs = shared.value.langs
        for whole in slices(it):
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
                if langs:
                    logs, lettered = scorer.texts(batch.column("text").to_pylist())
                    best = logs.argmax(1)
                    share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    for k in np.flatnonzero(lettered).tolist():
                        names[k], scores[k] = langs[best[k]], float(share[k])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
