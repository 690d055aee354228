"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w . x) with ordered thresholds and one weight vector
over hashed features: words (letters and digits, A-Z folded; log counts over the root of the number
of distinct words), shapes of blank-separated tokens (classes of characters, runs collapsed; root of
their share) and how often words repeat. Grades: 0 toxic, 1 poor, 2 good. The model is fitted on
about LABELLED labelled rows, picked by hash of doc_id; everything else covers all rows.

Cases: a null or empty text has no features, so its grade comes from the thresholds alone; ratings
with a null are left out of the fit; without ratings every document is kept (grade 2); equal texts
get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import PLAIN, Words, batches, mix, runs, table

#: Labelled rows fitted on.
LABELLED = 10_000
BITS = 18
GRADES = 3
STEPS = 300
L2 = 1e-4
#: What a rating counts for in the fit, by grade: a toxic text let through is the costliest mistake.
GRADE_WEIGHTS = (2.0, 1.0, 1.0)
#: Features of fewer rated texts get no weight.
LEAST_TEXTS = 8
#: A document is kept if it is at least this likely to be of the best grade.
KEEP = 0.5

_WORDS = table(b"abcdefghijklmnopqrstuvwxyz0123456789", lower=True)


def _classes() -> np.ndarray:
    """Byte classes of a shape: A upper case, a lower case and all outside ASCII, 0 digits; the rest stand for themselves."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91], t[97:123], t[128:], t[48:58] = 65, 97, 97, 48
    return t


_CLASSES = _classes()


def _sparse(hashes: np.ndarray, text: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count) of distinct features."""
    key = (text.astype(np.uint64) << np.uint64(BITS)) | (mix(hashes + np.uint64(salt)) >> np.uint64(64 - BITS))
    keys, counts = np.unique(key, return_counts=True)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), counts


def _owners(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, value) of all texts."""
    rows, cols, values = [], [], []
    for first, words in batches(texts, _WORDS):
        n = len(words.first) - 1
        row, col, count = _sparse(words.hashes, _owners(words), 1)
        different = np.bincount(row, minlength=n)
        rows.append(row + first)
        cols.append(col)
        values.append(np.log1p(count) / np.sqrt(different[row]))
        total = np.diff(words.first)
        some = np.flatnonzero(total)
        repeat = np.floor(np.log2(total[some] / np.maximum(different[some], 1)) * 2).astype(np.uint64)
        rows.append(some + first)
        cols.append((mix(repeat + np.uint64(7919)) >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(np.full(len(some), 0.5))
    for first, words in batches(texts, PLAIN):
        raw = _CLASSES[np.frombuffer(words.data, np.uint8)]
        keep = np.ones(len(raw), bool)
        keep[1:] = raw[1:] != raw[:-1]
        starts = np.concatenate([words.starts[words.first[:-1].clip(max=max(len(words.starts) - 1, 0))], [len(raw)]]) if len(words.starts) else np.zeros(len(words.first), np.int64)
        keep[starts[starts < len(raw)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        shapes = Words(raw[keep].tobytes(), at[np.minimum(starts, len(raw))])
        row, col, count = _sparse(shapes.hashes, _owners(shapes), 2)
        total = np.bincount(row, count, minlength=len(words.first) - 1)
        rows.append(row + first)
        cols.append(col)
        values.append(np.sqrt(count / total[row]))
    empty = np.zeros(0)
    return np.concatenate([empty.astype(np.int64), *rows]), np.concatenate([empty.astype(np.int64), *cols]), np.concatenate([empty, *values])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in runs(texts):
            row, col, value = features(texts.slice(lo, hi - lo))
            out[lo:hi] = np.bincount(row, self.weights[col] * value, minlength=hi - lo)
        return out

    def tails(self, texts: pa.Array) -> np.ndarray:
        """(text, k): probability of a grade over k, for every grade but the last."""
        return _sigmoid(self.scores(texts)[:, None] - self.thresholds[None])


def fit(found: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, n_grades: int = GRADES, steps: int = STEPS, l2: float = L2, least_texts: int = LEAST_TEXTS, grade_weights: tuple[float, ...] = GRADE_WEIGHTS, rate: float = 0.1) -> Model:
    """Full-batch Adam on the penalised likelihood of the grades of texts with the features (text, column, value)."""
    row, col, value = found
    used, col, texts_with = np.unique(col, return_inverse=True, return_counts=True)
    common = texts_with[col] >= least_texts
    row, col, value = row[common], col[common], value[common]
    n, d = len(grades), len(used)
    w = np.zeros(d)
    share = np.clip(np.array([(grades <= k).mean() for k in range(n_grades - 1)]), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])  # the first threshold, and logs of the gaps
    m, v = np.zeros(d + len(free)), np.zeros(d + len(free))
    at = np.arange(n)
    part = np.array(grade_weights)[grades]
    part /= part.sum()
    for step in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        s = np.bincount(row, w[col] * value, minlength=n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None] - s[:, None]), np.ones((n, 1))], 1)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        slope = below * (1 - below)
        d_score = (slope[at, grades + 1] - slope[at, grades]) / p * part  # of minus the log likelihood
        d_theta = np.zeros(n_grades + 1)
        np.add.at(d_theta, grades + 1, -slope[at, grades + 1] / p * part)
        np.add.at(d_theta, grades, slope[at, grades] / p * part)
        d_theta = d_theta[1:-1]
        d_free = np.concatenate([[d_theta.sum()], np.exp(free[1:]) * np.cumsum(d_theta[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(col, d_score[row] * value, minlength=d) + l2 * w, d_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:d]
        free -= move[d:]
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights.astype(np.float32), np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> doc_id, grade; of repeated ratings the lowest counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, grade, text -> doc_id, grade, and the text's features as two byte strings."""
    for batch in it:
        texts = batch.column("text")
        cols, values = [], []
        for lo, hi in runs(texts):
            row, col, value = features(texts.slice(lo, hi - lo))
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, hi - lo))
            cols += [x.tobytes() for x in np.split(col[order].astype(np.int32), cuts)]
            values += [x.tobytes() for x in np.split(value[order].astype(np.float32), cuts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "grade", "cols", "values"])


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> Model | None:
    """Fits on about ``rows`` of the rated documents, one text of each doc_id; only the features of that sample reach the driver."""
    rated = graded(labels)
    n = rated.count()
    if not n:
        return None
    share = min(1.0, rows / n)
    sample = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    one = some.mapInArrow(_featured, "doc_id long, grade int, cols binary, values binary").groupBy("doc_id").agg(F.min(F.struct("cols", "values", "grade")).alias("x"))
    table = one.select("doc_id", "x.*").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    cols = [np.frombuffer(x.as_py(), np.int32) for x in table.column("cols")]
    row = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    value = np.frombuffer(b"".join(x.as_py() for x in table.column("values")), np.float32)
    return fit((row, np.concatenate(cols).astype(np.int64), value.astype(float)), table.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Adds expected_grade, p_fair (grade 1 or better), p_good (grade 2) and keep to docs(text, ...), in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p_fair:double,p_good:double>")
    def tails(text: pa.Array) -> pa.Array:
        found = np.ones((len(text), GRADES - 1)) if shared.value is None else shared.value.tails(text)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["p_fair", "p_good"])

    added = ("expected_grade", "p_fair", "p_good", "keep")
    name = "tails"
    while name in docs.columns:
        name += "_"
    out = docs.drop(*added).withColumn(name, tails("text"))
    fair, good = (F.col(name)[x] for x in ("p_fair", "p_good"))
    return out.select(*[c for c in docs.columns if c not in added], (fair + good).alias("expected_grade"), fair.alias("p_fair"), good.alias("p_good"), (good >= keep).alias("keep"))
