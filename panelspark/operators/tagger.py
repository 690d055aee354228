"""A linear-chain CRF over the tokens of rows: forward-backward and Viterbi in numpy, fitted on a bounded sample, applied in Arrow batches.

A row is a sequence of tokens, each with a tag. A token's features are hashed (its word, shape, ends, and its neighbours'), so a model is two
small arrays: a weight for each feature and tag, and one for each pair of tags. Sequences of one length go through the
sums together.

Cases: a row without tokens has no tags; features unseen in fitting weigh nothing; an empty sample gives a model of no tags, which tags nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features, those of a token, rows fitted on at most, steps of the fit, its rate and the weight of the squares.
FEATURES, SAMPLE, STEPS, RATE, L2 = 1 << 14, 2000, 60, 0.3, 1e-4


def shape(token: str) -> str:
    """Kinds of characters in runs: Aa for Glucose, 9.9 for 4.2."""
    out = []
    for c in token:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(tokens: list[str]) -> np.ndarray:
    """Numbers of the features of each token: (tokens, features of one)."""
    words = ["<", *(t.lower() for t in tokens), ">"]
    shapes = ["<", *map(shape, tokens), ">"]
    rows = []
    for i in range(1, len(tokens) + 1):
        w = words[i]
        names = ("b", f"w{w}", f"s{shapes[i]}", f"p{w[:2]}", f"e{w[-2:]}", f"-{shapes[i - 1]}", f"+{shapes[i + 1]}", f"-w{words[i - 1]}", f"+w{words[i + 1]}", f"at{min(i, 4)}")
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in names])
    return np.array(rows, np.int64).reshape(len(tokens), len(rows[0]) if rows else 0)


@dataclass
class Model:
    tags: list[str]
    weights: np.ndarray  # (features, tags)
    moves: np.ndarray  # (tags, tags): from, to


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def forward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log sums over all paths up to each place and tag; scores: (sequences, places, tags)."""
    out = np.empty_like(scores)
    out[:, 0] = scores[:, 0]
    for i in range(1, scores.shape[1]):
        out[:, i] = scores[:, i] + _log_sum(out[:, i - 1, :, None] + moves[None], 1)
    return out


def backward(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log sums over all paths after each place and tag."""
    out = np.zeros_like(scores)
    for i in range(scores.shape[1] - 2, -1, -1):
        out[:, i] = _log_sum(moves[None] + (scores[:, i + 1] + out[:, i + 1])[:, None, :], 2)
    return out


def log_likelihood(x: np.ndarray, y: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """Of sequences of one length, features (n, places, k) and tags (n, places): the sum, and its gradients by weights and moves."""
    scores = model.weights[x].sum(2)
    a, b = forward(scores, model.moves), backward(scores, model.moves)
    z = _log_sum(a[:, -1], 1)
    n, places, tags = scores.shape
    at = np.arange(n)[:, None], np.arange(places)[None]
    total = scores[at[0], at[1], y].sum() + model.moves[y[:, :-1], y[:, 1:]].sum() - z.sum()
    left = -np.exp(a + b - z[:, None, None])
    left[at[0], at[1], y] += 1
    by_weight = np.zeros_like(model.weights)
    np.add.at(by_weight, x.reshape(n * places, -1), left.reshape(n * places, 1, tags))
    by_move = np.zeros_like(model.moves)
    np.add.at(by_move, (y[:, :-1], y[:, 1:]), 1)
    for i in range(1, places):
        pair = a[:, i - 1, :, None] + model.moves[None] + (scores[:, i] + b[:, i])[:, None, :] - z[:, None, None]
        by_move -= np.exp(pair).sum(0)
    return float(total), by_weight, by_move


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best path of each sequence; of equal ones the first tag's."""
    n, places, _ = scores.shape
    best, back = scores[:, 0], []
    for i in range(1, places):
        through = best[:, :, None] + moves[None]
        back.append(through.argmax(1))
        best = through.max(1) + scores[:, i]
    path = [best.argmax(1)]
    for step in reversed(back):
        path.append(step[np.arange(n), path[-1]])
    return np.stack(path[::-1], 1)


def _by_length(sequences: list[np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, x in enumerate(sequences):
        if len(x):
            out.setdefault(len(x), []).append(i)
    return out


def fit(sequences: list[tuple[list[str], list[str]]], steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Model:
    """Climbs the mean log likelihood by steps scaled by their past (Adam); always the same for the same sequences."""
    tags = sorted({t for _, ts in sequences for t in ts})
    number = {t: i for i, t in enumerate(tags)}
    model = Model(tags, np.zeros((FEATURES, len(tags))), np.zeros((len(tags), len(tags))))
    xs = [features(tokens) for tokens, _ in sequences]
    ys = [np.array([number[t] for t in ts], np.int64) for _, ts in sequences]
    lots = [(np.stack([xs[i] for i in some]), np.stack([ys[i] for i in some])) for _, some in sorted(_by_length(xs).items())]
    total = max(1, sum(len(x) for x, _ in lots))
    state = [[np.zeros_like(p) for p in (model.weights, model.moves)] for _ in range(2)]
    for step in range(1, steps + 1):
        grads = [-l2 * model.weights, -l2 * model.moves]
        for x, y in lots:
            _, g, m = log_likelihood(x, y, model)
            grads[0] += g / total
            grads[1] += m / total
        for k, p in enumerate((model.weights, model.moves)):
            state[0][k] = 0.9 * state[0][k] + 0.1 * grads[k]
            state[1][k] = 0.99 * state[1][k] + 0.01 * grads[k] ** 2
            p += rate * (state[0][k] / (1 - 0.9**step)) / (np.sqrt(state[1][k] / (1 - 0.99**step)) + 1e-8)
    return model


def best_tags(model: Model, rows: list[list[str]]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in rows]
    if not model.tags:
        return out
    xs = [features(tokens) for tokens in rows]
    for _, some in _by_length(xs).items():
        for lo in range(0, len(some), 512):
            part = some[lo : lo + 512]
            paths = viterbi(model.weights[np.stack([xs[i] for i in part])].sum(2), model.moves)
            for i, path in zip(part, paths.tolist(), strict=True):
                out[i] = [model.tags[t] for t in path]
    return out


def train(tokens: DataFrame, sample: int = SAMPLE) -> Model:
    """tokens(doc_id, row_no, pos, token, tag) -> a model of about ``sample`` rows, picked by a hash of (doc_id, row_no); only these reach the driver."""
    n = tokens.select("doc_id", "row_no").distinct().count()
    picked = tokens.where(F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample / max(n, 1)))))
    rows = picked.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("t")).orderBy("doc_id", "row_no").toPandas()
    return fit([([x["token"] for x in t], [x["tag"] for x in t]) for t in rows["t"]])


def tagged(rows: DataFrame, model: Model) -> DataFrame:
    """rows(doc_id, row_no, text) -> doc_id, row_no, pos, token, tag by the model; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [(x or "").split() for x in batch.column("text").to_pylist()]
            found = best_tags(shared.value, texts)
            docs, nos = batch.column("doc_id").to_pylist(), batch.column("row_no").to_pylist()
            out = [(d, r, i, w, t) for d, r, words, tags in zip(docs, nos, texts, found, strict=True) for i, (w, t) in enumerate(zip(words, tags, strict=False))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "row_no", "pos", "token", "tag"]), schema=_TAGGED, preserve_index=False)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row_no").cast("long").alias("row_no"), "text").mapInArrow(run, "doc_id long, row_no long, pos long, token string, tag string")


_TAGGED = pa.schema([("doc_id", pa.int64()), ("row_no", pa.int64()), ("pos", pa.int64()), ("token", pa.string()), ("tag", pa.string())])
