"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds pieces of floor(capacity / k) tokens, and each of its bins takes exactly k of them,
so a worker fills bins by counting, without looking at other workers. Documents may be cut: each
is split greedily into class lengths (1024, 512, 341, 256, ...), which leaves at most k - 1 tokens
of a bin empty. Pieces are numbered within a worker; one small table of counts by (worker, class)
turns that into numbers over all workers, and number divided by k is the bin. What is left over of
each class (less than one bin, so a fixed number of pieces whatever the input) is joined
first-fit-decreasing into common sequences.

Cases: a null or empty text is the single end id; equal doc_ids are packed one by one; an empty
table gives no rows. Ids equal those of the `tokenizers` file of the same vocabulary as it is, its
added tokens (<|endoftext|>) matched inside text included (tested); the rank file is used because its
encoder needs a fifth of the CPU time, and the added tokens are read from the `tokenizers` file. That
encoder gives up on runs of about a million white-space characters: such a text goes through the `tokenizers` file itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm import bpe
from panelspark.llm.hashing import slices
from panelspark.llm.shared import written

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 0

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("worker", pa.int64()), ("nth", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, nth long"


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids. Added tokens are those of the file of the same name in JSON, if there is one."""
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken
    import tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added: dict[str, int] = {}
    if os.path.exists(whole := os.path.splitext(path)[0] + ".json"):
        with open(whole, encoding="utf-8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @lru_cache(maxsize=1)
    def patient():
        if not os.path.exists(whole):
            return bpe.load(path).encode
        tokenizer = tokenizers.Tokenizer.from_file(whole)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(text: str):
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:  # more backtracking than it allows itself
            return patient()(text)

    return encode


def class_lengths(capacity: int) -> np.ndarray:
    """floor(capacity / k) for every k, ascending: about 2 * sqrt(capacity) lengths."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def cuts(n: int, capacity: int, lengths: np.ndarray) -> list[int]:
    """Class lengths that add up to n, largest first."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(int(lengths[np.searchsorted(lengths, n, side="right") - 1]))
        n -= out[-1]
    return out


def _pieces(capacity: int, vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, worker, lengths = encoder(vocabulary), TaskContext.get().partitionId(), class_lengths(capacity)
        counts: dict[int, int] = {}
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                start = 0
                for n in cuts(len(ids), capacity, lengths):
                    nth = counts.get(n, 0)
                    counts[n] = nth + 1
                    rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), worker, nth))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(_PIECES))], schema=_PIECES)

    return run


def leftovers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first piece left over, sequence, offset) of each class; sequences are negative, largest blocks placed first."""
    blocks = sorted(((n % (capacity // length) * length, length, n - n % (capacity // length)) for length, n in counts.items() if n % (capacity // length)), reverse=True)
    room: list[int] = []
    out = []
    for size, length, first in blocks:
        k = next((i for i, left in enumerate(room) if left >= size), len(room))
        if k == len(room):
            room.append(capacity)
        out.append((length, first, -1 - k, capacity - room[k]))
        room[k] -= size
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(capacity, vocabulary, end), _PIECES_DDL), "pieces")
    counts = pieces.groupBy("worker", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("worker").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("worker", "length", F.coalesce("before", F.lit(0)).alias("before"))
    totals = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row a class
    rest = spark.createDataFrame(leftovers(totals, capacity), "length long, first_left long, left_sequence long, left_offset long")
    per_bin = F.expr(f"{capacity} div length")
    n = F.col("before") + F.col("nth")
    left = n >= F.col("first_left")  # null where nothing is left over
    return (
        pieces.join(before, ["worker", "length"])
        .join(F.broadcast(rest), "length", "left")
        .select(
            "doc_id",
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            F.when(left, F.col("left_sequence")).otherwise(F.floor(n / per_bin) * (capacity + 1) + F.col("length")).alias("sequence_id"),
            F.when(left, F.col("left_offset") + (n - F.col("first_left")) * F.col("length")).otherwise(F.pmod(n, per_bin) * F.col("length")).alias("offset"),
        )
    )
