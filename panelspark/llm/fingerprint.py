"""Threshold-scaled document sketches.

A document's fingerprint is every hash of its five-word shingles below a fixed fraction of the hash
space, or the least hash alone where none is below it, so its size follows the document's and fingerprints of any two documents estimate Jaccard
likeness and containment; the fingerprint of a union is the union of fingerprints. Words are runs
of anything but ASCII white space, A-Z folded; a text of fewer than five words is one shingle.

Cases: a null text is empty; only a text without words has an empty sketch: two empty sketches are
alike (1), an empty and another one aren't (0). Two texts without a hash under the threshold are
compared by their least hashes, which are equal with the probability of their likeness. Documents are ordered by
doc_id, null ids first, those of one id by the crc32 of their text, then by the text; repeated rows follow each other, in one
group, as nothing tells them apart; of one row, it is its own next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import blocks
from panelspark.llm.hashing import FOLDED, batches, distinct, shingles, slices
from panelspark.llm.shared import buckets

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
#: Hexadecimal digits of a kept hash: its first 40 bits.
DIGITS = 10


def sketches(texts: pa.Array, k: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Of each text the kept hashes, ascending; at least one if it has words."""
    most = np.uint64((1 << 64) // scale - 1)
    out: list[np.ndarray] = []
    for _, words in batches(texts, FOLDED):
        h, of = shingles(words, k)
        least = np.full(len(words.first) - 1, np.iinfo(np.uint64).max)
        np.minimum.at(least, of, h)
        keep = h <= np.maximum(least, most)[of]
        h, of = distinct(h[keep] >> np.uint64(64 - 4 * DIGITS), of[keep])
        out += np.split(h, np.searchsorted(of, np.arange(1, len(words.first) - 1)))
    return out


def as_text(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").tobytes().hex()
    return "".join(raw[i + 16 - DIGITS : i + 16] for i in range(0, len(raw), 16))


def from_text(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], np.uint64)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two sets of shingles."""
    both = np.union1d(a, b)
    keep = both <= np.uint64((1 << 64) // scale - 1) >> np.uint64(64 - 4 * DIGITS)
    keep[:1] = True
    return both[keep]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has, however much longer b is."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprint(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds ``fingerprint`` to docs(text, ...); no shuffle."""

    @F.pandas_udf("string")
    def of(text: pd.Series) -> pd.Series:
        found = sketches(pa.array(text, pa.large_string(), from_pandas=True), k, scale)
        return pd.Series([as_text(x) for x in found])

    return docs.withColumn("fingerprint", of("text"))


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def place(texts: list[bytes]) -> np.ndarray:
    """Where texts of one doc_id stand among each other: 32 bits, evenly spread."""
    return np.fromiter(map(zlib.crc32, texts), np.int64, len(texts))


def _ranges(bounds: np.ndarray):
    """Range of rows by their ids and places: an id that several bounds fall on is spread over as many ranges, by place; a null id is the least integer."""

    def of(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        first = np.searchsorted(bounds, ids, side="left")
        share = np.searchsorted(bounds, ids, side="right") - first
        return (first + np.where(share > 1, places * share >> 32, 0)).astype(np.int32)

    return of


def _bounds(docs: DataFrame, n: int) -> np.ndarray:
    """Ids that cut the documents into about n ranges of equal counts; an id of many documents is there as often as it has ranges."""
    total, known = docs.agg(F.count("*"), F.count("doc_id")).head()
    missing = n * (total - known) // max(total, 1)
    rest = n - missing
    q = docs.agg(F.percentile_approx("doc_id", [i / rest for i in range(1, rest)], max(10_000, 20 * n))).head()[0] if rest > 1 else None
    return np.array([blocks.NO_ID] * missing + list(q or []), np.int64)


def edited_pairs(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and how alike they are.

    Documents are dealt by ranges of doc_id of about equal counts, an id of very many documents (a null one, say) over
    several; so a document's next one is in its own group, or is the least of the following range, which is sent to both.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    range_of = _ranges(_bounds(docs, buckets(docs, 4)))

    def firsts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids, places = blocks.ids_of(batch.column("doc_id")), place(blocks.raw_texts(batch.column("text")))
            r = range_of(ids, places)
            order = np.lexsort((places, ids, r))
            head = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(r[head], pa.int32()), pa.array(ids[head], pa.int64()), pa.array(places[head], pa.int64())], names=["r", "id", "place"])

    found = docs.mapInArrow(firsts, "r int, id long, place long").groupBy("r").agg(F.min(F.struct("id", "place")).alias("first"))
    least = sorted((x.r, tuple(x.first)) for x in found.collect())  # a row a range
    guests = {r: least[i - 1][0] for i, (r, _) in enumerate(least)}
    heads = dict(least)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids, texts = blocks.ids_of(batch.column("doc_id")), blocks.raw_texts(batch.column("text"))
            places = place(texts)
            r = range_of(ids, places)
            yield blocks.send_texts(r, ids, texts)
            first: dict[int, int] = {}
            for i in np.flatnonzero(np.isin(ids, [x for x, _ in heads.values()])).tolist():
                if heads[int(r[i])] == (ids[i], places[i]) and texts[i] <= texts[first.setdefault(int(r[i]), i)]:
                    first[int(r[i])] = i
            if first:
                at = list(first.values())
                yield blocks.send_texts(np.array([-1 - guests[x] for x in first], np.int32), ids[at], [texts[i] for i in at])

    def pairs(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("bucket")) >= 0
        ids, texts = blocks.received_texts(table.filter(pa.array(own)))
        if not len(ids):
            return _RESULT.empty_table()
        rows = sorted(zip(ids.tolist(), place(texts).tolist(), texts, strict=True))
        guest = min(blocks.received_texts(table.filter(pa.array(~own)))[1])
        text = [x.decode() for _, _, x in rows]
        following = [*text[1:], guest.decode()]
        changed = [edited(a, b) for a, b in zip(text, following, strict=True)]
        found = sketches(pa.array(following[-1:] + text, pa.large_string()), k, scale)
        own_sketch, last = found[1:], found[0]
        other = sketches(pa.array(changed, pa.large_string()), k, scale)
        return pa.Table.from_pydict(
            {
                "doc_id": [None if i == blocks.NO_ID else i for i, _, _ in rows],
                "n_chars": [len(x) for x in text],
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                "fingerprint": [as_text(x) for x in own_sketch],
                "edited_fingerprint": [as_text(x) for x in other],
                "near_edited": [likeness(a, b) for a, b in zip(own_sketch, other, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own_sketch, [*own_sketch[1:], last], strict=True)],
            },
            schema=_RESULT,
        )

    dealt = docs.mapInArrow(deal, blocks.TEXTS_DDL)
    group = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return dealt.groupBy(group.alias("group")).applyInArrow(lambda _, table: pairs(table), _RESULT_DDL)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
