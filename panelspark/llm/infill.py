"""Fill-in-the-middle rewriting of whole texts, cut between units by overlapping-chunk decomposition.

A unit is a run of ASCII letters or any other single character, so one begins at every character
except a letter after a letter: a predicate on two adjacent characters. A text is decomposed into
chunks that overlap by one character, the last of the chunk before, so each chunk counts the units
that begin in it knowing nothing of the others. Prefix sums over the counts of a text's chunks give
the number of its units, hence the two cut ranks, and route each rank to the chunk that owns it; only
these chunks are scanned again, for the place itself. Chunks of all texts of an Arrow batch are counted
together, and what is held beside the text is a lot of chunks, so memory doesn't follow a text's length.
Letters are ASCII, so the predicate works on the bytes of UTF-8: of another character the first byte
begins the unit. Nothing is shuffled.

Which form a document takes, and its cuts, follow from the sha256 of the seed and its doc_id alone.

Cases: a null text is empty; an empty text, and one that holds a mark, stays plain; a null doc_id counts as
an empty number; rows of one doc_id are rewritten one by one, with the same draws; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rewritten, and of 100 of these so many put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk, and of chunks counted at a time.
CHUNK, LOT = 1 << 13, 1 << 20

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def begins(data: np.ndarray, lo: int, hi: int, fresh: bool) -> np.ndarray:
    """Of the bytes lo to hi, which begin a unit; data[lo - 1] is the overlap, unless a text begins at lo (fresh)."""
    letter = _LETTER[data[lo if fresh else lo - 1 : hi]]
    out = (data[lo:hi] & 0xC0) != 0x80
    out[1 if fresh else 0 :] &= ~(letter[1:] & letter[:-1])
    return out


class Cut(NamedTuple):
    """A place between units: bytes and code points before it."""

    at: int
    chars: int


class Chunks:
    """The chunks of texts that lie in one buffer, and prefix sums of the units and characters that begin in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK):
        """bounds: where each text starts, and the end."""
        self.data, self.bounds = data, bounds
        sizes = np.diff(bounds)
        n = -(-sizes // chunk)  # chunks of each text; none for an empty one
        self.first = np.concatenate([[0], np.cumsum(n)])
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n)
        self.starts = np.repeat(bounds[:-1], n) + within * chunk
        self.ends = np.minimum(self.starts + chunk, np.repeat(bounds[1:], n))
        self.fresh = within == 0
        units, chars = np.zeros((2, len(self.starts) + 1), np.int64)
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + LOT, side="right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            begin = begins(data, lo, hi, bool(self.fresh[i]))
            lead = (data[lo:hi] & 0xC0) != 0x80
            heads = self.starts[i:j][self.fresh[i:j]] - lo
            begin[heads] = True  # a text begins: what lies before it is another's
            at = self.starts[i:j] - lo
            units[i + 1 : j + 1] = np.add.reduceat(begin, at, dtype=np.int64)
            chars[i + 1 : j + 1] = np.add.reduceat(lead, at, dtype=np.int64)
            i = j
        self.units, self.chars = np.cumsum(units), np.cumsum(chars)

    def counts(self, text: int) -> tuple[int, int]:
        """Units and characters of a text."""
        a, b = self.first[text], self.first[text + 1]
        return int(self.units[b] - self.units[a]), int(self.chars[b] - self.chars[a])

    def cut(self, text: int, rank: int) -> Cut:
        """Where a text's first ``rank`` units end."""
        a, b = int(self.first[text]), int(self.first[text + 1])
        n, chars = self.counts(text)
        if rank >= n:
            return Cut(int(self.bounds[text + 1] - self.bounds[text]), chars)
        owner = a + int(np.searchsorted(self.units[a + 1 : b + 1], self.units[a] + rank, side="right"))
        lo, hi = int(self.starts[owner]), int(self.ends[owner])
        begin = begins(self.data, lo, hi, bool(self.fresh[owner]))
        at = int(np.flatnonzero(begin)[rank - int(self.units[owner] - self.units[a])])
        before = int(np.count_nonzero((self.data[lo : lo + at] & 0xC0) != 0x80))
        return Cut(lo + at - int(self.bounds[text]), int(self.chars[owner] - self.chars[a]) + before)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


_MARKS = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
_RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_RESULT_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rewritten(seed: int, rewritten: int, suffix_first: int, chunk: int):
    p, s, m = _MARKS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            column = batch.column("text").cast(pa.large_binary())
            texts = [x or b"" for x in column.to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            chunks = Chunks(np.frombuffer(b"".join(texts), np.uint8), bounds, chunk)
            rows = []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
                n, _ = chunks.counts(i)
                h = draws(doc, seed)
                if not text or h[2] % 100 >= rewritten or any(x in text for x in _MARKS):
                    rows.append((doc, n, "plain", None, None, text))
                    continue
                a, b = (chunks.cut(i, r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = text[: a.at], text[a.at : b.at], text[b.at :]
                form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h[3] % 100 < suffix_first else ("psm", (p, prefix, s, suffix, m, middle))
                rows.append((doc, n, form, a.chars, b.chars - a.chars, b"".join(parts)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()).cast(t) if t == pa.string() and k == "output" else pa.array(x, t) for x, t, k in zip(columns, _RESULT.types, _RESULT.names, strict=True)], schema=_RESULT)

    return run


def rewrite(docs: DataFrame, seed: int = 1, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rewritten(seed, rewritten, suffix_first, chunk), _RESULT_DDL)


def restored(output: Column, form: Column) -> Column:
    """The text that was rewritten. Marks stand in it once each, as a text that holds one stays plain, and none arises where a mark meets text."""
    parts = lambda second: F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{second}|{MIDDLE}", -1)
    psm, spm = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    """Digests of the output and of the text rebuilt from it, in place of the output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}).drop("output")
