"""Vectorised word and shingle hashes over Arrow batches of text.

All texts of a batch are one UTF-8 buffer, so a word's hash needs no Python object: the
polynomial hash of a byte range is a difference of two prefix sums, brought to a common origin
by a power of the inverse base (arithmetic modulo 2**64). Equal byte strings have equal hashes
wherever they stand; a 64-bit finaliser spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = b" \t\n\v\f\r"
#: Bytes of text hashed at a time; a longer text still goes in one piece. A step needs about 60 bytes for each.
CHUNK = 1 << 18
#: Bytes of text whose keys are combined before they are sent.
LOT = 1 << 22

_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        n = max(n, CHUNK + 1)
        for base, name in ((BASE, "_up"), (INVERSE, "_down")):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x)
    return _up[:n], _down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(word_bytes: bytes | None = None, lower: bool = False) -> bytes:
    """A byte translation: separators to a space, and A-Z to a-z if ``lower``.

    Without ``word_bytes`` the separators are ASCII white space; bytes over 127 are always part of
    words, as every UTF-8 sequence of a non-ASCII character consists of them.
    """
    t = bytearray(range(256))
    if lower:
        for b in range(65, 91):
            t[b] = b + 32
    for b in range(128):
        if (word_bytes is None and b in SPACES) or (word_bytes is not None and t[b] not in word_bytes):
            t[b] = 32
    return bytes(t)


PLAIN = table()
FOLDED = table(lower=True)


class Words:
    """Words of a run of texts: ``starts``/``ends`` in ``data``, ``hashes``, of each text its range of words (``first``) and of bytes (``bounds``)."""

    def __init__(self, data: bytes, bounds: np.ndarray):
        """data: translated bytes; bounds: where each text starts, and the end."""
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        inside = b != 32
        step = np.empty(n + 1, bool)
        step[0] = n > 0 and inside[0]
        step[n] = n > 0 and inside[-1]
        if n > 1:
            np.not_equal(inside[1:], inside[:-1], out=step[1:n])
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        joined = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts  # texts that touch: a word ends and another starts
        edges = np.flatnonzero(step)
        if len(joined):
            edges = np.sort(np.concatenate([edges, joined, joined]))
        self.data, self.starts, self.ends = data, edges[0::2], edges[1::2]
        up, down = _powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.first, self.bounds = np.searchsorted(self.starts, bounds), bounds

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on (of a text's last k-1 words it means nothing), and which are whole."""
        h, n = self.hashes, len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                acc = acc * np.uint64(BASE) + h[i : n - k + 1 + i]
            out[: n - k + 1] = mix(acc)
        whole = np.ones(n, bool)
        lasts = self.first[1:]
        for i in range(1, k):
            at = lasts - i
            whole[at[at >= self.first[:-1]]] = False
        return out, whole


def _offsets(column: pa.Array) -> np.ndarray:
    """Of a column of large binaries."""
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def runs(column: pa.Array, limit: int = CHUNK):
    """(first, end) of runs of texts of about ``limit`` bytes, a text at least."""
    offsets = _offsets(column.cast(pa.large_binary())) if len(column) else ()
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def slices(it: Iterator[pa.RecordBatch], limit: int = LOT, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about ``limit`` bytes of text, as their number of rows says nothing of their size."""
    for batch in it:
        for i, j in runs(batch.column(column), limit):
            yield batch.slice(i, j - i)


def batches(column: pa.Array, translation: bytes, limit: int = CHUNK):
    """(index of the first text, Words) of runs of texts of about ``limit`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = _offsets(column) if len(column) else ()
    data = column.buffers()[2]
    for i, j in runs(column, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        raw = bytes(data[lo:hi]) if data is not None and hi > lo else b""
        yield i, Words(raw.translate(translation), (offsets[i : j + 1] - lo).astype(np.int64))


def encoded(texts: list[str | None]) -> pa.Array:
    return pa.array([x or "" for x in texts], pa.large_string())


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of k words; a text of fewer, but not none, is one run."""
    sizes = np.diff(words.first)
    h, whole = words.windows(k)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found, of = [h[whole]], [text[whole]]
    for n in range(1, k):
        short = np.flatnonzero(sizes == n)
        if len(short):
            found.append(mix(words.windows(n)[0][words.first[short]] + np.uint64(n)))
            of.append(short)
    return np.concatenate(found), np.concatenate(of)


def distinct(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner, then value."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[keep], owners[keep]
