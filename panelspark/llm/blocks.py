"""Rows that carry many keys or texts each, for shuffles of billions of small entries.

A task sorts what it emits by bucket and sends one row per bucket: arrays of 64-bit keys and
owners, or texts compressed together. The shuffle then moves a few wide rows instead of a row per
entry, and grouped maps read whole arrays. Buckets are numerous (see shared.buckets), so a group
stays small; keys that repeat in a batch are combined before they are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from panelspark.llm.hashing import mix, slices

CODEC = pa.Codec("zstd", compression_level=1)

KEYS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])
KEYS_DDL = "bucket int, keys binary, owners binary"
OWNERS = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("owners", pa.binary())])
OWNERS_DDL = "bucket int, n long, owners binary"
TEXTS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])
TEXTS_DDL = "bucket int, ids binary, sizes binary, texts binary"


def bucket_of_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets of keys whose bits are well mixed."""
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def bucket_of_ids(ids: np.ndarray, n: int) -> np.ndarray:
    return bucket_of_keys(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27)), n)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of runs of a sorted array."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), a, b


def send_keys(bucket: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((owners, bucket))
    bucket, keys, owners = bucket[order], keys[order], owners[order].astype(np.int64)
    runs = list(_runs(bucket))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in runs], pa.binary()), pa.array([squeezed(owners[a:b]) for _, a, b in runs], pa.binary())], schema=KEYS)


def squeezed(ascending: np.ndarray) -> bytes:
    """Differences of ascending integers, byte plane by byte plane, compressed: about a byte each."""
    steps = np.diff(ascending, prepend=np.int64(0))
    return CODEC.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(CODEC.decompress(raw, decompressed_size=8 * n, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel())


def received_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    owners = [unsqueezed(x.as_py(), len(k)) for k, x in zip(keys, table.column("owners"), strict=True)]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def send_owners(bucket: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """As send_keys, without keys."""
    order = np.lexsort((owners, bucket))
    bucket, owners = bucket[order], owners[order].astype(np.int64)
    runs = list(_runs(bucket))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([b - a for _, a, b in runs], pa.int64()), pa.array([squeezed(owners[a:b]) for _, a, b in runs], pa.binary())], schema=OWNERS)


def received_owners(table: pa.Table) -> np.ndarray:
    lots = [unsqueezed(x.as_py(), n.as_py()) for n, x in zip(table.column("n"), table.column("owners"), strict=True)]
    return np.concatenate(lots) if lots else np.empty(0, np.int64)


def send_texts(bucket: np.ndarray, ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, ids = bucket[order], ids[order]
    rows: list[tuple] = []
    for b, lo, hi in _runs(bucket):
        some = [texts[i] for i in order[lo:hi].tolist()]
        sizes = np.array([len(x) for x in some], np.int64)
        rows.append((b, ids[lo:hi].astype(np.int64).tobytes(), sizes.tobytes(), CODEC.compress(b"".join(some), asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, TEXTS.types, strict=True)], schema=TEXTS)


def received_texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids, texts = [], []
    for row in range(table.num_rows):
        sizes = np.frombuffer(table.column("sizes")[row].as_py(), np.int64)
        ids.append(np.frombuffer(table.column("ids")[row].as_py(), np.int64))
        joined = CODEC.decompress(table.column("texts")[row].as_py(), decompressed_size=int(sizes.sum()), asbytes=True) if sizes.sum() else b""
        ends = np.cumsum(sizes)
        texts += [joined[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return (np.concatenate(ids) if ids else np.empty(0, np.int64)), texts


#: Stands for a null id inside blocks; it sorts first.
NO_ID = -(1 << 63)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts_by_id(n_buckets: int):
    """docs(doc_id, text) -> blocks of texts, dealt by id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            ids = ids_of(batch.column("doc_id"))
            yield send_texts(bucket_of_ids(ids, n_buckets), ids, raw_texts(batch.column("text")))

    return run
