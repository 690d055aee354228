"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

The automaton works on word numbers, not characters: words outside the benchmark's vocabulary are
number 0, so a text is walked once however many items there are, and a match's end is a word
position that maps straight back to offsets of the original text, found in the same scan.

Cases: a null or empty text has no words and no hits; an item without words is ignored; an item
shorter than the window is one window; equal items all count; a null item_id is named by the empty string; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import slices, table
from panelspark.llm.shared import written

#: A-Z are lower-cased; 0-9, a-z and everything outside ASCII make up words.
NORMAL = table(b"abcdefghijklmnopqrstuvwxyz0123456789", lower=True)
#: Words of one automaton (about 0.7 KB a word in each Python worker); a larger benchmark is scanned for in blocks.
BLOCK_WORDS = 100_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Matcher:
    """items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        windows: dict[tuple, set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(k)
        self.shortest = min(map(len, windows), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in windows.items():
            self.automaton.add_word(key, (len(key), tuple(found)))
        if windows:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words (end exclusive) and the items found."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        get = self.number.get
        ids = [get(w, 0) for w in words]
        ranges: list[list[int]] = []
        items: set[int] = set()
        for end, (n, found) in self.automaton.iter(tuple(ids)):
            lo, hi = end + 1 - n, end + 1
            items.update(found)
            while ranges and lo <= ranges[-1][1]:  # ends never decrease
                lo = min(lo, ranges[-1][0])
                ranges.pop()
            ranges.append([lo, hi])
        return [(a, b) for a, b in ranges], items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code points of the original text that ranges of words cover."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(point[starts[a]]), "end": int(point[ends[b - 1]])} for a, b in ranges]


_STATE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_words", pa.int64()),
        ("firsts", pa.list_(pa.int64())),
        ("lasts", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_STATE_DDL = "doc_id long, text string, n_words long, firsts array<long>, lasts array<long>, items array<string>, spans array<struct<start:long,end:long>>"


def _results(batch: pa.RecordBatch, found: list[tuple], keep_text: bool, carry: tuple[str, ...]) -> pa.RecordBatch:
    """found: of each row (text, number of words, ranges, names of items)."""
    rows = [(doc, text if keep_text else None, n, [a for a, _ in ranges], [b for _, b in ranges], names, offsets(text, ranges) if ranges else []) for doc, (text, n, ranges, names) in zip(batch.column("doc_id").to_pylist(), found, strict=True)]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_STATE), _STATE.types, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *map(batch.column, carry)], names=[*_STATE.names, *carry])


def _scan(shared, window: int, keep_text: bool, carry: tuple[str, ...]):
    """The whole result from one block of items."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, window)
        for batch in slices(it):
            found = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ranges, items = matcher.find(words)
                found.append((text, len(words), ranges, sorted({matcher.names[k] for k in items})))
            yield _results(batch, found, keep_text, carry)

    return run


_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("firsts", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _hits(shared, window: int):
    """What one of several blocks finds: rows with hits only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, window)
        for batch in slices(it):
            rows = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                ranges, items = matcher.find(words_of(text))
                if ranges:
                    rows.append((doc, key, [a for a, _ in ranges], [b for _, b in ranges], sorted({matcher.names[k] for k in items})))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_HITS), _HITS.types, strict=True)], schema=_HITS)

    return run


def _merge(keep_text: bool, carry: tuple[str, ...]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            found = []
            for text, firsts, lasts, items in zip(*(batch.column(c).to_pylist() for c in ("text", "_firsts", "_lasts", "_items")), strict=True):
                found.append((text, len(words_of(text)), merged(list(zip(firsts or [], lasts or [], strict=True))), sorted(items or [])))
            yield _results(batch, found, keep_text, carry)

    return run


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of about ``block_words`` words; one block at a time is in the driver. One empty block if there are no items."""
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text", F.expr("length(text) div 2 + 1").alias("most_words")).where("text is not null")
    total = sized.agg(F.sum("most_words")).head()[0] or 0
    n = max(1, -(-total // block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield sorted(tuple(r) for r in sized.where(part == k).select("item_id", "text").collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, text, n_words, firsts, lasts, items, spans, n_hit.

    firsts/lasts: ranges of hit words, ends exclusive; spans: the code points of the original text under each range; text is null
    unless ``keep_text``; columns named in ``carry`` go along. With one block of items there is no shuffle and one scan of the
    texts; of more blocks, each is one more scan, and only its hits are written and joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    schema = ", ".join([_STATE_DDL, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    share = docs.sparkSession.sparkContext.broadcast
    hits = []
    blocks = blocks_of(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        out = rows.mapInArrow(_scan(share(block), window, keep_text, carry), schema)
    else:
        keyed = rows.withColumn("_text_hash", F.xxhash64("text"))
        while block is not None:
            found = keyed.select("doc_id", F.col("_text_hash").alias("text_hash"), "text").mapInArrow(_hits(share(block), window), "doc_id long, text_hash long, firsts array<long>, lasts array<long>, items array<string>")
            hits.append(written(found, "hits"))
            block, following = following, next(blocks, None)
        flat = lambda c: F.flatten(F.collect_list(c))
        every = reduce(DataFrame.unionByName, hits).distinct().groupBy(F.col("doc_id").alias("_doc_id"), "text_hash").agg(flat("firsts").alias("_firsts"), flat("lasts").alias("_lasts"), F.array_distinct(flat("items")).alias("_items"))
        both = keyed.join(every, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_hash") == F.col("text_hash")), "left")
        out = both.select("doc_id", "text", *carry, "_firsts", "_lasts", "_items").mapInArrow(_merge(keep_text, carry), schema)
    n_hit = F.aggregate(F.zip_with("lasts", "firsts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.withColumn("n_hit", n_hit)


def is_contaminated(n_hit, n_words, share: int = 20):
    """The contract's rule: hits make up at least one in ``share`` words."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
