"""Personal data: patterns for identifiers, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP and card numbers and phone numbers, by fixed patterns. Beyond
them, a term (a run of ASCII letters and characters outside ASCII of three bytes or more, A-Z folded)
can give away a protected entity by keeping its company. Entities are identifiers and what several of them
have in common (``keys``): the domain of an address, the network of an IP number, the issuer of a card,
the area of a phone number. Over all N documents, an entity is mentioned
in n_e, a term occurs in n_t, and stands within WINDOW words of a mention of the entity in n_et; the
term's disclosure of the entity is

    PMI(entity, term) / IC(entity) = log(n_et N / (n_e n_t)) / log(N / n_e),

the share of the entity's information that the term gives. Copies prove nothing: a pair must be seen
in SUPPORT different windows. Nor does chance: n_et PMI, which is how improbable the pair is if term and entity are
independent (as a logarithm), must be as much as the logarithm of the number of pairs looked at, so about one
pair of a whole corpus is expected to pass by chance, however large it is. Terms with a share of GENERALISE or more for some
entity are generalised to their kind of word in every document that holds them, the entity there or not, and those of
REMOVE or more are removed.

Steps: one pass collects windows and, a batch at a time, in how many texts each term occurs; joins by
term and entity give the shares; a second pass rewrites the texts where they are read. The telling
terms are broadcast as pairs of numbers if they are TERMS at most; beyond that, each row is joined with its own.

Cases: a null text is empty and has no spans; offsets are code points, ends exclusive; matches of
one kind never overlap, those of two kinds may; a term that a base span touches is left to it; in the
sanitised text overlapping spans become one, named after the first. Copies of a document get the same
spans. All steps take time in proportion to a text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import Words, batches, mix, slices, table
from panelspark.llm.shared import written

# The contract's patterns, fixed; that of addresses can't begin within a number, which changes nothing but the time on long ones.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
#: A share s says that a document with the term mentions the entity with a probability of (n_e / N) ** (1 - s): as terms are
#: changed wherever they stand, not only beside the entity, they must tell nearly all.
GENERALISE = 0.85
REMOVE = 0.95
#: Words on either side of a mention.
WINDOW = 16
#: Parts that the pairs of an entity are joined in, as it may be in every footer.
PARTS = 32
#: Telling terms that are broadcast, of 16 bytes each.
TERMS = 1_000_000
#: Bytes of a term at least.
LETTERS = 3
_TERMS = table(b"abcdefghijklmnopqrstuvwxyz", lower=True)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the whole pattern would find them, but from each @ outwards, so that long runs cost nothing."""
    out: list[tuple[int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), ascending."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x) < 4 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def entity(text: str, kind: int) -> str:
    return KINDS[kind] + ":" + (text.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", text))


def keys(text: str, kind: int) -> list[str]:
    """The entity of an identifier and what it has in common with others."""
    name = entity(text, kind)
    value = name.partition(":")[2]
    if kind == 0:
        domain = value.rpartition("@")[2]
        return list(dict.fromkeys([name, f"domain:{domain}", "domain:" + ".".join(domain.split(".")[-2:])]))
    if kind == 1:
        parts = value.split(".")
        return [name, "network:" + ".".join(parts[:3]), "network:" + ".".join(parts[:2])]
    return [name, f"issuer:{value[:6]}" if kind == 2 else f"area:{value[:-7]}"]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _points(text: str) -> np.ndarray:
    """Of each byte of a text, and of its end, the code point it belongs to."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]])


class _Terms:
    """The terms of a run of texts: hash, and place in code points once asked for."""

    def __init__(self, words: Words):
        long = words.ends - words.starts >= LETTERS
        self.words, self.starts, self.ends, self.hashes = words, words.starts[long], words.ends[long], words.hashes[long]
        self.first = np.concatenate([[0], np.cumsum(long)])[words.first]

    def places(self, i: int, text: str, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the i-th text's terms, which begins at a byte offset."""
        point = _points(text)
        lo, hi = self.first[i], self.first[i + 1]
        return point[self.starts[lo:hi] - offset], point[self.ends[lo:hi] - offset]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], _Terms, np.ndarray]]:
    """(first row, texts, terms, byte offsets of the texts) of runs of a batch."""
    texts = [x or "" for x in batch.column("text").to_pylist()]
    for first, words in batches(batch.column("text"), _TERMS):
        yield first, texts[first : first + len(words.first) - 1], _Terms(words), words.bounds


def _apart(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which terms no span touches."""
    lo = np.array([a for a, _, _ in spans], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, _, b in spans], np.int64))
    at = np.searchsorted(lo, ends, side="left") - 1  # the last span that begins before the term ends
    return (at < 0) | (reach[np.maximum(at, 0)] <= starts)


_EVIDENCE_DDL = "entities array<string>, window long, terms array<long>, counts array<long>"


def _evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text and window a row (entities it is of, window, terms); of each batch a row of its terms and in how many texts they are."""
    for batch in slices(it):
        entities: list[list[str] | None] = []
        windows: list[int | None] = []
        terms: list[np.ndarray] = []
        seen = [np.empty(0, np.uint64)]
        for _, texts, found, offsets in _runs(batch):
            of = np.repeat(np.arange(len(texts)), np.diff(found.first))
            order = np.lexsort((found.hashes, of))
            h, o = found.hashes[order], of[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            seen.append(h[fresh])
            for i, text in enumerate(texts):
                spans = base_spans(text)
                if not spans:
                    continue
                starts, ends = found.places(i, text, offsets[i])
                mine = found.hashes[found.first[i] : found.first[i + 1]]
                apart = _apart(starts, ends, spans)
                starts, mine = starts[apart], mine[apart]
                near: dict[str, list[np.ndarray]] = {}
                for a, k, b in spans:
                    at, end = np.searchsorted(starts, [a, b])
                    some = mine[max(0, at - WINDOW) : end + WINDOW]
                    for name in keys(text[a:b], k):
                        near.setdefault(name, []).append(some)
                one: dict[bytes, list[str]] = {}
                for name, some in near.items():
                    one.setdefault(np.unique(np.concatenate(some)).tobytes(), []).append(name)
                for raw, names in one.items():
                    distinct = np.frombuffer(raw, np.uint64)
                    entities.append(names)
                    windows.append(int(mix(np.cumsum(mix(distinct), dtype=np.uint64)[-1:]).view(np.int64)[0]) if len(distinct) else 0)
                    terms.append(distinct.view(np.int64))
        every, n = np.unique(np.concatenate(seen), return_counts=True)
        lists = [*terms, every.view(np.int64)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        counts = [None] * len(terms) + [n.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*entities, None], pa.list_(pa.string())), pa.array([*windows, None], pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(lists), pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
            names=["entities", "window", "terms", "counts"],
        )


def disclosing(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """docs(text) -> entity, term (hash), n_e, n_t, n_et, share: the pairs that disclose, for audits."""
    total = docs.count()
    found = written(docs.select("text").mapInArrow(_evidence, _EVIDENCE_DDL), "evidence")
    n_t = found.where("entities is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n_t"))
    # equal windows have equal terms, so they are one row with a count before terms become rows
    mentions = found.where("entities is not null").select(F.explode("entities").alias("entity"), "window", "terms")
    windows = written(mentions.groupBy("entity", "window").agg(F.count("*").alias("n"), F.first("terms").alias("terms")), "windows")
    chance = float(np.log(max(1, windows.agg(F.sum(F.size("terms"))).head()[0] or 0)))
    n_e = windows.groupBy("entity").agg(F.sum("n").alias("n_e")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    pairs = windows.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("windows")).where(F.col("windows") >= support)
    likely = pairs.withColumn("part", F.pmod("term", F.lit(PARTS)).cast("int")).join(n_e, ["entity", "part"]).join(n_t, "term")
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return likely.where(F.col("n_et") * pmi >= chance).select("entity", "term", "n_e", "n_t", "n_et", share.alias("share")).where(F.col("share") >= least)


def disclosures(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """docs(text) -> term (hash), share: terms that disclose some entity, with the largest share of any."""
    return disclosing(docs, support, least).groupBy("term").agg(F.max("share").alias("share"))


def kind_of_word(word: str) -> str:
    """What a generalised term becomes."""
    return "[ACRONYM]" if len(word) > 1 and word.isupper() else "[NAME]" if word[:1].isupper() else "[WORD]"


def _sanitised(text: str, spans: list[tuple[int, int, int]], removed: set[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out.append(text[at:a])
            if k < 4:
                out.append(f"[{KINDS[k].upper()}]")
            elif (a, b) not in removed:
                out.append(kind_of_word(text[a:b]))
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("text", pa.string())])
_FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, text string"


def _telling(keys: np.ndarray, shares: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Share of each hash by ascending keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, shares[at], 0.0)


def _apply(shared, remove: float, keep_text: bool, carry: tuple[str, ...]):
    """shared: broadcast (terms, shares), or None where each row brings its own as ``telling``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shares = shared.value if shared is not None else (None, None)
        for batch in slices(it):
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            own = batch.column("_telling").to_pylist() if shared is None else None
            for first, texts, found, offsets in _runs(batch):
                share = _telling(keys, shares, found.hashes) if shared is not None else None
                for i, text in enumerate(texts):
                    if shared is None:
                        mine = sorted((x["term"], x["share"]) for x in own[first + i] or [])
                        told = _telling(np.array([x for x, _ in mine], np.int64), np.array([x for _, x in mine]), found.hashes[found.first[i] : found.first[i + 1]].view(np.int64))
                    else:
                        told = share[found.first[i] : found.first[i + 1]]
                    base = base_spans(text)
                    every, removed = base, set()
                    if len(at := np.flatnonzero(told)):
                        starts, ends = (x[at] for x in found.places(i, text, offsets[i]))
                        told = told[at]
                        if base:
                            apart = _apart(starts, ends, base)
                            starts, ends, told = starts[apart], ends[apart], told[apart]
                        terms = list(zip(starts.tolist(), ends.tolist(), strict=True))
                        every = [*base, *((a, 4, b) for a, b in terms)]
                        removed = {t for t, s in zip(terms, told.tolist(), strict=True) if s >= remove}
                    named = joined(base)
                    out.append((ids[first + i], *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(named.encode()).hexdigest(), named if every is base else joined(every), (_sanitised(text, every, removed) if every else text) if keep_text else None))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(_FOUND), _FOUND.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, carry)], names=[*_FOUND.names, *carry])

    return run


def _held(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's terms, once each."""
    for batch in slices(it):
        rows = batch.column("row").to_numpy()
        for first, texts, found, _ in _runs(batch):
            each = np.unique(np.stack([rows[first + np.repeat(np.arange(len(texts)), np.diff(found.first))].view(np.uint64), found.hashes], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, 0].view(np.int64)), pa.array(each[:, 1].view(np.int64))], names=["row", "term"])


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = True, carry: tuple[str, ...] = (), most_terms: int = TERMS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text (sanitised; null unless ``keep_text``) and the columns named in ``carry``."""
    schema = ", ".join([_FOUND_DDL, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    telling = written(disclosures(rows, support, generalise), "disclosures")
    if telling.count() <= most_terms:
        found = telling.toArrow()
        keys = found.column("term").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], found.column("share").to_numpy()[order]))
        return rows.mapInArrow(_apply(shared, remove, keep_text, carry), schema)
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    held = numbered.select(F.col("_row").alias("row"), "text").mapInArrow(_held, "row long, term long").join(telling, "term")
    own = held.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("_telling")).withColumnRenamed("row", "_row")
    return numbered.join(own, "_row", "left").drop("_row").mapInArrow(_apply(None, remove, keep_text, carry), schema)
