"""Byte-level BPE by prefix dynamic programming.

Merging by rank gives every byte string one encoding, and of each of its prefixes too. The encoding of
a prefix ends in some token t, and what stands before t is the encoding of the shorter prefix: so one
token a prefix, its last, is all that has to be stored. The last token of a prefix is the one token
among those it ends in that may follow the last token of what is before it; whether two tokens may
stand side by side depends on them alone (``Vocabulary.may_follow``), so the table grows a byte at a time, and

- bytes can be appended at any time, exactly, without looking at what is there again (``Prefixes.append``);
- after an edit, prefixes before it stand; behind it, the table is the old one again as soon as the
  longest token's length of entries agree with the old ones (``Prefixes.replace``);
- the encoding of every prefix can be read from the same table (``Prefixes.ids``).

Text is split by the vocabulary's pattern first and every match is encoded by itself. ``Encoded`` keeps a
text with its matches, and splits and encodes only those that an edit touches. In ``encode`` a task keeps the
ids of short matches it has met, a bounded number of them, so most of a text is looked up.

Cases: a null or empty text has no ids; a match that is a token as a whole is that token; there are no
special tokens: their strings are ordinary text. Rows of equal doc_id are encoded one by one; an empty table
gives no rows. All steps take time in proportion to a text's length, long runs of one character included.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.hashing import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Matches whose ids a process keeps (about 200 bytes each), and the longest such match in characters.
KEPT, SHORT = 1 << 19, 64
#: Pairs of tokens whose verdict a process keeps (about 130 bytes each).
PAIRS = 1 << 19
#: Bytes of text that a task takes up at a time.
LOT = 1 << 20


class Vocabulary:
    """Tokens and their ranks, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        self.longest = max(self.sizes, default=0)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict, dict] = {}, {}
        self._pairs: dict[int, bool] = {}

    @cached_property
    def _ends(self):
        """Finds every token that stands in a text; only encoding needs it."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), rank)
        found.make_automaton()
        return found

    def merged(self, token: int) -> list[int]:
        """What merging makes of a token's bytes before the token itself would arise."""
        data = self.tokens[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= token:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that no merge makes."""
        if token not in self._parts:
            found = self.merged(token) if len(self.tokens[token]) > 1 else []
            self._parts[token] = tuple(found) if len(found) == 2 else None
        return self._parts[token]

    def arises(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) of what stands at a token's edge while it is made, the token itself first."""
        out = self._edges[side].get(token)
        if out is None:
            out = [(token, len(self.tokens))]
            while (parts := self.parts(out[-1][0])) is not None:
                out.append((parts[side], out[-1][0]))
            self._edges[side][token] = out
        return out

    def _judged(self, a: int, b: int) -> bool:
        if not self.arises(b):
            return False
        left, right = self._edge(a, 1), self._edge(b, 0)
        x, y = len(left) - 1, len(right) - 1
        # as merges go by rank, the two neighbours at the border change in the order of these ranks; of equal ranks the leftmost goes first
        while True:
            (one, taken_one), (two, taken_two) = left[x], right[y]
            across = self.ranks.get(self.tokens[one] + self.tokens[two])
            if across is not None and across < taken_one and across <= taken_two:
                return False
            if not x and not y:
                return True
            if taken_one <= taken_two:
                x -= 1
            else:
                y -= 1

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves a and b, where a arises by itself."""
        verdict = self._pairs.get(a << 32 | b)
        if verdict is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            verdict = self._pairs[a << 32 | b] = self._judged(a, b)
        return verdict

    def extend(self, last: list[int] | array, data: bytes, offset: int, enough=None) -> None:
        """Appends to the last tokens of the prefixes those of the next ones; data begins at ``offset`` and holds the longest token's length before them, or all.

        ``enough`` is asked after each and may end it.
        """
        sizes, pairs, append, n = self.sizes, self._pairs, last.append, len(last)
        for end, token in self._ends.iter(data.decode("latin-1")):  # the longest token first of those with one end
            end += offset
            if end < n:
                continue  # found already
            before = end - sizes[token]
            if before >= 0:
                one = last[before]
                verdict = pairs.get(one << 32 | token)
                if verdict or (verdict is None and self.may_follow(one, token)):
                    append(token)
                    n += 1
                    if enough is not None and enough():
                        return
            elif self.arises(token):
                append(token)
                n += 1
                if enough is not None and enough():
                    return
        if n != offset + len(data):
            raise ValueError(f"no token of the vocabulary ends the first {n + 1} bytes")

    def read(self, last: list[int] | array, end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, from the last tokens of the prefixes."""
        sizes, out = self.sizes, []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


class Prefixes:
    """Bytes and the last token of each of their prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), array("i")
        self.append(data)

    def append(self, more: bytes) -> None:
        self._extend(more, None, 0)

    def _extend(self, more: bytes, old: array | None, at: int) -> int:
        """Appends bytes; stops once the entries agree with the old ones from ``at`` on, which belong to the same bytes. Bytes taken."""
        known, longest = len(self.data), self.vocabulary.longest
        back = min(known, longest)  # tokens may begin in what is there
        self.data += more
        agreed = 0

        def enough() -> bool:
            nonlocal agreed
            taken = len(self.last) - known
            agreed = agreed + 1 if taken > at and self.last[-1] == old[taken - at - 1] else 0
            return agreed >= longest

        self.vocabulary.extend(self.last, bytes(self.data[known - back :]), known - back, enough if old is not None else None)
        del self.data[len(self.last) :]
        return len(self.last) - known

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new bytes in the place of those from start to stop; how many entries were found anew."""
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        taken = self._extend(new + tail, old, len(new))
        if taken < len(new) + len(tail):
            self.data += tail[taken - len(new) :]
            self.last += old[taken - len(new) :]
        return taken

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        return self.vocabulary.read(self.last, len(self.last) if end is None else end)


class Known(dict):
    """Ids of matches of the pattern; those of short ones stay."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        data, v = piece.encode(), self.vocabulary
        whole = v.ranks.get(data)
        if whole is not None:
            found = [whole]
        else:
            last: list[int] | array = [] if len(data) < 1 << 10 else array("i")
            v.extend(last, data, 0)
            found = v.read(last, len(data))
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self._known = vocabulary, Known(vocabulary)

    def match(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        return self._known[piece]

    def _lots(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, of a long one so many at a time."""
        if len(text) <= LOT:
            yield self.vocabulary.pattern.findall(text)
            return
        matches = self.vocabulary.pattern.finditer(text)
        while some := [m[0] for m in islice(matches, LOT >> 4)]:
            yield some

    def encode(self, text: str) -> array:
        out = array("I")
        for pieces in self._lots(text):
            out.extend(chain.from_iterable(map(self._known.__getitem__, pieces)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


class Encoded:
    """A text with its matches and their ids, which follow its edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.ends, self.ids = [], []
        self._split(0, None, 0)

    def _split(self, at: int, old: list[int] | None, shift: int) -> int | None:
        """Matches from a place on, to the end or to where one of the old ones ends, shifted; which of the old follow."""
        for m in self.encoder.vocabulary.pattern.finditer(self.text, at):
            self.ends.append(m.end())
            self.ids.append(self.encoder.match(m[0]))
            if old is not None:
                k = bisect_left(old, m.end() - shift)
                if k < len(old) and old[k] == m.end() - shift:
                    return k + 1
        return None

    def replace(self, start: int, stop: int, new: str) -> int:
        """Puts a new text in the place of the characters from start to stop; how many matches were found anew."""
        # a match depends on its own characters and the one that follows it: those that end before the edit stand
        first = bisect_left(self.ends, start)
        ends, ids = self.ends[first:], self.ids[first:]
        del self.ends[first:], self.ids[first:]
        self.text = self.text[:start] + new + self.text[stop:]
        behind = bisect_left(ends, max(stop, start + 1) if stop > start else stop)
        shift = len(new) - (stop - start)
        # an old end counts only behind the edit, where both texts go on alike
        rest = self._split(self.ends[-1] if self.ends else 0, ends[behind:], shift)
        done = len(self.ends) - first
        if rest is not None:
            self.ends += [e + shift for e in ends[behind + rest :]]
            self.ids += ids[behind + rest :]
        return done

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def all_ids(self) -> list[int]:
        return [i for some in self.ids for i in some]


_encoders: dict[str, Encoder] = {}


def load(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file, read once in a process."""
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers

        with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = Encoder(Vocabulary(ranks, public_tokenizers.PATTERN))
    return _encoders[vocabulary]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit integers, joined)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        for batch in slices(it, LOT):
            ids = [np.array(encoder.encode(x.as_py() or ""), "<u4").tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, ids, decoded (bytes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                decoded = [encoder.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in some.column("ids")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """Digests in place of ids and bytes."""
    n = F.coalesce(F.octet_length("ids"), F.lit(0)) / 4
    return decoded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
