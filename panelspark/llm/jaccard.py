"""N-gram Jaccard join with token-combination prefixes, and components of near duplicates.

A document is its set of 64-bit hashes of five-word shingles. Two documents that are at least
``percent`` alike share most of the rarest tokens of either, so each indexes a prefix of its tokens,
rarest first. Frequent tokens would fill long lists, so they are indexed in combinations: tokens of
class k (by document frequency) by k at a time, which needs a longer prefix: with at most t tokens
missing, a prefix in which the classes' counts n_k satisfy sum max(0, n_k - k + 1) > t holds a
combination that both documents have. Candidates are verified on the whole sets.

Steps, each one shuffle or a few:

1. Equal sets are one node (hot groups of copies shrink to one). 2. A fixed fraction of the hash
   space is counted in blocks; a document with more tokens found nowhere else than it may miss has
   no partner and goes no further. All tokens of those left are counted again in the same way.
3. The few that remain get document frequencies, prefixes for every size class that a partner can
   be of, and signatures. Each says how large the intersection with a partner found by it can be:
   tokens that no other document has, and those before the first common one, aren't in it.
4. In each signature's list, the member that lacks the fewest tokens of others is verified against
   the rest, and components formed, so a group of n near copies costs about n pairs.
5. What remains are pairs of different components. Where a leader has too few of a document's tokens
   to make a link, a partner must share some of those outside the leader, so these are looked up,
   rarest first; other pairs of a list are taken if their sizes and bounds allow a link. No link
   between components is lost. Components and memberships are computed, not the number of a
   document's links: inside a group of n copies that would take all its pairs.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a
text of fewer than five words is one shingle; rows with equal doc_id and text count once in the
graph and come out as often as they come in; a null doc_id counts as the smallest. Rows are told apart
by (doc_id, hash of the text), so different texts may share a doc_id, null included: tokens are counted
by doc_id in step 2, which says nothing on one with several texts; those wait for the second count,
which is by set. Node keys are
64 bits of a set's hash (wrong merges: about nodes squared / 2**65).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import blocks
from panelspark.llm.graph import components
from panelspark.llm.hashing import BASE, FOLDED, LOT, batches, distinct, mix, shingles, slices
from panelspark.llm.shared import buckets, written

SHINGLE = 5
PERCENT = 75
#: Fraction of the hash space whose tokens are counted. It must exceed 1 - PERCENT / 100, the share a document may miss.
COUNTED = 0.4
#: Tokens in up to so many documents are of class 1, 2; the rest of class 3.
FREQUENT = (32, 1024)
#: Below so many tokens every token stands for itself.
SMALL = 24
#: Size classes from a size to 100 / percent times that size.
FINE = 4
#: Lists with equally good leaders choose in so many ways.
LEADERS = 4
#: Keys of more than a HOT-th of a table's rows, and more than MANY rows, are joined apart from the rest.
HOT, MANY = 20_000, 200
#: Members of a list that travel in one row.
SLICE = 500


def token_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, tokens, text of each) of runs of texts; tokens ascend within a text."""
    for first, words in batches(texts, FOLDED):
        h, of = distinct(*shingles(words, k))
        yield first, first + len(words.first) - 1, h, of


def set_keys(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, size) of each of n sets; equal sets have equal keys."""
    ends = np.searchsorted(of, np.arange(n + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    size = np.diff(ends)
    return mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(np.uint64)).view(np.int64), size


def _sized(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first, end, h, of in token_sets(batch.column("text"), k):
                key, size = set_keys(h, of, end - first)
                ids, hashes = (batch.column(c).slice(first, end - first) for c in ("doc_id", "text_hash"))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(key, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "text_hash", "key", "n"])

    return run


def _first_and_last(t: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of equal tokens its first and last entry."""
    order = np.lexsort((o, t))
    t, o = t[order], o[order]
    ends = np.ones(len(t), bool)
    if len(t) > 2:
        ends[1:-1] = (t[1:-1] != t[:-2]) | (t[1:-1] != t[2:])
    return t[ends], o[ends]


def _counted(k: int, n_buckets: int, fraction: float):
    """Tokens under the fraction, with the document they stand in; equal sets of a batch once, and of a token's documents two."""
    below = np.uint64(min(int(fraction * 2**64), 2**64 - 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            all_ids = blocks.ids_of(batch.column("doc_id"))
            tokens, owners, seen = [], [], np.empty(0, np.int64)
            for first, end, h, of in token_sets(batch.column("text"), k):
                key, _ = set_keys(h, of, end - first)
                fresh = np.zeros(len(key), bool)
                fresh[np.unique(key, return_index=True)[1]] = True
                fresh &= ~np.isin(key, seen)
                seen = np.concatenate([seen, key[fresh]])
                keep = (h < below) & fresh[of]
                tokens.append(h[keep])
                owners.append(all_ids[first:end][of[keep]])
            if not tokens:
                continue
            t, o = _first_and_last(np.concatenate(tokens), np.concatenate(owners))
            yield blocks.send_keys(blocks.bucket_of_keys(mix(t), n_buckets), t, o)

    return run


def _unshared(n_buckets: int):
    """The documents of tokens that came once, once for each."""

    def run(table: pa.Table) -> pa.Table:
        t, o = blocks.received_keys(table)
        _, at, count = np.unique(t, return_index=True, return_counts=True)
        o = o[at[count == 1]]
        return pa.Table.from_batches([blocks.send_owners(blocks.bucket_of_ids(o, n_buckets), o)])

    return run


def _counts(table: pa.Table) -> pa.Table:
    ids, n = np.unique(blocks.received_owners(table), return_counts=True)
    return pa.table({"id": pa.array(ids, pa.int64()), "unshared": pa.array(n, pa.int64())})


def row_owners(ids: np.ndarray, text_hashes: np.ndarray) -> np.ndarray:
    """One number for a doc_id and a text."""
    return mix(mix(ids.view(np.uint64)) + text_hashes.view(np.uint64)).view(np.int64)


def _send_texts(n_buckets: int):
    """docs(doc_id, text, text_hash) -> blocks of texts, dealt by doc_id and text; equal rows of a batch once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            owners = row_owners(blocks.ids_of(batch.column("doc_id")), blocks.ids_of(batch.column("text_hash")))
            owners, at = np.unique(owners, return_index=True)
            yield blocks.send_texts(blocks.bucket_of_ids(owners, n_buckets), owners, blocks.raw_texts(batch.column("text").take(pa.array(at))))

    return run


def _send_nodes(n_buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = row_owners(blocks.ids_of(batch.column("id")), blocks.ids_of(batch.column("text_hash")))
            yield blocks.send_keys(blocks.bucket_of_ids(ids, n_buckets), batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), ids)

    return run


def _pick(k: int):
    def run(texts: pa.Table, nodes: pa.Table) -> pa.Table:
        keys, owners = blocks.received_keys(nodes)
        if not len(keys):
            return _NODES.empty_table()
        key_of: dict[int, set[int]] = {}
        for key, owner in zip(keys.view(np.int64).tolist(), owners.tolist(), strict=True):
            key_of.setdefault(owner, set()).add(key)
        ids, found = blocks.received_texts(texts)
        at = [i for i, x in enumerate(ids.tolist()) if x in key_of]
        some = [found[i] for i in at]
        out: dict[int, tuple[int, bytes]] = {}
        for first, end, h, of in token_sets(pa.array(some, pa.large_binary()), k):
            own, size = set_keys(h, of, end - first)
            for j, (key, n) in enumerate(zip(own.tolist(), size.tolist(), strict=True)):
                if key in key_of[int(ids[at[first + j]])]:
                    out.setdefault(key, (n, some[first + j]))
        return pa.Table.from_pydict({"key": list(out), "n": [x[0] for x in out.values()], "text": [x[1] for x in out.values()]}, schema=_NODES)

    return run


def _node_entries(k: int, n_buckets: int):
    """All tokens of nodes, with their keys; of a lot's equal tokens two."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, LOT // 4):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            tokens, owners = [], []
            for first, _, h, of in token_sets(batch.column("text"), k):
                tokens.append(h)
                owners.append(keys[first + of])
            t, o = _first_and_last(np.concatenate(tokens), np.concatenate(owners))
            yield blocks.send_keys(blocks.bucket_of_keys(mix(t), n_buckets), t, o)

    return run


def still_possible(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Nodes that share enough of all their tokens with other nodes."""
    n_buckets = buckets(nodes)
    unshared = nodes.select("key", "text").mapInArrow(_node_entries(k, n_buckets), blocks.KEYS_DDL).groupBy("bucket").applyInArrow(_unshared(n_buckets), blocks.OWNERS_DDL)
    counts = unshared.groupBy("bucket").applyInArrow(_counts, "id long, unshared long").withColumnRenamed("id", "key")
    too_many = F.col("unshared") > F.col("n") - F.ceil(F.col("n") * percent / 100)
    return nodes.join(counts, "key", "left").where(~F.coalesce(too_many, F.lit(False))).select("key", "n", "text")


_NODES = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])


def possible_nodes(docs: DataFrame, sized: DataFrame, k: int, percent: int, fraction: float) -> DataFrame:
    """key, n, text of the distinct sets that can have a partner."""
    n_buckets = buckets(docs)
    entries = docs.mapInArrow(_counted(k, n_buckets, fraction), blocks.KEYS_DDL)
    unshared = entries.groupBy("bucket").applyInArrow(_unshared(n_buckets), blocks.OWNERS_DDL)
    counts = unshared.groupBy("bucket").applyInArrow(_counts, "id long, unshared long")
    each = sized.where("n > 0").select(F.coalesce("doc_id", F.lit(blocks.NO_ID)).alias("id"), "text_hash", "key", "n")
    # the count of a doc_id is that of one set only if it has no other; the others wait for still_possible
    single = each.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a = b").select("id")
    counts = counts.join(single, "id", "left_semi")
    nodes = each.join(counts, "id", "left").groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("row"), F.max("n").alias("n"), F.max(F.coalesce("unshared", F.lit(0))).alias("unshared"))
    alive = nodes.where(F.col("unshared") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("row.id", "row.text_hash", "key")
    texts = docs.mapInArrow(_send_texts(n_buckets), blocks.TEXTS_DDL)
    return texts.groupBy("bucket").cogroup(alive.mapInArrow(_send_nodes(n_buckets), blocks.KEYS_DDL).groupBy("bucket")).applyInArrow(_pick(k), "key long, n long, text binary")


def _node_tokens(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for first, _, h, of in token_sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([pa.array(keys[first + of], pa.int64()), pa.array(h.view(np.int64), pa.int64())], names=["key", "token"])

    return run


def profiles(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """key, n, tokens, dfs of nodes(key, n, text): the tokens that several nodes have, rarest first, if they are enough for a partner of any size."""
    tokens = written(nodes.select("key", "text").mapInArrow(_node_tokens(k), "key long, token long"), "tokens")
    dfs = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = join_hot(tokens, dfs, "token", "df", tokens.count())
    shared = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).select("key", F.col("t.token").alias("tokens"), F.col("t.df").alias("dfs"))
    return written(nodes.select("key", "n").join(shared, "key").where(F.size("tokens") * 100 >= F.col("n") * percent), "profiles")


def class_bounds(percent: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of the size classes: FINE of them from a size to the least that can be too large for it."""
    out, x, step = [1], 1.0, max(1.01, (100 / percent) ** (1 / FINE))
    while out[-1] < most:
        x = max(x * step, out[-1] + 1)
        out.append(int(x))
    return out


def needed(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m tokens that are alike."""
    return -(-percent * (n + m) // (100 + percent))


def signatures(tokens: np.ndarray, freq: np.ndarray, n: int, percent: int, bounds: list[int], frequent: tuple[int, ...] = FREQUENT) -> list[tuple[int, int]]:
    """(signature, most) of a set of n tokens, of which ``tokens`` are in several sets (``freq`` of them): hashes of the token
    combinations of its prefixes, one prefix for each size class that a partner can be of. ``most``: of a pair that is alike, one
    common signature at least doesn't have a lesser ``most`` than the intersection.
    """
    order = np.lexsort((tokens, freq))
    tokens, freq = tokens[order], freq[order]
    c, missing = len(tokens), n - len(tokens)
    least, largest = -(-n * percent // 100), c * (100 + percent) // percent - n
    if largest < least:
        return []
    kind = np.searchsorted(frequent, freq, side="left") + 1
    alone = int(np.searchsorted(kind, 1, side="right"))
    own = bisect_right(bounds, n) - 1
    singles, combined = 0, {}
    for other in range(bisect_right(bounds, least) - 1, bisect_right(bounds, largest)):
        need = n - needed(n, max(least, bounds[other]), percent) + 1 - missing
        if need <= 0:
            continue
        smallest = bounds[min(own, other)]
        if smallest < SMALL:
            singles = max(singles, need)
            continue
        singles = max(singles, min(need, alone))
        if need <= alone:
            continue
        parts, gained = max(1, smallest // 12), alone
        pair = (min(own, other) << 20) + max(own, other) + 1
        groups: dict[tuple[int, int], list[int]] = {}
        for x, together in zip(tokens[alone:].tolist(), kind[alone:].tolist(), strict=True):
            group = groups.setdefault((together, (x >> 8) % parts), [])
            group.append(x)
            gained += len(group) >= together
            if gained >= need:
                break
        for (together, _), group in groups.items():
            for some in combinations(sorted(group), together):
                h = pair
                for x in some:
                    h = (h * BASE + x) & 0xFFFFFFFFFFFFFFFF
                combined[h] = c
    # of single tokens, the first that both have has no common one before it
    out = list(zip(mix(tokens[:singles]).view(np.int64).tolist(), range(c, c - singles, -1), strict=True)) if singles else []
    if combined:
        out += [(x, c) for x in mix(np.array(list(combined), np.uint64)).view(np.int64).tolist()]
    return out


def _signed(percent: int, frequent: tuple[int, ...]):
    """key, n, token, df, a row a token, those of a key together -> sig, key, n, most."""
    names = ("key", "n", "token", "df")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = class_bounds(percent)
        rest = [np.empty(0, np.int64)] * 4

        def signed(cols: list[np.ndarray]) -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            for key, n, token, df in zip(*(np.split(x, cuts) for x in cols), strict=True):
                if len(key):
                    out += [(sig, int(key[0]), int(n[0]), most) for sig, most in signatures(token.view(np.uint64), df, int(n[0]), percent, bounds, frequent)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], names=["sig", "key", "n", "most"])

        for batch in it:
            cols = [np.concatenate([r, batch.column(x).to_numpy(zero_copy_only=False)]) for r, x in zip(rest, names, strict=True)]
            ends = np.flatnonzero(np.diff(cols[0]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            rest = [x[whole:] for x in cols]
            if whole:
                yield signed([x[:whole] for x in cols])
        yield signed(rest)

    return run


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of left with right(key, size, ...), where size says how many of left's ``total`` rows have the key.

    Keys of more than a HOT-th of all rows are at most HOT, so they are broadcast and their rows stay where they are.
    """
    limit = max(MANY, total // HOT)
    hot = right.where(F.col(size) > limit)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(size) <= limit), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def side_by_side(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs(a, b) of nodes, with a_n, a_tokens, b_n and b_tokens of their profiles.

    The profile of a node in more than a HOT-th of all pairs is sent to several tasks, and its pairs are dealt over them.
    """
    limit = max(MANY, pairs.count() // HOT)
    both = pairs
    for side, other in (("b", "a"), ("a", "b")):
        often = pairs.groupBy(side).agg(F.count("*").alias("often")).where(F.col("often") > limit)
        hot = F.broadcast(often.select(side, F.expr(f"int(often div {limit})").alias("salts")))
        both = both.join(hot, side, "left").withColumn("salt", F.expr(f"int(pmod(xxhash64({other}), coalesce(salts, 0) + 1))")).drop("salts")
        copies = found.select(F.col("key").alias(side), F.col("n").alias(f"{side}_n"), F.col("tokens").alias(f"{side}_tokens")).join(hot, side, "left")
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(0))))).drop("salts")
        both = both.join(copies, [side, "salt"]).drop("salt")
    return both


def _needed(percent: int, n: str, m: str) -> str:
    """SQL of needed()."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _may_be(percent: int, n: str, most: str, m: str, other: str) -> str:
    """SQL: sets of n and m tokens whose intersection is bounded can be alike."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({most}, {other}) >= {_needed(percent, n, m)}"


def beside_leaders(led: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among nodes compared with one leader, which may be alike though the leader has too little of one.

    led(leader, lroot, least, key, root, n, common, outside): of each node compared, its tokens that the leader has (how many)
    and hasn't (which). If x lacks d of the common tokens it needs even with all the leader has of it, its partner must share d
    of x's tokens outside the leader: one of them is among all but the last d - 1 of these, rarest first.
    """
    lacks = f"greatest(1, {_needed(percent, 'n', 'least')} - common)"
    mine = led.where("root <> lroot").select("leader", "key", "n", "common", "root", F.size("outside").alias("s"), F.explode(F.expr(f"slice(outside, 1, greatest(0, size(outside) - {lacks} + 1))")).alias("token"))
    theirs = led.select("leader", F.col("key").alias("o_key"), F.col("n").alias("o_n"), F.col("common").alias("o_common"), F.col("root").alias("o_root"), F.size("outside").alias("o_s"), F.explode("outside").alias("token"))
    need = _needed(percent, "n", "o_n")
    met = mine.join(theirs, ["leader", "token"]).where(f"root <> o_root and common < {need} and least(common, o_common) + least(s, o_s) >= {need} and 100 * least(n, o_n) >= {percent} * greatest(n, o_n)")
    return met.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b")).distinct()


def beside_lists(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one list that beside_leaders() doesn't judge, as the leader has enough of both for a partner of that size.

    placed(sig, leader, lroot, least, key, root, n, most, common): a list's members but the leader. Of two members of
    different components one isn't of the leader's, so only those others go through the list, in lots of about SLICE members.
    """
    others = written(placed.where(f"root <> lroot and common >= {_needed(percent, 'n', 'least')}"), "others")
    sizes = placed.groupBy("sig").agg(F.count("*").alias("c"))
    others = others.join(sizes, "sig").where("c > 1")
    reach = F.max(F.expr(f"common * {100 + percent} div {percent} - n"))  # the largest partner that the leader has enough for
    lists = others.groupBy("sig").agg(F.expr(f"int(max(c) div {SLICE})").alias("more"), reach.alias("reach"))
    members = placed.join(lists, "sig").where("n <= reach")
    lots = members.groupBy("sig", F.pmod(F.xxhash64("key"), F.col("more") + 1).alias("lot")).agg(F.collect_list(F.struct("key", "n", "most", "root", "common")).alias("members"))
    need = _needed(percent, "n", "o.n")
    elsewhere = f"common < {need} or o.root <> lroot and o.common < {need}"
    fits = f"o.root <> root and (o.root = lroot or o.key > key) and {_may_be(percent, 'n', 'most', 'o.n', 'o.most')} and not ({elsewhere})"
    met = others.join(lots, "sig").select("key", "lot", F.expr(f"transform(filter(members, o -> {fits}), o -> o.key)").alias("partners")).where(F.size("partners") > 0)
    met = met.groupBy("key", "lot").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")).select("key", F.explode("partners").alias("partner"))
    return met.select(F.least("key", "partner").alias("a"), F.greatest("key", "partner").alias("b")).distinct()


def links(nodes: DataFrame, k: int, percent: int, frequent: tuple[int, ...] = FREQUENT) -> DataFrame:
    """node, root of the components of nodes(key, n, text) that have links."""
    found = profiles(nodes, k, percent)
    each = found.select("key", "n", F.explode(F.arrays_zip("tokens", "dfs")).alias("t")).select("key", "n", F.col("t.tokens").alias("token"), F.col("t.dfs").alias("df"))
    sigs = written(each.mapInArrow(_signed(percent, frequent), "sig long, key long, n long, most long"), "signatures")
    total = sigs.count()

    # A list's leader lacks the fewest tokens of others, so that the most are alike to it
    rank = F.xxhash64("key", F.pmod("sig", F.lit(LEADERS)))
    first = F.min(F.struct((F.col("n") - F.col("most")).alias("lack"), rank.alias("rank"), F.col("key").alias("leader")))
    leaders = written(sigs.groupBy("sig").agg(first.alias("l"), F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1").select("sig", "c", "least", "l.leader"), "leaders")
    # who can't have a partner of even the list's least size leaves it
    members = join_hot(sigs, leaders, "sig", "c", total).where(f"key <> leader and most >= {_needed(percent, 'n', 'least')}")
    members = written(members.select("sig", "key", "n", "most", "leader", "least"), "members")
    pairs = written(members.select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    compared = written(
        side_by_side(pairs, found).select(F.col("a").alias("key"), F.col("b").alias("leader"), F.col("a_n").alias("n"), F.col("b_n").alias("m"), F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common"), F.array_except("a_tokens", "b_tokens").alias("outside")),
        "compared",
    )
    roots = written(components(compared.where(f"common >= {_needed(percent, 'n', 'm')}").select(F.col("key").alias("a"), F.col("leader").alias("b"))), "roots")

    root_of = lambda node, name: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    heads = compared.groupBy("leader").agg(F.min("n").alias("least"), F.count("*").alias("c")).join(root_of("leader", "lroot"), "leader", "left").withColumn("lroot", F.coalesce("lroot", "leader"))
    led = compared.join(root_of("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    led = written(join_hot(led, heads, "leader", "c", compared.count()), "led")
    placed = members.join(led.select("key", "leader", "root", "lroot", "common"), ["key", "leader"])
    crossing = beside_leaders(led, percent).unionByName(beside_lists(written(placed, "placed"), percent)).distinct()
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = crossing.join(known, ["a", "b"], "left_anti")
    late = side_by_side(written(crossing, "crossing"), found).where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.expr(_needed(percent, "a_n", "b_n"))).select("a", "b")
    late = written(late, "edges")
    if late.isEmpty():
        return roots
    # late edges, and each node's tie to its root, are one more graph
    return components(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, fraction: float = COUNTED, frequent: tuple[int, ...] = FREQUENT) -> DataFrame:
    """docs(doc_id, text) -> a row each: doc_id, text_hash, n_shingles, root and component_id.

    root tells components apart where a component_id (the smallest doc_id reachable by links) is that of several; it
    means nothing without shingles. text_hash is xxhash64 of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sized = written(docs.mapInArrow(_sized(k), "doc_id long, text_hash long, key long, n long"), "sized")
    nodes = written(possible_nodes(docs, sized, k, percent, fraction), "nodes")
    nodes = written(still_possible(nodes, k, percent), "nodes")
    roots = links(nodes, k, percent, frequent)
    ids = F.coalesce("doc_id", F.lit(blocks.NO_ID))
    keys = sized.where("n > 0").groupBy("key").agg(F.min(ids).alias("id"))
    placed = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component"))
    of_key = placed.join(least, "root").select("key", "root", "component")
    found = sized.join(of_key, "key", "left")
    component = F.when(F.col("n") == 0, ids).otherwise(F.col("component"))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", F.nullif(component, F.lit(blocks.NO_ID)).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, fraction: float = COUNTED, frequent: tuple[int, ...] = FREQUENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    return classes(docs, k, percent, fraction, frequent).select("doc_id", "n_shingles", "component_id")
