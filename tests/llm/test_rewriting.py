"""Rewriting for infilling, the Merkle manifest and byte-level BPE against plain versions, round trips and the dealt library."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from random import Random

import numpy as np
import pytest

from panelspark.llm import bpe, infill, merkle
from panelspark.llm.queries import QUERIES
from tests.llm import brute, fixtures
from tests.llm.test_contract import SUPPLIED, empty, odd, ordered, place, table  # noqa: F401

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def infilled(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)"""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, brute.sha(text), brute.sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), brute.sha(out), brute.sha(text)


INFILL = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_infill(spark, place):  # noqa: F811
    got = [tuple(r) for r in QUERIES["op11_infill"](spark, place).select(*INFILL).collect()]
    assert ordered(got) == ordered(infilled(*d) for d in table(place, "documents", "doc_id", "text"))


def test_infill_of_marks_and_long_texts(spark, tmp_path):
    r = Random(2)
    some = ["<P>", "a<S>b", "<M", "<", "x<P", "S>y<", "<<S", "é1" * 70_000, "ab" * 400_000, "a" * 99_999 + "漢" * 50_001, "\U0001f600" * 3, "\x00\n\r\n"]
    some += ["".join(r.choice(["a", "Z", "é", "漢", "<", ">", "P", "S", "M", "1", " "]) for _ in range(r.randrange(60))) for _ in range(400)]
    fixtures.documents(str(tmp_path), list(enumerate(some)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for chunk in (1, 3, 64, infill.CHUNK):
        found = infill.digest(infill.rewrite(docs, chunk=chunk)).select(*INFILL)
        assert ordered(tuple(x) for x in found.collect()) == ordered(infilled(i, t) for i, t in enumerate(some))
    found = infill.rewrite(docs, rewritten=100, suffix_first=50)
    rows = found.withColumn("back", infill.restored(found.output, found.form)).collect()
    assert all(x.back == some[x.doc_id] for x in rows) and {x.form for x in rows} == {"plain", "psm", "spm"}
    assert {x.doc_id for x in rows if x.form == "plain"} == {i for i, t in enumerate(some) if not t or any(m in t for m in ("<P>", "<S>", "<M>"))}


def test_every_cut_of_chunks():
    r = Random(3)
    texts = ["", *("".join(r.choice(["a", "b", "é", "漢", " "]) for _ in range(r.randrange(40))) for _ in range(60)), ""]
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    for size in (1, 2, 5, 100):
        chunks = infill.Chunks(np.frombuffer(b"".join(data), np.uint8), bounds, size)
        for i, text in enumerate(texts):
            units = UNIT.findall(text)
            assert chunks.counts(i) == (len(units), len(text))
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert chunks.cut(i, k) == (len(before.encode()), len(before))


def sha(*parts: str) -> str:
    return brute.sha("".join(parts))


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str], arity: int):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), each level in full."""
    low = lambda x: (x is not None, x)
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = []
    for name in names:
        members = sorted(groups[name], key=lambda x: (low(x[0]), leaf_of(x)))
        trees.append((members, climb([leaf_of(x) for x in members], arity)))
    top = climb([levels[-1][0] for _, levels in trees], arity)
    out = []
    for g, (members, levels) in enumerate(trees):
        for i, row in enumerate(members):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, proof = leaf_of(row, 1 if changed else 0), []
            for at, tree in ((i, levels), (g, top)):
                for nodes in tree[:-1]:
                    first = at // arity * arity
                    run = nodes[first : first + arity]
                    proof += [x for k, x in enumerate(run) if first + k != at]
                    run[at - first] = node
                    node, at = sha(*run), at // arity
            out.append((row[0], levels[0][i], levels[-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]))
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(spark, place):  # noqa: F811
    got = [tuple(r) for r in QUERIES["op12_manifest"](spark, place).select(*MANIFEST).collect()]
    assert ordered(got) == ordered(manifest(table(place, "documents", "doc_id", "source", "lang", "n_chars", "text")))


@pytest.mark.parametrize("arity, depth", [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_over_many_supersteps(spark, tmp_path, arity, depth):
    """Groups of every size up to a few vertices, many groups, repeated and null ids, null groups."""
    r = Random(4)
    rows = [(i, f"t{i}", f"g{g}") for g in range(40) for i in range(g + 1)] + [(None, f"n{r.randrange(9)}", None) for _ in range(70)] + [(5, "same", "g9")] * 30
    fixtures.documents(str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in merkle.verify(merkle.manifest(docs, claim=merkle.tampered(), arity=arity, depth=depth), arity).select(*MANIFEST).collect()]
    assert ordered(got) == ordered(manifest(table(str(tmp_path), "documents", "doc_id", "source", "lang", "n_chars", "text"), arity))


def test_manifest_of_one_row_and_a_lost_child(spark, tmp_path):
    fixtures.documents(str(tmp_path), [(1, "x", "en")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (row,) = merkle.verify(merkle.manifest(docs)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == brute.sha("")
    messages = spark.sparkContext.parallelize([((0, 0), (0, 5, b"x" * 32 * 4))])
    with pytest.raises(Exception, match="of its children"):
        merkle.Tree(messages, 5, 2, 3, 2).subroots().collect()


def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load().vocabulary.ranks
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe(spark, place):  # noqa: F811
    encode = library()
    want = []
    for d, text in table(place, "documents", "doc_id", "text"):
        ids = encode(text or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(text or "")))
    got = [tuple(r) for r in QUERIES["op13_bpe"](spark, place).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert ordered(got) == ordered(want)


ALPHABET = ["a", "b", "e", "th", "  ", "\n", "\t", "é", "ü", "漢", "1", "23", ".", "'s", "'", "-", " ", "ing", "tion", "A", "　", "\U0001f600", "==", "<|endoftext|>", "\x00", "\x1c"]


def test_bpe_of_random_texts():
    encode, ours = library(), bpe.load()
    r = Random(6)
    for k in range(20_000):
        some = "".join(r.choice(ALPHABET if k % 3 else "eatinorsl") for _ in range(r.randrange(1, 40)))
        ids = list(ours.encode(some))
        assert ids == encode(some)
        assert ours.decode(ids) == some.encode()


def test_bpe_of_long_runs():
    """In time in proportion to the length."""
    from time import time

    encode, ours = library(), bpe.load()
    began = time()
    for c in ("\n", " ", "a", "-", "ab", "é", "1", "　", "\r\n", "x="):
        some = f"a{c * (100_000 // len(c))}b"
        assert list(ours.encode(some)) == encode(some)
    assert len(ours.encode("a" + "\n" * 2_000_000 + "b")) > 2  # where the library gives up
    assert time() - began < 60


def test_every_character_is_classed_as_the_library_does():
    encode, ours = library(), bpe.load()
    for first in range(0, 0x110000, 512):
        some = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} " for c in range(first, first + 512) if not 0xD800 <= c < 0xE000)
        assert list(ours.encode(some)) == encode(some), hex(first)


def test_prefix_tables_follow_appends_and_edits():
    """Every prefix's encoding, and tables after appends and edits, are those found from nothing."""
    v = bpe.load().vocabulary
    r = Random(7)
    for _ in range(300):
        data = bytes(r.choice(b"eatinorsl -=\n\xc3\xa9") for _ in range(r.randrange(80)))
        whole = bpe.Prefixes(v, data)
        for n in {0, len(data) // 2, len(data)}:
            assert whole.ids(n) == bpe.Prefixes(v, data[:n]).ids()
        grown, at = bpe.Prefixes(v), 0
        while at < len(data):
            n = r.randrange(1, 12)
            grown.append(data[at : at + n])
            at += n
        assert grown.last == whole.last
        a = r.randrange(len(data) + 1)
        b = r.randrange(a, len(data) + 1)
        new = bytes(r.choice(b"eatinorsl -") for _ in range(r.randrange(6)))
        whole.replace(a, b, new)
        fresh = bpe.Prefixes(v, data[:a] + new + data[b:])
        assert (whole.last, whole.data) == (fresh.last, fresh.data)
    long = bpe.Prefixes(v, bytes(r.choice(b"eatinorsl") for _ in range(50_000)))
    assert long.replace(20_000, 20_003, b"xyz") < 5_000
    assert long.last == bpe.Prefixes(v, bytes(long.data)).last


def test_texts_follow_edits():
    encode, ours = library(), bpe.load()
    r = Random(8)
    for _ in range(300):
        some = bpe.Encoded(ours, "".join(r.choice(ALPHABET) for _ in range(r.randrange(40))))
        for _ in range(6):
            a = r.randrange(len(some.text) + 1)
            b = min(len(some.text), a + r.randrange(8))
            some.replace(a, b, "".join(r.choice(ALPHABET) for _ in range(r.randrange(4))))
            assert some.all_ids() == encode(some.text), repr(some.text)
        some.append("ing  \n x")
        assert some.all_ids() == encode(some.text)
    long = bpe.Encoded(ours, "some words of a text " * 5_000)
    assert long.replace(50_000, 50_004, "other") < 20
    assert long.all_ids() == encode(long.text)


@pytest.mark.parametrize("name", ["op11_infill", "op12_manifest"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from panelspark.llm.queries import ORACLES

    if not os.path.isdir(SUPPLIED):
        pytest.skip("no supplied tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SUPPLIED}/documents.parquet')")
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    df = QUERIES[name](spark, SUPPLIED)
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered(tuple(r[i] for i in at) for r in want.fetchall()) == ordered(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
