"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

from random import Random

import pyarrow as pa
import pyarrow.parquet as pq


def words(r: Random, n: int, of: int = 400) -> list[str]:
    return [f"w{r.randrange(of)}" for _ in range(n)]


def texts(seed: int = 5) -> list[str | None]:
    """Random, near and exact copies around the threshold, shared passages, odd and long ones."""
    r = Random(seed)
    out: list[str | None] = [None, "", "   ", "one", "One", "two words", "a b c d", "a b c d e", "A b C d e"]
    for _ in range(25):
        base = words(r, r.randrange(5, 220))
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            near = list(base)
            for _ in range(r.randrange(1 + len(near) // 18)):
                near[r.randrange(len(near))] = r.choice(["x", "y", "Z9"])
            out.append(" ".join(near))
    passage = words(r, 60)
    for _ in range(12):
        some = words(r, r.randrange(10, 60))
        at = r.randrange(len(some))
        out.append(" ".join([*some[:at], *passage[r.randrange(20) : r.randrange(30, 60)], *some[at:]]))
    out.append(" ".join(words(r, 30_000, 5000)))
    out.append("x" * 300_000)
    out.append("la " * 5000)
    out += [" ".join(words(r, 40))] * 5
    out.append("É dé 漢字 ok mail: a.b@c-d.org, +1 (743) 555-3824; 10.0.0.255 999.1.1.1 4111 1111 1111 1111 user@@x.y a@b.c@d.ef \x00 z")
    return out


def documents(path: str, rows: list[tuple], extra: bool = True) -> None:
    n = len(rows)
    table = {"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": pa.array([x[1] for x in rows], pa.string()), "lang": pa.array([x[2] if len(x) > 2 else None for x in rows], pa.string()), "source": pa.array([None if i % 3 else "web" for i in range(n)], pa.string()), "n_chars": pa.array([None if x[1] is None else len(x[1]) for x in rows], pa.int64())}
    if extra:
        for name in ("key", "n", "bucket", "sig", "row", "length", "component_id", "items", "spans"):
            table[name] = pa.array([i for i in range(n)], pa.int64())
    pq.write_table(pa.table(table), f"{path}/documents.parquet")


def write(path: str, table: str, schema: pa.Schema, rows: list[tuple]) -> None:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    pq.write_table(pa.table([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema), f"{path}/{table}.parquet")


BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def tables(path: str, full: bool) -> str:
    """All tables: with odd rows if ``full``, else empty."""
    some = texts() if full else []
    rows = [(i * 7 % 1000 if i else None, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(some)]
    documents(path, rows)
    items = [(1, some[60]), (2, None), (3, ""), (10, "A B c"), (11, "a-b-c"), (None, "one two three"), (12, some[-8])] if full else []
    write(path, "benchmark", BENCHMARK, items)
    write(path, "labels", LABELS, [(d, i % 2, None if i == 5 else int(i % 9 == 0)) for i, (d, _, _) in enumerate(rows)] + ([(7, 1, 1)] if full else []))
    pages = ["", None, "<p>no end", "plain text", "<html><body><nav><a href=x>Home</a><a href=y>About</a></nav><article><h1>On rivers</h1><p>A river is a natural stream of fresh water that flows on land &amp; ends in a sea.</p><p>Some rivers   flow\n into lakes, and others run dry before they reach any water at all.</p></article><footer>Copyright, all rights reserved</footer></body></html>"]
    write(path, "pages", PAGES, [(i if i != 1 else None, None if i == 2 else f"http://h/{i}", p) for i, p in enumerate(pages)] if full else [])
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ \\! <s> ok"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 1, "tool", "a > b"), (3, None, None, "x"), (None, 1, "system", "<<SYS>>"), (4, 0, "user", "\n[INST]  [/INST] </turn> <turn "), (5, 0, "assistant", "")]
    write(path, "conversations", TURNS, turns if full else [])
    return path
