"""Rows read from lines, fragments, lines below and columns, against plain loops and documents with what is to come of them."""

from __future__ import annotations

import re
from random import Random

import pytest

from panelspark.functions import lexicons as L
from panelspark.operators import stitch

LINES = "doc_id long, line_no long, page int, y int, x_left int, x_right int, text string, role string"
UNITS = set(L.GUARD_UNITS)


def read(text):
    """(name, value, units, range, flag) of one line."""
    text = text.strip()
    name = value = units = span = None
    if m := re.match(stitch.NUMERIC_RESULT, text):
        name, value, units, span = (x.strip() or None if x else None for x in m.groups())
    elif m := re.match(stitch.TEXT_RESULT, text):
        name, value, span = (x.strip() or None for x in m.groups())
    if not span and (m := re.search(stitch.RANGE_IN_ROW, text)):
        span = m[0]
    m = re.search(stitch.FLAG_IN_ROW, text)
    return [name, value, units, span, m[0].upper() if m else None]


def complete(fields):
    name, value, units, span, flag = fields
    return (0.3 if name or value else 0.0) + (0.3 if value else 0.0) + (0.2 if units else 0.0) + (0.1 if span else 0.0) + (0.1 if flag else 0.0)


def best_reading(near):
    """(confidence, fields, text) of the best of the groups of neighbours (line_no, y, x_left, x_right, text), or None."""
    groups = []
    for x in near:
        if groups and abs(groups[-1][-1][1] - x[1]) <= 6:
            groups[-1].append(x)
        else:
            groups.append([x])
    best = None
    for group in groups:
        group = sorted(group, key=lambda x: (x[2], x[0]))
        if len(group) < 2 or any(b[2] - a[3] > 28 for a, b in zip(group, group[1:])):
            continue
        parts = [(x[4].strip(), x[2], x[3]) for x in group if x[4].strip()]
        if len(parts) < 2:
            continue
        used, got, sure = {}, {}, 0.0

        def take(what, test):
            for i, p in enumerate(parts):
                if i not in used and test(p[0]):
                    used[i], got[what] = what, p[0]
                    return i
            return None

        behind = None
        if (i := take("value", lambda t: re.match(stitch.VALUE_FRAGMENT, t))) is not None:
            m = re.match(stitch.VALUE_FRAGMENT, parts[i][0])
            got["value"], behind = m[1], m[2] or None
            sure += 0.2
            if behind:
                sure += 0.1
        if take("units", lambda t: t in UNITS) is not None:
            sure += 0.2
        if take("range", lambda t: re.search(stitch.RANGE_FRAGMENT, t)) is not None:
            sure += 0.2
        if not behind and take("flag", lambda t: t in stitch.FLAG_FRAGMENTS) is not None:
            sure += 0.1
        if take("name", lambda t: re.search("[a-zA-Z]", t) and not re.search("[0-9]", t)) is None:
            take("name", lambda t: True)
        if len(used) >= 2:
            at = [parts[i] for i in sorted(used)]
            gap = sum(b[1] - a[2] for a, b in zip(at, at[1:])) / (len(at) - 1)
            sure += 0.3 if gap <= 28 else 0.2 if gap <= 50 else 0.1 if gap <= 100 else 0.0
        if (got.get("value") or got.get("name")) and sure > (best[0] if best else 0.0):
            best = (min(sure, 1.0), [got.get("name"), got.get("value"), got.get("units"), got.get("range"), behind or got.get("flag")], " ".join(x[4] for x in group if x[4]))
    return best


def read_document(lines):
    """line_no: (fields, text, stitched) of one document's result rows."""
    out = {}
    for no, page, y, _, _, text, role in lines:
        if role != "TEST_ROW":
            continue
        fields, shown, again = read(text), text, None
        if complete(fields) < 0.5:
            near = [(n, yy, a, b, t) for n, p, yy, a, b, t, r in lines if abs(n - no) <= 5 and p == page and (abs(yy - y) <= 6 or r == "TEST_ROW")]
            again = best_reading(near)
            if again and again[0] > complete(fields):
                fields, shown = [b or a for a, b in zip(fields, again[1])], again[2]
            else:
                again = None
        out[no] = (fields, shown, bool(again))
    return out


def merge(rows):
    """Rows [line_no, page, y, text, fields] of a panel in order; what is left, with the line that was used."""
    gone, used = set(), {}
    for i, (_, page, y, _, f) in enumerate(rows):
        name, value, units, span, _ = f
        if i in gone or not value or (units and span):
            continue
        label = (name or "").endswith(":") and any(t in name for t in L.HEADER_TERMS)
        if label or (not re.search("[0-9]", value) and units not in UNITS):
            continue
        for j in range(i + 1, min(i + 3, len(rows))):
            if j in gone:
                continue
            if rows[j][1] != page or abs(rows[j][2] - y) >= 60:
                break
            text = rows[j][3]
            unit = next((w for w in text.split() if w in UNITS), None) if not units else None
            found = next((m[0] for p in stitch.RANGES_BELOW if (m := re.search(p, text))), None) if not span else None
            if unit or found:
                f[2], f[3] = unit or units, found or span
                rest = text.strip()
                for piece in (unit, found):
                    rest = rest.replace(piece, "").strip() if piece else rest
                if len(re.sub(r"[^\w]", "", rest)) <= 2:
                    gone.add(j)
                used[i] = rows[j][0]
                break
    return [(r[0], *r[4], used.get(i)) for i, r in enumerate(rows) if i not in gone]


def random_lines(seed, n):
    r = Random(seed)
    words = ["Glucose", "TSH", "mg/dL", "%", "5", "12.5 H", "3.1", "70-99", "0.4 - 4.5", "H", "*", "x", "Client: 5", "ALT 30", "ALT 30 U/L", "WBC 7.2 K/uL 4.5-11.0", "x 5 %", "Rapid test NEGATIVE", "HIGH", "<200", "≤4", "", " ", "fine words", "Specimen ID: 9 :", "ok 3-4", "Phone: 12 mg/dL"]
    out, y, page = [], 50, 1
    for no in range(1, n + 1):
        y += r.choice([0, 0, 2, 6, 7, 20, 59, 60])
        if y > 900:
            page, y = page + 1, 50
        left = r.choice([60, 90, 120, 150, 180, 400])
        out.append((no, page, y, left, left + r.choice([10, 20, 28]), " ".join(r.choices(words, k=r.choice([1, 1, 1, 2]))), r.choice(["TEST_ROW"] * 5 + ["COMMENT", "SECTION_PANEL"])))
    return out


@pytest.fixture(scope="module")
def documents(spark):
    docs = {d: random_lines(d, n) for d, n in enumerate([0, 1, 2, 40, 80, 120, 300])}
    df = spark.createDataFrame([(d, *line[:3], *line[3:]) for d, lines in docs.items() for line in lines], LINES)
    return docs, df.cache()


def test_rows_against_plain_loop(documents):
    docs, df = documents
    want = {(d, no): x for d, lines in docs.items() for no, x in read_document(lines).items()}
    got = {(r.doc_id, r.line_no): ([r[f] for f in stitch.FIELDS], r.text, r.is_stitched) for r in stitch.read_rows(df).collect()}
    assert got == want
    assert sum(x[2] for x in want.values()) > 20


def test_merges_against_plain_loop(documents):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    docs, df = documents
    want = set()
    for d, lines in docs.items():
        rows, panels, panel = read_document(lines), {}, 0
        for no, page, y, _, _, _, role in lines:
            panel += role == "SECTION_PANEL"
            if no in rows:
                panels.setdefault(panel, []).append([no, page, y, rows[no][1], list(rows[no][0])])
        want |= {(d, p, *row) for p, members in panels.items() for row in merge(members)}
    number = F.sum(F.when(F.col("role") == "SECTION_PANEL", 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("line_no"))
    merged = stitch.merged_below(stitch.read_rows(df.withColumn("panel_no", number)))
    got = {(r.doc_id, r.panel_no, r.line_no, *(r[f] for f in stitch.FIELDS), r.merged_from) for r in merged.collect()}
    assert got == want
    assert sum(x[-1] is not None for x in want) > 10


def test_chain_of_rows_that_use_each_other_up(spark):
    """Each row could use up the next, so every other one goes."""
    lines = [(1, i, 1, 10 * i, 60, 90, "x 5 %" if i < 9 else "x 5 mg/dL 1-2", "TEST_ROW") for i in range(1, 10)]
    lines = [(1, 1, 1, 10, 60, 90, "Glucose 5", "TEST_ROW"), *((1, i, 1, 10 * i, 60, 90, f"x {i} %", "TEST_ROW") for i in range(2, 9))]
    from pyspark.sql import functions as F

    rows = stitch.read_rows(spark.createDataFrame(lines, LINES)).withColumn("panel_no", F.lit(0).cast("long"))
    left = {r.line_no: (r.units, r.merged_from) for r in stitch.merged_below(rows).collect()}
    plain = merge([[i, 1, 10 * i, t, read(t)] for _, i, _, _, _, _, t, _ in lines])
    assert left == {x[0]: (x[3], x[-1]) for x in plain}
    assert len(left) < len(lines)


@pytest.mark.parametrize("unit_x, taken", [(None, "g/dL"), (200, "mg/dL")])
def test_columns(spark, unit_x, taken):
    """Without lone units elsewhere the median is that of the row's own neighbours; a fixed window only without any."""
    lines = [(1, 1, 1, 100, 60, 90, "Glucose 95", "TEST_ROW"), (1, 2, 1, 102, 380, 400, "g/dL", "COMMENT"), (1, 3, 1, 101, 470, 490, "70 - 99", "COMMENT")]
    if unit_x:
        lines += [(1, 4, 1, 103, unit_x, unit_x + 20, "mg/dL", "COMMENT"), *((1, i, 1, 300 + i * 40, unit_x, unit_x + 20, "%", "COMMENT") for i in range(5, 9))]
    df = spark.createDataFrame(lines, LINES)
    (row,) = stitch.filled_from_columns(stitch.read_rows(df), df).where("line_no = 1").collect()
    assert (row.units, row.reference_range, row.filled) == (taken, "70 - 99", "units,reference_range")


def golden(*lines):
    """Rows of the composer from (text, role, page, height in hundredths from the top)."""
    return [(1, i, page, y * 10, 10, 90, text, role, role == "SECTION_PANEL", 14 if role == "SECTION_PANEL" else 10) for i, (text, role, page, y) in enumerate(lines, 1)]


T, S, M = "TEST_ROW", "SECTION_PANEL", "PAGE_HEADER"
REPORT = golden(
    ("PAGE_HEADER Lab Results Report", M, 1, 10), ("CHEMISTRY PANEL", S, 1, 20), ("Glucose 95 mg/dL 70-100", T, 1, 30), ("Sodium 140 mEq/L 136-145", T, 1, 40), ("Potassium 4.2 mEq/L 3.5-5.1", T, 1, 50),
    ("PAGE_HEADER Lab Results Report", M, 2, 10), ("Chloride 101 mEq/L 98-107", T, 2, 20), ("BUN 18", T, 2, 30), ("mg/dL 7-20", T, 2, 33),
    *((f"{name} 3 g/dL 1-5", T, 2, 40 + 7 * i) for i, name in enumerate(("Albumin", "Globulin", "Calcium", "Protein", "Urea"))),
    ("LIPID PANEL", S, 2, 78), ("Total Cholesterol 185 mg/dL <200", T, 2, 82), ("LDL Cholesterol 110 mg/dL <100 HIGH", T, 2, 90),
    ("CBC WITH DIFFERENTIAL", S, 3, 20), ("WBC 7.2 K/uL 4.5-11.0", T, 3, 30), ("Hemoglobin 14.2 g/dL 14.0-18.0", T, 3, 50),
)


def test_report_from_lines_to_scores(spark):
    rows = spark.createDataFrame(REPORT, "doc_id long, row_no long, page int, y int, x_left int, x_right int, text string, role string, is_bold boolean, font int")
    full, panels = stitch.composed_results(rows)
    got = {}
    for r in sorted(full.collect(), key=lambda r: r.line_no):
        got.setdefault(r.panel_name, []).append((r.test_name, r.result_value, r.units, r.reference_range, r.merged_from))
        assert 0 < r.confidence <= 1
    assert got == {
        "CHEMISTRY": [("Glucose", "95", "mg/dL", "70-100", None), ("Sodium", "140", "mEq/L", "136-145", None), ("Potassium", "4.2", "mEq/L", "3.5-5.1", None), ("Chloride", "101", "mEq/L", "98-107", None), ("BUN", "18", "mg/dL", "7-20", 9), *((n, "3", "g/dL", "1-5", None) for n in ("Albumin", "Globulin", "Calcium", "Protein", "Urea"))],
        "LIPID": [("Total Cholesterol", "185", "mg/dL", "<200", None), ("LDL Cholesterol", "110", "mg/dL", "<100 HIGH", None)],
        "CBC WITH DIFFERENTIAL": [("WBC", "7.2", "K/uL", "4.5-11.0", None), ("Hemoglobin", "14.2", "g/dL", "14.0-18.0", None)],
    }
    assert {(p.panel_name, p.n_tests) for p in panels.collect()} == {("CHEMISTRY", 10), ("LIPID", 2), ("CBC WITH DIFFERENTIAL", 2)}


def test_empty(spark):
    df = spark.createDataFrame([], LINES)
    assert stitch.read_rows(df).collect() == []


def test_neighbours_and_columns_are_found_without_joins(spark, tmp_path):
    """Lines that lie with their document are shuffled once, as items, whatever is read from them."""
    from panelspark.plans import stitching

    spark.range(40).selectExpr("id % 9 l_orderkey", "id l_partkey", "id l_suppkey", "cast(id as int) l_linenumber", "1d l_quantity", "1d l_extendedprice", "0d l_discount", "0d l_tax", "'R' l_returnflag", "'O' l_linestatus", "now() l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("rows_read", "split_rows_merged", "split_row_reasons", "column_fills", "stitched_fields"):
        plan = stitching.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan, name
        assert plan.count("Exchange") == 1, name
