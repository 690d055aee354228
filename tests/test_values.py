"""Normalisers, predicates, and correction patches on typed-out vectors."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions import predicates as P
from panelspark.functions import text as T
from panelspark.operators import corrections, labels


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_dates(spark):
    vectors = {"01/15/2024": "2024-01-15", "Jan 15, 2024": "2024-01-15", "15-Jan-24": "2024-01-15", "2024-01-15 14:30:00": "2024-01-15T14:30:00", "01/15/2024 2:30 PM": "2024-01-15T14:30:00", "Dec 25, 2023 at 9:15 AM": "2023-12-25T09:15:00", "25/12/2023": "2023-12-25", "02/31/2024": "2024-02-31", "invalid": None, "": None}
    assert each(spark, T.normalize_date, [*vectors, None]) == [*vectors.values(), None]


def test_ranges_phones_flags(spark):
    assert each(spark, T.normalize_phone, ["+1 (743) 555-3824", "7435553824", "12", None]) == ["(743) 555-3824", "(743) 555-3824", None, None]
    found = each(spark, T.parse_range, ["70-100", "≥ 5", "< 3.5", "7", "negative", None])
    assert [(r["low"], r["high"]) for r in found] == [(70, 100), (5, None), (None, 3.5), (7, 7), (None, None), (None, None)]
    assert each(spark, T.normalize_flag, ["hi", "lo", "Panic", "a", "", "whatever it is"]) == ["H", "L", "CRIT", "ABN", None, "WHATEVER I"]


def test_rows_recognised(spark):
    yes = ["Glucose 95 mg/dL 70-100", "WBC 6.0", "TSH 4.71 uIU/mL"]
    no = ["Accession: 1234 mg/dL", "Phone 555-123-4567", "the 5 mg/dL", "Name", "", None, "a: b: 5 mg/dL"]
    assert each(spark, P.is_probable_row, yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    ("op", "path", "value", "want"),
    [
        ("set", "a.b", 1, {"a": {"b": 1}, "l": [1, 2]}),
        ("set", "/l/3", 9, {"a": {}, "l": [1, 2, None, 9]}),
        ("set", "l[0]", 5, {"a": {}, "l": [5, 2]}),
        ("unset", "l.1", None, {"a": {}, "l": [1, None]}),
        ("unset", "a", None, {"l": [1, 2]}),
        ("unset", "x.y", None, {"a": {}, "l": [1, 2]}),
        ("set", "l.name", 1, {"a": {}, "l": [1, 2]}),
        ("append", "n", 1, {"a": {}, "l": [1, 2], "n": [1]}),
        ("set", "", 1, {"a": {}, "l": [1, 2]}),
        ("append", "l", 3, {"a": {}, "l": [1, 2, 3]}),
        ("append", "a", 3, {"a": {}, "l": [1, 2]}),
        ("append", "l.0", 3, {"a": {}, "l": [1, 2]}),
    ],
)
def test_patches(op, path, value, want):
    assert corrections.patch({"a": {}, "l": [1, 2]}, op, path, value) == want


def test_patches_in_order(spark):
    docs = spark.createDataFrame([(1, '{"a": 0}'), (2, None)], "doc_id long, json string")
    log = spark.createDataFrame([(1, 2, 0, "set", "a", "2"), (1, 1, 0, "set", "a", "1"), (2, 1, 0, "set", "b.c", '"x"')], "doc_id long, ts long, seq long, op string, path string, value string")
    assert {r.doc_id: json.loads(r.json) for r in corrections.patched(docs, log).collect()} == {1: {"a": 2}, 2: {"b": {"c": "x"}}}


def test_client_patches(spark):
    docs = spark.createDataFrame([(1, '{"l": [1, 2, 3], "a": {"x": 1}}')], "doc_id long, json string")
    items = [("remove", "l[1]", None), ("replace", "a.y[1]", '"z"'), ("append", "l", "9"), ("whatever", "b", "0"), ("unset", "a.x", None)]
    log = spark.createDataFrame([(1, i, 0, *x) for i, x in enumerate(items)], "doc_id long, ts long, seq long, op string, path string, value string")
    got = json.loads(corrections.patched(docs, log, client=True).head().json)
    assert got == {"l": [1, 3, 9], "a": {"y": [None, "z"]}, "b": 0}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Glucose 105 mg/dL 70-99 H", "B-TEST_NAME B-VALUE B-UNIT I-VALUE B-FLAG"),
        ("Total Protein <5 g/L", "B-TEST_NAME I-TEST_NAME B-VALUE B-UNIT"),
        ("WBC* 12.5 K/uL", "B-TEST_NAME B-VALUE B-UNIT"),
        ("HIV NEGATIVE", "O B-VALUE"),
        ("LOW 3", "B-TEST_NAME B-VALUE"),
        ("", ""),
    ],
)
def test_rows_tagged_by_rule(text, want):
    assert " ".join(labels.rule_tags(text)) == want


def test_best_panels_are_ranked_by_the_score_shown(spark):
    """Three equal confidences have a mean a last place below one of them; that decides nothing."""
    from panelspark.plans import report

    low = (0.85775 + 0.85775 + 0.85775) / 3
    assert low < 0.85775
    rows = [(d, 1, 3, a, a * 0.5 + 0.5, "", False) for d, a in ((1, 0.85775), (2, low), (3, 0.85775), (4, 0.85775), (5, 0.9))]
    scored = spark.createDataFrame(rows, "doc_id long, panel_no long, n_tests long, avg_confidence double, score double, reasons string, needs_review boolean")
    assert [r.doc_id for r in report.best_panels(scored, 3).collect()] == [5, 1, 2]
