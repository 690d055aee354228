"""What keeps queries in time on large tables: work done once a row and dealt out evenly."""

from __future__ import annotations

import re
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import Row

from panelspark.operators import headers, stitch
from panelspark.plans import documents
from panelspark.streaming import jobs

def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_head_fields_ask_each_pattern_once_a_line(spark):
    lines = spark.createDataFrame([(1, 0, "PAGE_HEADER", "LabCorp Account: A1 Phone: 555-201-0001")], "doc_id long, line_no int, role string, text string")
    asked = sum(len(some) for some in headers._LOOKED_FOR.values())
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        found = plan(headers.document_fields(lines))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"regexp_extract\((_t|trim\(text)", found)) == asked


@pytest.mark.parametrize("name", ["document_heads", "header_stage"])
def test_head_lines_are_dealt_out_once(spark, tmp_path, name):
    spark.range(30_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert documents._heads(spark, str(tmp_path)).rdd.getNumPartitions() == 8
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = documents.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert whole.count("Exchange ") == 1 and whole.count("Exchange hashpartitioning(doc_id") == 1


def test_job_asks_the_store_once():
    """A job's events cost one question and one answer, and a timer only where one changes."""
    asked = []

    class Store:
        held = None

        def getValueState(self, *_):
            return self

        def get(self):
            asked.append("get")
            return self.held

        def update(self, value):
            asked.append("update")
            self.held = value

        def __getattr__(self, name):
            return lambda *a: asked.append((name, *a))

    store, at = Store(), datetime(2024, 1, 1)
    states = jobs.JobStates(1000)
    states.init(store)
    said = lambda *some: [r.legal for r in states.handleInputRows((1,), iter([Row(id=1, seq=i, status=s, at=at) for i, s in enumerate(some)]), None)]
    ms = int(at.timestamp()) * 1000
    assert said("queued", "processing") == [True, True]
    assert said("queued") == [False]
    assert said("completed") == [True]
    assert asked == ["get", "update", ("registerTimer", ms + 1000), "get", "get", "update", ("deleteTimer", ms + 1000)]


def test_rows_are_walked_in_order_across_batches():
    """Chains of used-up rows and panels' counts go on from batch to batch, and rows of no chain aren't looked at one by one."""
    names = ["_may_go", "_1gives", "_1near", "_1empties", "_2gives", "_2empties"]
    rows = [  # the first uses up the second, which so can't use up the third; that one uses up the fifth, which the fourth passes over
        (False, True, True, True, False, False),
        (True, True, True, True, False, False),
        (True, False, True, False, True, True),
        (True, False, False, False, True, False),
        (True, True, True, False, False, False),
    ]
    for cut in range(1, len(rows) + 1):
        parts = [rows[:cut], rows[cut:]]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.bool_()) for i in range(6)], names=names) for part in parts]
        got = [x for b in stitch._walked(iter(batches)) for x in b.column("took").to_pylist()]
        assert got == [1, 2, 2], cut
    panels, merged = [1, 1, 1, 2, 2, 3], [5, None, 6, None, 7, None]
    for cut in range(7):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([9] * len(p), p, m)], names=["doc_id", "panel_no", "merged_from"]) for p, m in ((panels[:cut], merged[:cut]), (panels[cut:], merged[cut:]))]
        got = [tuple(r.values()) for b in stitch._counted(iter(batches)) for r in b.to_pylist()]
        assert got == [(9, 1, 2, 3), (9, 2, 1, 2), (9, 3, 0, 1)], cut
