"""Header facts and streams on cases written by hand, clusters against a plain loop."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import header_bank as H
from panelspark.operators import layout
from panelspark.streaming import inbox, ingest, jobs

DATES = {
    "03/14/2024": "2024-03-14", "3/4/24": "2024-03-04", "03-14-2024": "2024-03-14", "3-4-99": "1999-03-04", "2024-03-14": "2024-03-14", "14/03/2024": "2024-03-14", "14/03/68": "2068-03-14", "03.14.2024": "2024-03-14", "3.4.69": "1969-03-04",
    "January 5, 2024": "2024-01-05", "jan 5, 2024": "2024-01-05", "5 September 2024": "2024-09-05", "5 Sep 2024": "2024-09-05", "03/14/2024 2:30 PM": "2024-03-14", "on 14-03-2024 or so": "2024-03-14", "99/99/2024": None, "02/30/2024": None, "": None, "soon": None, "Mayday 5, 2024": None,
}
LINES = {
    "Patient: Smith, John (Male)": ("Smith, John", "M", 1.0, ""),
    "Name: Doe, Jane F": ("Doe, Jane F", "F", 1.0, ""),
    "Mr. Johnson, Robert": ("Johnson, Robert", None, 0.5, "lexicon_enhanced_name"),
    "Patient Name: Sarah Williams Female": ("Sarah Williams Female", "F", 1.0, ""),
    "Patient: O'NEIL, mary-ann": ("O'Neil, Mary-Ann", None, 0.9, "lexicon_enhanced_name"),
}


def test_dates_in_thirteen_forms(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", H.header_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == DATES


def test_patients(spark):
    lines = spark.createDataFrame([(1, i, "HEADER_PATIENT", t) for i, t in enumerate(LINES)], "doc_id long, line_no long, role string, text string")
    got = {r.raw_text: (r.patient_name, r.sex, round(r.confidence, 6), r.flags) for r in H.line_facts(lines).collect()}
    for text, (name, sex, sure, flags) in LINES.items():
        assert got[text][:3] == (name, sex, sure)
        assert flags in got[text][3]


def test_documents_without_facts(spark):
    lines = spark.createDataFrame([(1, 1, "HEADER_PATIENT", None), (1, 2, "HEADER_SPECIMEN", "  "), (2, 1, None, "Patient: A, B"), (3, 1, "HEADER_SPECIMEN", "nothing here")], "doc_id long, line_no long, role string, text string")
    facts = H.line_facts(lines)
    assert facts.collect() == H.document_facts(facts).collect() == H.fact_quality(facts).collect() == []


def test_specimens_by_document(spark):
    texts = ["Specimen ID: SPEC789 Entered: 2024-01-16 Reported: 2024-01-17", "Accession: ACC123456 Collection Date: 01/15/2024", "Lab #: 12"]
    lines = spark.createDataFrame([(1, i, "HEADER_SPECIMEN", t) for i, t in enumerate(texts)], "doc_id long, line_no long, role string, text string")
    facts = H.line_facts(lines)
    (r,) = H.document_facts(facts).collect()
    assert (r.specimen_number, r.date_entered, r.date_reported, r.date_collected, r.date_received) == ("SPEC789", "2024-01-16", "2024-01-17", "2024-01-15", None)
    assert (r.specimen_confidence, r.patient_confidence) == (1.0, 0.0)
    (q,) = H.fact_quality(facts).collect()
    assert q.high + q.medium + q.low == 2


EVENTS = [
    # id, seq, status, minutes
    (1, 0, "queued", 0), (1, 1, "processing", 5), (1, 2, "completed", 9), (1, 3, "processing", 10),
    (2, 4, "processing", 1), (2, 5, "queued", 2), (2, 6, "cancelled", 3),
    (3, 7, "queued", 0), (3, 8, "processing", 4),
    (4, 9, "queued", 0), (4, 10, "processing", 2), (4, 11, "failed", 3), (4, 12, "queued", 4), (4, 13, "processing", 4),
    (None, 14, "queued", 0), (5, 15, "odd", 0), (9, 16, "queued", 9000),
]


def test_job_moves(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(i, seq, status, begin + timedelta(minutes=m)) for i, seq, status, m in EVENTS]
    spark.createDataFrame(rows, "id long, seq long, status string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = lambda: jobs.job_moves(spark.readStream.schema("id long, seq long, status string, at timestamp").parquet(f"{tmp_path}/events"), stale="1 day")
    before = spark.conf.get(jobs.PROVIDER, None)
    got = jobs.drained_with_state(spark, stream).collect()
    assert spark.conf.get(jobs.PROVIDER, None) == before
    state, want = {}, []
    for i, _, status, at in rows:
        key = -1 if i is None else i
        old = state.get(key, (None, None))[0]
        legal = status in jobs.MOVES.get(old, set())
        want.append((key, old, status, at, legal, "event"))
        if legal:
            state[key] = status, at
    want += [(k, "processing", "failed", at + timedelta(days=1), True, "stale") for k, (s, at) in state.items() if s == "processing"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, ((r.id, r.before, r.status, r.at, r.legal, r.cause) for r in got))) == sorted(map(key, want))
    assert sum(r.cause == "stale" for r in got) == 2


def test_inbox_moves_files_on(spark, tmp_path):
    """A second batch puts the first one's files away."""
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    stream = inbox.inbox(spark, f"{tmp_path}/in", archive=f"{tmp_path}/done", files_a_trigger=1)
    got = {r.content.decode() for r in ingest.drained(spark, stream).collect()}
    assert got == {"a.pdf", "b.pdf"}
    left = {p.name for p in (tmp_path / "in").iterdir() if not p.name.startswith(".")}
    assert "c.txt" in left and len(left) == 2
    assert sum(p.is_file() and p.suffix == ".pdf" for p in (tmp_path / "done").rglob("*")) == 1


def test_archive_by_age(spark, tmp_path):
    (tmp_path / "out" / "x").mkdir(parents=True)
    for name in ("a.json", "x/a.json", "keep.txt"):
        (tmp_path / "out" / name).write_text("{}")
    now = datetime.now()
    assert inbox.archived(spark, f"{tmp_path}/out", f"{tmp_path}/old", now) == 0
    assert inbox.archived(spark, f"{tmp_path}/out", f"{tmp_path}/old", now + timedelta(days=2)) == 2
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")] == ["keep.txt"]
    assert inbox.archived(spark, f"{tmp_path}/out", f"{tmp_path}/old", now + timedelta(days=2)) == 0


@pytest.mark.parametrize("least", [0.4, 0.85])
def test_clusters_against_plain_loop(spark, least):
    from collections import Counter
    from math import log, sqrt

    r = Random(3)
    words = ["report", "page [NUM]", "lab of health", "labs of health", "confidential", "final copy", "x"]
    texts = {d: list(dict.fromkeys(" ".join(r.choices(words, k=r.randrange(1, 4))) for _ in range(12))) for d in range(6)}
    rows = [(d, "top", t, i) for d, some in texts.items() for i, t in enumerate(some)]
    got = {(x.doc_id, x.text): x.cluster for x in layout.clustered_texts(spark.createDataFrame(rows, "doc_id long, side string, text string, first_row long"), least).collect()}
    want = {}
    for d, some in texts.items():
        counts = [Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in some]
        df = Counter(g for c in counts for g in c)
        vectors = [{g: n * (1 + log((1 + len(some)) / (1 + df[g]))) for g, n in c.items()} for c in counts]
        norms = [sqrt(sum(v * v for v in x.values())) or 1 for x in vectors]
        taken = {}
        for i, t in enumerate(some):
            if t in taken:
                continue
            taken[t] = t
            for j in range(i + 1, len(some)):
                if some[j] not in taken and sum(v * vectors[j].get(g, 0) for g, v in vectors[i].items()) / norms[i] / norms[j] >= least:
                    taken[some[j]] = t
        want |= {(d, t): c for t, c in taken.items()}
    assert got == want
