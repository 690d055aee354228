"""The pipeline against plain versions of its stages, each judged on its own input."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from panelspark.llm import decontam
from panelspark.llm.shared import read, written
from tests.llm import brute, fixtures

SUPPLIED = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def ids(found):
    return sorted((d for d, _ in found), key=lambda d: (d is not None, d))


@pytest.fixture(params=["odd", "supplied"])
def place(request, tmp_path):
    if request.param == "supplied":
        return SUPPLIED if os.path.isdir(SUPPLIED) else pytest.skip("no supplied tables")
    return fixtures.tables(str(tmp_path), True)


def test_stages(spark, place):
    docs = read(spark, place, "documents")
    before = rows(docs)
    stages = dict(corpus_pipeline.STAGES)
    kept = written(stages["quality"](spark, docs, place), "q")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert set(rows(kept)) <= set(before)

    one = written(stages["near_duplicates"](spark, docs.select(*corpus_pipeline.COLUMNS), place), "n")
    assert ids(rows(one)) == ids((d, None) for d, _, c in brute.alike(before) if d == c)

    clean = written(stages["decontamination"](spark, one, place), "c")
    items = [("" if r.item_id is None else r.item_id, r.text) for r in read(spark, place, "benchmark").collect()]
    assert ids(rows(clean)) == ids((r[0], None) for r in brute.contaminated(rows(one), items) if not r[-1])

    private = written(stages["personal_data"](spark, clean, place), "p")
    assert private.columns == list(corpus_pipeline.COLUMNS) and ids(rows(private)) == ids(rows(clean))
    assert all(r.n_chars == len(r.text or "") for r in private.collect())
    assert not any(brute.personal(t) for _, t in rows(private) if t and "@" in t and len(t) < 300)

    packed = stages["packing"](spark, private, place).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows(private)}


def test_near_duplicates_that_share_ids(spark, tmp_path):
    from random import Random

    from pyspark.sql import functions as F

    from panelspark.llm import jaccard

    r = Random(3)
    base, other, third = (fixtures.words(r, 100, 10**6) for _ in range(3))
    text, near, lone, far = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(other), " ".join(third)
    table = [(None, text), (None, near), (None, lone), (4, far), (4, near), (4, near), (5, "a b c"), (5, "a b c"), (6, None), (6, ""), (6, "")]
    fixtures.documents(str(tmp_path), table, False)
    docs = read(spark, str(tmp_path), "documents")
    classes = jaccard.classes(docs)
    roots = {}
    for x in classes.where("n_shingles > 0").join(docs.selectExpr("doc_id as d", "text", "xxhash64(text) as h").distinct(), F.expr("d <=> doc_id and h = text_hash")).collect():
        roots.setdefault(x.text, set()).add(x.root)
    assert roots[text] == roots[near] and len(roots[text]) == 1 and len(set().union(*roots.values())) == 4
    one = rows(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)))
    kept = [t for _, t in one]
    assert len([t for t in kept if t in (text, near)]) == 1
    assert sorted(((d, t) for d, t in one if t not in (text, near)), key=str) == sorted([(None, lone), (4, far), (5, "a b c"), (6, None), (6, ""), (6, "")], key=str)


def test_whole_run(spark, place):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, place)
    assert [x.split("-")[:2] for x in set(os.listdir(folder)) - before] == [["stage", "packing"]]
    assert out.count() and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, fixtures.tables(str(tmp_path), False)).collect() == []


def test_contamination_rule(spark):
    df = spark.createDataFrame([(0, 0), (1, 20), (1, 21), (5, 0)], "h int, n int")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(decontam.is_contaminated(F.col("h"), F.col("n"))).collect()] == [False, True, False, True]
