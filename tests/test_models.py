"""The row tagger against sums over all paths, its fit by finite differences, both on held-out rows; role models and their fall-back."""

from __future__ import annotations

import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import roles, stages, tagger, training
from panelspark.plans import models

SUPPLIED = "/root/testdata/sf0.001"


def path_score(scores, moves, path):
    return sum(scores[i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))


def test_sums_and_best_path_over_all_paths():
    r = np.random.default_rng(1)
    for places in (1, 2, 5):
        scores, moves = r.normal(size=(3, places, 3)), r.normal(size=(3, 3))
        a, b = tagger.forward(scores, moves), tagger.backward(scores, moves)
        for n in range(3):
            every = {p: path_score(scores[n], moves, p) for p in product(range(3), repeat=places)}
            z = np.log(sum(map(np.exp, every.values())))
            assert tagger._log_sum(a[n : n + 1, -1], 1)[0] == pytest.approx(z)
            for i, t in product(range(places), range(3)):
                assert a[n, i, t] + b[n, i, t] == pytest.approx(np.log(sum(np.exp(s) for p, s in every.items() if p[i] == t)))
            assert tuple(tagger.viterbi(scores, moves)[n]) == max(every, key=every.get)


def test_gradients_by_finite_differences(monkeypatch):
    monkeypatch.setattr(tagger, "FEATURES", 12)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 12, (4, 5, 3)), r.integers(0, 3, (4, 5))
    model = tagger.Model(list("abc"), r.normal(size=(12, 3)), r.normal(size=(3, 3)))
    _, by_weight, by_move = tagger.log_likelihood(x, y, model)
    for p, grad in ((model.weights, by_weight), (model.moves, by_move)):
        for at in [(0, 0), (2, 1), (1, 2)]:
            values = []
            for step in (1e-5, -1e-5):
                p[at] += step
                values.append(tagger.log_likelihood(x, y, model)[0])
                p[at] -= step
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(grad[at], abs=1e-4)


def test_tagger_on_documents_held_out(spark):
    if not os.path.isdir(SUPPLIED):
        pytest.skip("no supplied tables")
    rows = models.QUERIES["row_tagger"](spark, SUPPLIED).collect()
    assert sum(r.n for r in rows if r.tag == r.said) > 0.97 * sum(r.n for r in rows)


def test_tagger_learns_what_words_alone_dont_tell(spark):
    """The same word is a name or a flag by where it stands."""
    tokens = [(d, 1, i, w, t) for d in range(200) for i, (w, t) in enumerate([("H", "NAME"), (str(d), "VALUE"), ("H", "FLAG")] if d % 2 else [("Glucose", "NAME"), ("H", "NAME"), (f"{d}.5", "VALUE")])]
    df = spark.createDataFrame(tokens, "doc_id long, row_no long, pos long, token string, tag string")
    model = tagger.train(df)
    rows = spark.createDataFrame([(1, 1, "H 999 H"), (2, 1, "Glucose H 77.5"), (3, 1, ""), (4, 1, None)], "doc_id long, row_no long, text string")
    got = {}
    for r in sorted(tagger.tagged(rows, model).collect(), key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r.tag)
    assert got == {1: ["NAME", "VALUE", "FLAG"], 2: ["NAME", "NAME", "VALUE"]}
    nothing = tagger.train(df.limit(0))
    assert tagger.tagged(rows, nothing).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"TEST_ROW": "Glucose {} mg/dL 70-99", "SECTION_PANEL": "LIPID PANEL {}", "PAGE_FOOTER": "page {} of report"}
    rows = [(d, i, text.format(d * 7 % 50), role == "SECTION_PANEL", 100.0 * i, 100.0 * i, role) for d in range(60) for i, (role, text) in enumerate(words.items())]
    return training.role_features(spark.createDataFrame(rows, "doc_id long, row_no long, text string, is_bold boolean, _y double, y double, label string")).cache()


def test_folds_keep_documents_together(labelled):
    folds = labelled.withColumn("fold", roles.fold_of(F.col("doc_id")))
    assert folds.groupBy("doc_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    found = roles.cross_validated(labelled, parameters={"regParam": [0.01, 100.0]}).collect()
    accuracy = {r.parameters: r.accuracy for r in found}
    assert accuracy["regParam=0.01"] > 0.95 and len(found) == 2


@pytest.mark.parametrize("kind", ["forest", "logistic"])
def test_importances_are_of_words(labelled, kind):
    top = [r.name for r in roles.importances(roles.fit(labelled, kind)).orderBy(F.desc("importance")).limit(8).collect()]
    assert {"bold", "glucose", "panel", "page", "lipid", "mg", "dl"} & set(top)


def test_stage_falls_back_on_rules(spark, labelled, tmp_path):
    path = f"{tmp_path}/model"
    roles.fit(labelled).write().save(path)
    by_model = roles.staged(labelled, path).collect()
    assert all(r.role == r.label and r.decided == "model" and r.role_confidence >= roles.SURE for r in by_model)
    for found in (roles.staged(labelled, None).collect(), roles.staged(labelled, path, sure=1.1).collect()):
        assert {r.decided for r in found} == {"rules"} and {r.role for r in found if r.label == "TEST_ROW"} == {"TEST_ROW"}


def test_row_stage_falls_back_by_row(spark):
    """What the model names is taken; where it names nothing, and without a model, the pattern reads the row."""
    rows = spark.createDataFrame([(1, 1, "Glucose 105 mg/dL 70-99"), (1, 2, "zzz 7 qq"), (2, 1, ""), (2, 2, None)], "doc_id long, row_no long, text string")
    tokens = [(d, 1, i, w, t) for d in range(50) for i, (w, t) in enumerate([("Glucose", "B-NAME"), (str(100 + d), "B-VALUE"), ("mg/dL", "B-UNIT"), (f"{d}-99", "B-RANGE")])]
    tokens += [(100 + d, 1, i, w, "O") for d in range(50) for i, w in enumerate(["zzz", str(d % 9), "qq"])]
    model = tagger.train(spark.createDataFrame(tokens, "doc_id long, row_no long, pos long, token string, tag string"))
    found = stages.row_stage(rows, model)
    got = {(r.doc_id, r.row_no): (r.test_name, r.result_value, r.units, r.reference_range, r.decided) for r in found.collect()}
    assert got == {(1, 1): ("Glucose", "105", "mg/dL", "70-99", "model"), (1, 2): ("zzz", "7", "qq", None, "rules"), (2, 1): (None, None, None, None, "rules"), (2, 2): (None, None, None, None, "rules")}
    stats = {r.doc_id: (r.rows, r.parsed, r.used_fallback, r.reason) for r in stages.row_stage_stats(found).collect()}
    assert stats == {1: (2, 2, True, "per row"), 2: (2, 0, True, "no row by the model")}
    ruled = stages.row_stage(rows, None).where("doc_id = 1 and row_no = 1").head()
    assert (ruled.test_name, ruled.result_value, ruled.decided) == ("Glucose", "105", "rules")


def test_like_rows_enter_a_model_once(labelled):
    """A thousand copies of the rows weigh as before and are no more rows to the regression."""
    weighed = roles.weighed(labelled.select("text", "y", "bold", "tertile", "label"))
    one, many = roles.alike(weighed), roles.alike(weighed.crossJoin(labelled.sparkSession.range(10).select("id")))
    assert one.count() == many.count() < weighed.count()
    assert many.agg(F.sum("n")).first()[0] == 10 * weighed.count()
    assert many.agg(F.sum("weight")).first()[0] == pytest.approx(10 * one.agg(F.sum("weight")).first()[0])
