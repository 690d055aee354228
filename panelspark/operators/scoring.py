"""Scores of fields rolled up to rows, panels and documents, and what needs review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L


def panel_scores(tests: DataFrame, with_tests: bool = False) -> DataFrame:
    """tests(doc_id, panel_no, confidence, value_s, unit_s, range_s, units, reference_range, continuity) -> a row a panel; with its tests' ``confidences`` on demand."""
    n = F.count("*")
    share = lambda c: F.count(F.when(c, 1)) / n
    coherence = (F.count("units") + F.count("reference_range")) / (2 * n)
    avg_value, unit_bad, range_bad = share(F.col("value_s") < 0.7), share(F.col("unit_s") < 0.8), share(F.col("range_s") < 0.6)
    wf, wc, wh = L.PANEL_WEIGHTS
    out = tests.groupBy("doc_id", "panel_no").agg(n.alias("n_tests"), F.avg("confidence").alias("avg_confidence"), F.first("continuity").alias("continuity"), coherence.alias("coherence"), avg_value.alias("_v"), unit_bad.alias("_u"), range_bad.alias("_r"), *([F.collect_list("confidence").alias("confidences")] if with_tests else []))
    out = out.withColumn("score", F.least(F.lit(1.0), F.col("avg_confidence") * wf + F.col("continuity") * wc + F.col("coherence") * wh))
    reason = lambda c, text: F.when(c, F.lit(text))
    reasons = F.array_compact(F.array(reason(F.col("_v") > 0.3, "values"), reason(F.col("_u") > 0.4, "units"), reason(F.col("_r") > 0.5, "ranges"), reason(F.col("continuity") < 0.5, "continuity"), reason(F.col("coherence") < 0.6, "coherence")))
    out = out.withColumn("reasons", F.array_join(reasons, ","))
    return out.withColumn("needs_review", (F.col("score") < L.PANEL_REVIEW) | (F.col("reasons") != "")).drop("_v", "_u", "_r")


def document_scores(panels: DataFrame) -> DataFrame:
    """Panels' mean, tests' mean and the number of panels weighed; spread of confidences; reasons for review.

    panels: panel_scores() with confidences, so that tests are read once and a document needs no join.
    """
    counted = lambda c: F.count(F.when(c, 1))
    p = panels.groupBy("doc_id").agg(
        F.count("*").alias("n_panels"),
        F.sum("n_tests").alias("n_tests"),
        F.avg("score").alias("avg_panel"),
        counted(F.col("needs_review")).alias("in_review"),
        counted(F.col("score") >= 0.8).alias("high"),
        counted(F.col("score") < 0.5).alias("low"),
        F.array_sort(F.flatten(F.collect_list("confidences"))).alias("_c"),
    )
    zero = F.lit(0.0)
    p = p.withColumn("mean", F.aggregate("_c", zero, lambda a, x: a + x) / F.col("n_tests"))
    squares = F.aggregate("_c", zero, lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    at = lambda i: F.get("_c", i.cast("int"))
    middle = (at(F.floor((F.col("n_tests") - 1) / 2)) + at(F.floor(F.col("n_tests") / 2))) / 2
    a, b, c = L.DOCUMENT_WEIGHTS
    out = p.withColumns({"median": middle, "min": F.get("_c", 0), "max": F.element_at("_c", -1), "std": F.sqrt(squares / F.col("n_tests"))}).drop("_c")
    out = out.withColumn("score", F.col("avg_panel") * a + F.col("mean") * b + F.least(F.col("n_panels") / 5.0, F.lit(1.0)) * c)
    review = (F.col("score") < L.DOCUMENT_REVIEW) | (F.col("in_review") > F.col("n_panels") * 0.3) | (F.col("avg_panel") < 0.6) | (F.col("low") > 0) | (F.col("n_tests") < 5)
    return out.withColumn("needs_review", review)


def with_unit_boost(tests: DataFrame) -> DataFrame:
    """+0.1 for panels in which one unit has over half of the rows with units, two at least; capped at 1."""
    per_unit = tests.where(F.col("units").isNotNull()).groupBy("doc_id", "panel_no", "units").agg(F.count("*").alias("n"))
    top = per_unit.groupBy("doc_id", "panel_no").agg(F.max("n").alias("top"), F.sum("n").alias("with_units"))
    return top.withColumn("boost", F.when((F.col("with_units") >= 2) & (F.col("top") * 2 > F.col("with_units")), 0.1).otherwise(0.0))
