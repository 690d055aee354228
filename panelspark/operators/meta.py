"""Facts of a document gathered over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_values(lines: DataFrame, fields: dict[str, Column], order: str = "line_no") -> DataFrame:
    """Of each field the first value in the order of lines."""
    return lines.groupBy("doc_id").agg(*[F.min_by(c, F.when(c.isNotNull(), F.col(order))).alias(name) for name, c in fields.items()])


def continued_section(lines: DataFrame, starts: Column, order: str = "line_no") -> DataFrame:
    """Lines from the first that starts a section on, joined."""
    w = W.partitionBy("doc_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    inside = lines.withColumn("_in", F.bool_or(starts).over(w)).where("_in")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return inside.groupBy("doc_id").agg(F.count("*").alias("n_lines"), text.alias("text"))


def best_by_confidence(facts: DataFrame) -> DataFrame:
    """facts(doc_id, field, value, confidence, line_no): the most confident value, the first of equals; all texts joined; mean confidence."""
    best = F.max_by("value", F.struct("confidence", -F.col("line_no")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "; ")
    return facts.groupBy("doc_id", "field").agg(best.alias("value"), texts.alias("texts"), F.avg("confidence").alias("confidence"))


def extraction_quality(facts: DataFrame) -> DataFrame:
    """Counts of high, medium and low confidence, their weighted ratio and its label."""
    c = F.col("confidence")
    out = facts.groupBy("doc_id").agg(F.count(F.when(c >= 0.8, 1)).alias("high"), F.count(F.when((c >= 0.6) & (c < 0.8), 1)).alias("medium"), F.count(F.when(c < 0.6, 1)).alias("low"))
    ratio = (F.col("high") + F.col("medium") * 0.6 + F.col("low") * 0.2) / (F.col("high") + F.col("medium") + F.col("low"))
    return out.withColumn("ratio", ratio).withColumn("label", F.when(F.col("ratio") >= 0.8, "high").when(F.col("ratio") >= 0.5, "medium").otherwise("low"))
