"""Stages that put readings together by document or row: headers under their served names, rows tagged by a model or else by rule, documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import header_bank, headers, rows, tagger

# The names that clients know fields by.
LEGACY = {"dob": ("patient", "dob"), "patient_id": ("patient", "mrn"), "specimen_type": ("specimen", "type"), "collection_date": ("specimen", "collected_at"), "accession": ("specimen", "id"), "lab_name": ("vendor", "name")}
COUNTED = {"patient": "patient_fields", "specimen": "specimen_fields", "vendor": "lab_fields", "ordering": "ordering_fields"}
ROW_FIELDS = ("test_name", "result_value", "units", "reference_range", "flag")
_KINDS = {"test_name": "NAME", "result_value": "VALUE", "units": "UNIT", "reference_range": "RANGE", "flag": "FLAG"}


def header_stage(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, role, text) -> a row a document: the fields that clients know, by their names, and how many fields each section has.

    A name needs a first name; a document without any field has no row.
    """
    found = headers.document_fields(lines)
    of = lambda section, field: F.max(F.when((F.col("section") == section) & (F.col("field") == field), F.col("value")))
    legacy = [of(*where).alias(name) for name, where in LEGACY.items()]
    counts = [F.count(F.when(F.col("section") == section, 1)).alias(name) for section, name in COUNTED.items()]
    one = found.groupBy("doc_id").agg(of("patient", "first_name").alias("_first"), of("patient", "last_name").alias("_last"), *legacy, *counts)
    name = F.when(F.col("_first").isNotNull(), F.concat(F.col("_first"), F.lit(" "), F.coalesce("_last", F.lit(""))))
    return one.select("doc_id", name.alias("name"), *LEGACY, *COUNTED.values())


def row_stage(lines: DataFrame, model: tagger.Model | None) -> DataFrame:
    """Result rows(doc_id, row_no, text) with their fields: from the model's tags where these name any field, else by the row pattern.

    Adds the fields and decided (model or rules). A row whose text is empty or null has no fields and is left to the rules.
    """
    pattern = rows.parse_row(F.replace(F.coalesce("text", F.lit("")), F.lit("\t"), F.lit(" ")))
    ruled = lines.withColumn("_p", pattern)
    if model is None or not model.tags:
        return ruled.select(*lines.columns, *(F.col(f"_p.{f}").alias(f) for f in ROW_FIELDS), F.lit("rules").alias("decided"))
    spans = rows.longest_spans(rows.spans(tagger.tagged(lines, model).where("tag <> 'O'")))
    wide = spans.groupBy("doc_id", "row_no").agg(*(F.max(F.when(F.col("label") == kind, F.col("text"))).alias(f"_{f}") for f, kind in _KINDS.items()))
    both = ruled.join(wide, ["doc_id", "row_no"], "left").withColumn("_said", F.coalesce(*(F.col(f"_{f}") for f in ROW_FIELDS)).isNotNull())
    fields = [F.when(F.col("_said"), F.col(f"_{f}")).otherwise(F.col(f"_p.{f}")).alias(f) for f in ROW_FIELDS]
    return both.select(*lines.columns, *fields, F.when(F.col("_said"), "model").otherwise("rules").alias("decided"))


def row_stage_stats(found: DataFrame) -> DataFrame:
    """row_stage() by document: rows, parsed, used_fallback and why."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("test_name").alias("parsed"), F.bool_or(F.col("decided") == "rules").alias("used_fallback"), F.bool_and(F.col("decided") == "rules").alias("_all"))
    return n.select("doc_id", "rows", "parsed", "used_fallback", F.when(F.col("_all"), "no row by the model").when(F.col("used_fallback"), "per row").alias("reason"))


def training_documents(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, role, text) -> a row a document: its surest patient and specimen lines (by the word lists' confidence, the first of equals), and how many lines, header lines and result rows it has."""
    facts = header_bank.line_facts(lines)
    order = F.struct("final_confidence", -F.col("line_no"))
    whole = F.struct(*header_bank.FIELDS, "final_confidence")
    best = lambda kind: F.max_by(whole, F.when(F.col("kind") == kind, order)).alias(kind)
    summed = facts.groupBy("doc_id").agg(best("patient"), best("specimen"))
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("total_lines"), F.count(F.when(F.col("role").startswith("HEADER_"), 1)).alias("header_lines"), F.count(F.when(F.col("role") == "TEST_ROW", 1)).alias("row_lines"))
    out = counted.join(summed, "doc_id", "left")
    return out.select("doc_id", "total_lines", "header_lines", "row_lines", "patient.patient_name", "patient.sex", F.col("patient.final_confidence").alias("patient_confidence"), "specimen.specimen_number", *(F.col(f"specimen.{d}").alias(d) for d in header_bank.DATES), F.col("specimen.final_confidence").alias("specimen_confidence"))
