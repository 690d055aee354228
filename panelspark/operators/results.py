"""Result documents as they are served: ranges, rows, merged document data, counts of what is filled and what is weak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L
from panelspark.functions import text as T

#: Fields of each section of a document.
SECTIONS = {
    "vendor": ["name", "account_number", "address", "phone", "fax"],
    "performing_lab": ["name", "clia", "director", "address"],
    "patient": ["last_name", "first_name", "middle", "dob", "sex", "mrn", "phone", "address", "age_at_collection"],
    "ordering": ["provider_name", "npi", "location"],
    "specimen": ["id", "control_id", "type", "collected_at", "received_at", "entered_at", "reported_at"],
    "report": ["clinical_info", "comments", "ordered_items"],
}
#: Flat fields of document_info, and the section field that each fills.
FLAT = {
    "patient_first_name": ("patient", "first_name"),
    "patient_last_name": ("patient", "last_name"),
    "patient_middle_name": ("patient", "middle"),
    "patient_dob": ("patient", "dob"),
    "patient_sex": ("patient", "sex"),
    "patient_mrn": ("patient", "mrn"),
    "vendor_name": ("vendor", "name"),
    "vendor_account_number": ("vendor", "account_number"),
    "vendor_phone": ("vendor", "phone"),
    "vendor_fax": ("vendor", "fax"),
    "performing_lab_name": ("performing_lab", "name"),
}


def _at(json: Column, *path: str) -> Column:
    return F.get_json_object(json, "$." + ".".join(path))


def is_object(json: Column) -> Column:
    return F.ltrim(json).startswith("{")


def served_range(raw: Column) -> Column:
    """struct(reference_range, reference_range_text, reference_range_low, reference_range_high) of a text or an object {text, low, high}."""
    text = F.when(is_object(raw), _at(raw, "text")).otherwise(F.nullif(raw, F.lit("")))
    number = lambda k: F.when(is_object(raw), _at(raw, k).try_cast("double"))
    return F.struct(text.alias("reference_range"), text.alias("reference_range_text"), number("low").alias("reference_range_low"), number("high").alias("reference_range_high"))


def served_address(raw: Column) -> Column:
    """A text is all street; of an object the four parts."""
    part = lambda k: F.when(is_object(raw), _at(raw, k))
    return F.when(F.nullif(raw, F.lit("")).isNotNull(), F.struct(F.coalesce(part("street"), F.when(~is_object(raw), raw)).alias("street"), *(part(k).alias(k) for k in ("city", "state", "zip"))))


def coerced_range(raw: Column) -> Column:
    """struct(text, low, high): signed bounds of a text a-b, or of an object under any of its names."""
    number = "(-?[0-9]+(?:[.][0-9]+)?)"
    pattern = f"^[ ]*{number}[ ]*[-–][ ]*{number}[ ]*$"
    first = lambda *keys: F.coalesce(*(_at(raw, k) for k in keys))
    bound = lambda i, *keys: F.when(is_object(raw), first(*keys).try_cast("double")).otherwise(F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")).try_cast("double"))
    return F.struct(F.when(is_object(raw), first("text", "raw", "value")).otherwise(raw).alias("text"), bound(1, "low", "min").alias("low"), bound(2, "high", "max").alias("high"))


def served_rows(rows: DataFrame) -> DataFrame:
    """rows(line_number, text, ..., reference_range, flag) with the range's fields and the normalised flag."""
    r = served_range(F.col("reference_range"))
    return rows.withColumns({"_r": r, "flag_norm": T.normalize_flag(F.col("flag"))}).select(*[c for c in rows.columns if c != "reference_range"], "flag_norm", "_r.*")


def merged_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, data) -> a row a document with a struct a section: a top-level object's value, else document_info's, else the payload's.

    A text of ordered_items is split at commas. A section without any value is null.
    """
    data = F.col("data")
    flat = {target: name for name, target in FLAT.items()}
    out = []
    for section, fields in SECTIONS.items():
        values = []
        for field in fields:
            top = _at(data, section, field) if section != "performing_lab" else F.lit(None)
            info = F.nullif(_at(data, "document_info", flat[section, field]), F.lit("")) if (section, field) in flat else F.lit(None)
            values.append(F.coalesce(top, info, _at(data, "ehr_payload", section, field)).cast("string").alias(field))
        if section == "report":
            items = values.pop()
            listed = F.coalesce(F.from_json(items, "array<string>"), F.transform(F.split(F.trim(items), ","), lambda x: F.trim(x)))
            values.append(F.when(F.trim(items) != "", listed).alias("ordered_items"))
        whole = F.struct(*values)
        out.append(F.when(F.greatest(*(whole[f].isNotNull() for f in fields)), whole).alias(section))
    return docs.select("doc_id", *out)


def filled_fields(merged: DataFrame) -> DataFrame:
    """section, filled: fields that aren't null over all documents."""
    counts = [F.sum(sum((F.col(f"{s}.{f}").isNotNull().cast("long") for f in fields), F.lit(0))).alias(s) for s, fields in SECTIONS.items()]
    one = merged.agg(*counts)
    return one.unpivot([], list(SECTIONS), "section", "filled").select("section", F.coalesce("filled", F.lit(0)).alias("filled"))


def report_json(merged: DataFrame, panels: DataFrame) -> DataFrame:
    """doc_id, report: one JSON text a document with its sections and its panels; nulls are left out."""
    lists = panels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("panel_no", "panel_name", "n_tests"))).alias("lab_panels"))
    whole = F.struct(F.struct(*SECTIONS).alias("document_info"), F.coalesce("lab_panels", F.array().cast("array<struct<panel_no:long,panel_name:string,n_tests:long>>")).alias("lab_panels"))
    return merged.join(lists, "doc_id", "left").select("doc_id", F.to_json(whole).alias("report"))


def document_metrics(tests: DataFrame) -> DataFrame:
    """tests(doc_id, panel_no, confidence, needs_review) -> panels, tests, weak tests, panels in review, tests a panel."""
    panels = tests.groupBy("doc_id", "panel_no").agg(F.count("*").alias("n"), F.count(F.when(F.col("confidence") < L.LOW_CONFIDENCE, 1)).alias("weak"), F.bool_or("needs_review").alias("review"))
    out = panels.groupBy("doc_id").agg(F.count("*").alias("panels"), F.sum("n").alias("tests"), F.sum("weak").alias("weak_tests"), F.count(F.when(F.col("review"), 1)).alias("panels_in_review"))
    return out.withColumn("tests_a_panel", F.round(F.col("tests") / F.col("panels") + 1e-9, 6))


def field_issues(scores: Column) -> Column:
    """Of a struct of field scores: the names under their floor, the weakest and the strongest field."""
    under = F.array_compact(F.array(*(F.when(scores[k] < floor, F.lit(k)) for k, floor in L.FIELD_FLOORS.items())))
    each = F.array(*(F.struct(scores[k].alias("s"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(L.FIELD_FLOORS)))
    best = F.array(*(F.struct((-scores[k]).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(L.FIELD_FLOORS)))
    return F.struct(F.array_join(under, ",").alias("issues"), F.array_min(each)["name"].alias("weakest"), F.array_min(best)["name"].alias("strongest"))


def top_predictions(lines: DataFrame, n: int = 3) -> DataFrame:
    """lines(id, probabilities: map of class to probability) -> the n likeliest, ties by name."""
    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("label")))
    best = F.slice(F.array_sort(entries), 1, n)
    return lines.select("id", F.posexplode(best).alias("place", "b")).select("id", (F.col("place") + 1).alias("place"), F.col("b.label").alias("label"), F.round(-F.col("b.p"), 6).alias("probability"))


def review_state(values: DataFrame, log: DataFrame) -> DataFrame:
    """values(doc_id, field, value), log(doc_id, field, seq, op, new) -> the value after the last correction, and if it was corrected; unset is null."""
    last = log.groupBy("doc_id", "field").agg(F.max_by(F.struct("op", "new"), "seq").alias("c"))
    now = F.when(F.col("c").isNull(), F.col("value")).when(F.col("c.op") == "unset", F.lit(None)).otherwise(F.col("c.new"))
    return values.join(last, ["doc_id", "field"], "left").select("doc_id", "field", now.alias("value"), F.col("c").isNotNull().alias("corrected"))


def change_counts(changes: DataFrame) -> DataFrame:
    """changes(kind) -> a count for each of the four kinds, zero where there is none."""
    kinds = changes.sparkSession.createDataFrame([(k,) for k in ("added", "removed", "modified", "unchanged")], "kind string")
    return kinds.join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
