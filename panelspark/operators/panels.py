"""Panels: carrying headers forward, page breaks, neighbours, codes and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L


def reading_order():
    """A document's rows from first to last."""
    return W.partitionBy("doc_id").orderBy("row_no")


def assign_panels(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, row_no, text, role): adds the last header's text and number; rows before any header have none."""
    header = F.col("role") == "SECTION_PANEL"
    return rows.withColumn("panel_name", F.last(F.when(header, F.col("text")), ignorenulls=True).over(reading_order())).withColumn("panel_no", F.sum(F.when(header, 1).otherwise(0)).over(reading_order()))


def page_breaks(rows: DataFrame) -> DataFrame:
    """Adds ``is_break``: the page is beyond every page before (the first page is 1)."""
    so_far = F.max("page").over(reading_order().rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("is_break", F.col("page") > F.coalesce(so_far, F.lit(1)))


def k_in_m(rows: DataFrame, k: int = 3, m: int = 5) -> DataFrame:
    """Adds ``enough_ahead``: among this row and the next m - 1 there are k result rows in a row."""
    ahead = F.collect_list(F.when(F.col("role") == "TEST_ROW", 1).otherwise(0)).over(reading_order().rowsBetween(0, m - 1))
    best = F.aggregate(ahead, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), lambda s, x: F.struct(F.when(x == 1, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(x == 1, s["run"] + 1).otherwise(0)).alias("best")))
    return rows.withColumn("enough_ahead", best["best"] >= k)


def named_by_lookback(rows: DataFrame, most: int = 8) -> DataFrame:
    """Of result rows: the nearest row up to ``most`` before, on the same page, that looks like a heading."""
    heading = F.col("is_bold") & F.col("text").rlike("[A-Za-z]+ [A-Za-z]+|^[A-Z]{3,}$")
    seen = F.last(F.when(heading, F.struct("page", "text")), ignorenulls=True).over(reading_order().rowsBetween(-most, -1))
    found = rows.withColumn("_h", seen).where(F.col("role") == "TEST_ROW")
    return found.select("doc_id", "row_no", F.when(F.col("_h.page") == F.col("page"), F.col("_h.text")).otherwise("UNNAMED").alias("name"))


def unknown_clusters(rows: DataFrame, gap: int = 5) -> DataFrame:
    """Result rows without a panel, in clusters that a gap of line numbers parts."""
    lone = assign_panels(rows).where(F.col("panel_name").isNull() & (F.col("role") == "TEST_ROW"))
    new = F.when(F.col("row_no") - F.lag("row_no").over(reading_order()) > gap, 1).otherwise(0)
    return lone.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(reading_order())).groupBy("doc_id", "cluster").agg(F.count("*").alias("n_rows"), F.min("row_no").alias("first_row"))


def break_similarity(rows: DataFrame, reach: int = 5) -> DataFrame:
    """At page breaks: how alike the mix of roles is before and after, 1 - sum |a-b| / sum max(a, b, 1)."""
    before, after = reading_order().rowsBetween(-reach, -1), reading_order().rowsBetween(0, reach - 1)
    out = page_breaks(rows)
    terms = []
    for role in ("TEST_ROW", "SECTION_PANEL", "COMMENT"):
        hit = F.when(F.col("role") == role, 1).otherwise(0)
        a, b = F.coalesce(F.sum(hit).over(before), F.lit(0)), F.coalesce(F.sum(hit).over(after), F.lit(0))
        terms.append((F.abs(a - b), F.greatest(a, b, F.lit(1))))
    similarity = 1 - sum(t[0] for t in terms) / sum(t[1] for t in terms)
    return out.withColumn("similarity", F.round(similarity, 6)).where("is_break").select("doc_id", "row_no", "page", "similarity")


def nearest_ranges(cells: DataFrame, near: int = 7) -> DataFrame:
    """For each value cell the range cell nearest in x at about its height, on its page (band join, first of equals)."""
    value = cells.where(F.col("x") == 200).alias("v")
    span = cells.where(F.col("text").rlike("^[0-9]+-[0-9]+$")).alias("r")
    on = (F.col("v.doc_id") == F.col("r.doc_id")) & (F.col("v.page") == F.col("r.page")) & (F.abs(F.col("v.y") - F.col("r.y")) <= near)
    pick = F.min_by(F.col("r.text"), F.struct(F.abs(F.col("r.x") - F.col("v.x")), F.col("r.line_no")))
    return value.join(span, on).groupBy(F.col("v.doc_id").alias("doc_id"), F.col("v.line_no").alias("line_no")).agg(pick.alias("range_text"))


def column_repairs(cells: DataFrame, unit_window: tuple[int, int] = (350, 420), range_window: tuple[int, int] = (430, 520), near: int = 7) -> DataFrame:
    """For each name cell the texts nearest to the centres of the unit and range columns, within their windows."""
    names, others = cells.where(F.col("x") == 60).alias("n"), cells.where(F.col("x") > 60).alias("c")
    on = (F.col("n.doc_id") == F.col("c.doc_id")) & (F.col("n.page") == F.col("c.page")) & (F.abs(F.col("n.y") - F.col("c.y")) <= near)
    joined = names.join(others, on, "left")
    out = []
    for label, (lo, hi) in (("unit_text", unit_window), ("range_text", range_window)):
        centre = (lo + hi) // 2
        inside = F.col("c.x").between(lo, hi)
        out.append(F.min_by(F.when(inside, F.col("c.text")), F.when(inside, F.struct(F.abs(F.col("c.x") - centre), F.col("c.line_no")))).alias(label))
    return joined.groupBy(F.col("n.doc_id").alias("doc_id"), F.col("n.line_no").alias("line_no")).agg(*out)


def codes_near(targets: DataFrame, lines: DataFrame, near: int = 10) -> DataFrame:
    """For each target (doc_id, page, line_no, x, y) the first LOINC and CPT code of the lines at its height, nearest in x first.

    Targets and coded lines don't meet in pairs: a target visits each height of its page within reach that has codes, and there windows in
    the order of x show it the next code on either side. So the work grows with the lines, times the heights within reach.
    """
    c, place = F.col, ["doc_id", "page", "y"]
    found = {kind: F.nullif(F.regexp_extract("text", L.CODE_FORM.format(kind=kind), 1), F.lit("")) for kind in ("LOINC", "CPT")}
    coded = lines.select(*place, "x", "line_no", *(v.alias(k) for k, v in found.items())).where("LOINC is not null or CPT is not null")
    # of codes in one spot the first line's
    spots = coded.groupBy(*place, "x").agg(*(F.min(F.when(c(k).isNotNull(), F.struct("line_no", c(k).alias("code")))).alias(k) for k in found))
    heights = spots.select("doc_id", "page", c("y").alias("_y")).distinct()
    levels = targets.select(*place).distinct().join(heights, ["doc_id", "page"]).where(F.abs(c("y") - c("_y")) <= near)
    visits = targets.join(levels, place).select("doc_id", "page", c("_y").alias("y"), "x", c("line_no").alias("_target"))
    both = visits.unionByName(spots, allowMissingColumns=True)
    across = W.partitionBy(*place)
    sides = {side: across.orderBy(x).rangeBetween(W.unboundedPreceding, 0) for side, x in (("_left", c("x")), ("_right", F.desc("x")))}
    placed = lambda k: F.when(c(k).isNotNull(), F.struct(c("x").alias("x"), c(f"{k}.line_no").alias("line_no"), c(f"{k}.code").alias("code")))
    seen = both.withColumns({f"{side}{k}": F.last(placed(k), ignorenulls=True).over(w) for side, w in sides.items() for k in found}).where(c("_target").isNotNull())
    order = lambda s: F.when(c(s).isNotNull(), F.struct(F.abs(c(f"{s}.x") - c("x")).alias("d"), c(f"{s}.line_no").alias("line_no"), c(f"{s}.code").alias("code")))
    best = lambda k: F.min(F.least(order(f"_left{k}"), order(f"_right{k}")))["code"]
    return seen.groupBy("doc_id", c("_target").alias("line_no")).agg(best("LOINC").alias("loinc"), best("CPT").alias("cpt"))


def is_comment(name: Column, value: Column, units: Column) -> Column:
    """If a row that was read as a result is a comment: a header's label, or neither a digit in its value nor a known unit."""
    name, value = F.coalesce(name, F.lit("")), F.coalesce(value, F.lit(""))
    label = name.endswith(":") & F.greatest(*(name.contains(t) for t in L.HEADER_TERMS))
    return label | (~value.rlike("[0-9]") & ~F.coalesce(units.isin(L.GUARD_UNITS), F.lit(False)))


def likely_header(text: Column, is_bold: Column) -> Column:
    """Two words in bold, two in capitals, or two with two letters on end."""
    words = F.filter(F.split(text, "[ \t]+"), lambda w: w != "")
    count = lambda test: F.size(F.filter(words, test))
    caps = count(lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) >= 2))
    return (is_bold & (F.size(words) >= 2)) | (caps >= 2) | (count(lambda w: w.rlike("[a-zA-Z]{2,}")) >= 2)


def names_panel(text: Column) -> Column:
    """If a text has the name of a panel in it."""
    return F.greatest(*(F.lower(text).contains(w) for w in L.PANEL_INDICATORS))


def panel_notes(lines: DataFrame, ahead: int = 10, foot: int = 5) -> DataFrame:
    """lines(doc_id, page, line_no, role, text) -> doc_id, line_no, comments: footnotes of headers that bear marks.

    A mark's notes are lines of the page that begin with it, among the next ``ahead`` lines of the document and the page's last ``foot``.
    """
    order = W.partitionBy("doc_id").orderBy("line_no")
    page = W.partitionBy("doc_id", "page").orderBy(F.desc("line_no"))
    line = F.struct("line_no", "page", F.trim("text").alias("text"))
    known = lines.withColumns({"_next": F.collect_list(line).over(order.rowsBetween(1, ahead)), "_place": F.row_number().over(page)})
    last = known.where(F.col("_place") <= foot).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(line)).alias("_last"))
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(L.FOOTNOTE_MARKS), F.lit(1)))
    heads = known.where((F.col("role") == "SECTION_PANEL") & (F.size(marks) > 0)).withColumn("_marks", marks).join(last, ["doc_id", "page"])
    of_page = F.filter("_next", lambda x: x["page"] == F.col("page"))
    note = lambda x: F.get(F.filter(F.transform("_marks", lambda m: F.when(x["text"].startswith(m), F.trim(F.substring(x["text"], F.length(m) + 1, F.length(x["text"]))))), lambda n: n.isNotNull() & (n != "")), 0)
    notes = F.array_distinct(F.array_compact(F.transform(F.concat(of_page, "_last"), note)))
    return heads.select("doc_id", "line_no", F.array_join(notes, "; ").alias("comments")).where("comments <> ''")


def expected_panels(rows: DataFrame) -> DataFrame:
    """doc_id, expected, headers: rows that name a panel that reports have, and how many of them have a header's role."""
    named = rows.where(F.col("text").rlike(L.EXPECTED_PANELS))
    return named.groupBy("doc_id").agg(F.count("*").alias("expected"), F.count(F.when(F.col("role") == "SECTION_PANEL", 1)).alias("headers"))


def kept_panels(panels: DataFrame) -> DataFrame:
    """panels(..., n_tests, continuity, reasons array): those with rows and enough continuity; weak continuity is a reason for review."""
    weak = F.col("continuity") < L.WEAK_CONTINUITY
    kept = panels.where((F.col("n_tests") > 0) & (F.col("continuity") >= L.LEAST_CONTINUITY))
    reasons = F.when(weak, F.array_append("reasons", F.lit("continuity"))).otherwise(F.col("reasons"))
    return kept.withColumn("reasons", reasons).withColumn("needs_review", F.size("reasons") > 0)


def panel_id(name: Column, page: Column, place: Column, origin: Column | None = None) -> Column:
    """name-page-place, white space as hyphens, and how the panel came about."""
    return F.concat_ws("-", F.replace(name, F.lit(" "), F.lit("-")), page.cast("string"), place.cast("string"), F.lit(None).cast("string") if origin is None else origin)


def split_rows(rows: DataFrame) -> DataFrame:
    """Result rows without a range whose next row, close below on the same page, is one: they take it."""
    follow = F.lead(F.struct("page", "y", "text")).over(reading_order())
    lone = F.regexp_extract("_n.text", "^([0-9]+-[0-9]+)", 1)
    near = (F.col("_n.page") == F.col("page")) & (F.col("_n.y") - F.col("y") < 60) & (lone != "")
    return rows.withColumn("_n", follow).where((F.col("role") == "TEST_ROW") & ~F.col("text").rlike("[0-9]+-[0-9]+") & near).select("doc_id", "row_no", lone.alias("range_text"))
