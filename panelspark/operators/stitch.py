"""Result rows read from single lines, from fragments beside them, from the lines below and from the columns of their page.

lines: doc_id, line_no, page, x_left, x_right, y (thousandths), text, role. A row is read by one pattern and, failing that,
another; only rows that stay without a value are read a second time, from the fragments near them. Neighbours are
found by windows over a document's lines in order, so lines that lie with their document are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions import lexicons as L
from panelspark.functions.text import _group
from panelspark.operators.panels import is_comment

# Fixed values.
NUMERIC_RESULT = r"^(.+?)\s+([\d.,]+)\s*([a-zA-Z/%]+)?\s*(.*)$"
TEXT_RESULT = r"^(.+?)\s+(NEGATIVE|POSITIVE|NORMAL|ABNORMAL|HIGH|LOW)\s*(.*)$"
RANGE_IN_ROW = r"([\d.,]+)\s*-\s*([\d.,]+)"
FLAG_IN_ROW = r"(?i)\b(HIGH|LOW|CRITICAL|ABNORMAL|H|L|C|A)\b"
VALUE_FRAGMENT = r"^[<>≤≥]?\s*(\d+\.?\d*)\s*([HL*]?)$"
RANGE_FRAGMENT = r"(\d+\.?\d*)\s*[-–—]\s*(\d+\.?\d*)"
FLAG_FRAGMENTS = ["H", "L", "High", "Low", "A", "Abn", "CRITICAL", "PANIC", "*"]
RANGES_BELOW = [r"(?i)\b\d+(\.\d+)?\s*[-–]\s*\d+(\.\d+)?\b", r"[≤≥<>]\s*\d+(\.\d+)?", r"(?i)\b(NORMAL|ABNORMAL|HIGH|LOW|POSITIVE|NEGATIVE)\b"]
RANGE_CELL = r"^\s*[<>]?\d+(\.\d+)?\s*[-–]\s*[<>]?\d+(\.\d+)?\s*$"
UNIT_CELLS = ["mg/dL", "g/dL", "mEq/L", "mmol/L", "uIU/mL", "IU/L", "ng/mL", "pg/mL", "mcg/dL", "ug/dL", "mg/L", "g/L", "%", "U/L", "mU/L", "K/uL", "M/uL"]
COMPLETE = 0.5  # rows read less completely are read again
REACH = 5  # lines on either side
SAME_HEIGHT, SAME_ROW, BELOW = 6, 3, 60  # thousandths of the page
GAP_BONUS = [(28, 0.3), (50, 0.2), (100, 0.1)]  # of x, on average
REPAIRED_SHARE = 0.25
UNIT_WINDOW, RANGE_WINDOW = (350.0, 420.0), (430.0, 520.0)
UNIT_REACH, RANGE_REACH = 40.0, 45.0

FIELDS = ("test_name", "result_value", "units", "reference_range", "flag")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Groups of a pattern that spans the text, by one replacement; null without a match."""
    mark = "\x01"
    found = F.split(F.regexp_replace(text, pattern, mark.join(["", *(f"${i}" for i in range(1, n + 1))])), mark)
    return F.when(F.size(found) == n + 1, F.transform(found, lambda g: F.nullif(F.trim(g), F.lit(""))))


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row: a filter on them stays above, where it doesn't repeat them."""
    rows = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_s")
    return df.select(*df.columns, rows).select(*(c for c in df.columns if c not in columns), "_s.*")


def completeness(fields: dict[str, Column]) -> Column:
    """How much of a row is there: 0.3 for a name or value, 0.3 for a value, 0.2 for units, 0.1 each for range and flag."""
    there = lambda c, share: F.when(c.isNotNull(), share).otherwise(0.0)
    f = fields
    return there(F.coalesce(f["test_name"], f["result_value"]), 0.3) + there(f["result_value"], 0.3) + there(f["units"], 0.2) + there(f["reference_range"], 0.1) + there(f["flag"], 0.1)


def read_lines(lines: DataFrame) -> DataFrame:
    """Result rows of lines with their fields and completeness, each read from its own text."""
    t = F.col("_t")
    out = settled(lines.where("role = 'TEST_ROW'"), {"_t": F.trim("text"), "_n": _groups(F.trim("text"), NUMERIC_RESULT, 4)})
    out = settled(out, {"_w": F.when(F.col("_n").isNull(), _groups(t, TEXT_RESULT, 3))})
    pick = lambda i, j: F.coalesce(F.get("_n", F.lit(i)), F.get("_w", F.lit(j)) if j else F.lit(None))
    fields = {
        "test_name": pick(1, 1),
        "result_value": pick(2, 2),
        "units": pick(3, 0),
        "reference_range": F.coalesce(pick(4, 3), _group(t, RANGE_IN_ROW, 0)),
        "flag": F.upper(_group(t, FLAG_IN_ROW, 0)),
    }
    out = settled(out, fields).drop("_t", "_n", "_w")
    return settled(out, {"completeness": completeness({c: F.col(c) for c in FIELDS})})


def near_lines(lines: DataFrame, reach: int = REACH) -> DataFrame:
    """Adds ``near``: the lines within ``reach`` of each line's number, in order, with what each could be in a row.

    What a fragment could be is asked once a line, not once a neighbour; the window goes by documents and nothing is joined.
    """
    t = F.col("_t")
    value = t.rlike(VALUE_FRAGMENT)
    kinds = {
        "value": F.when(value, _group(t, VALUE_FRAGMENT, 1)),
        "behind": F.when(value, _group(t, VALUE_FRAGMENT, 2)),
        "is_value": value,
        "is_unit": t.isin(L.GUARD_UNITS),
        "is_range": t.rlike(RANGE_FRAGMENT),
        "is_flag": t.isin(FLAG_FRAGMENTS),
        "is_word": t.rlike("[a-zA-Z]") & ~t.rlike("[0-9]"),
    }
    fragment = F.struct("x_left", "line_no", "x_right", "page", "y", "text", t.alias("t"), (F.col("role") == "TEST_ROW").alias("is_row"), *(c.alias(n) for n, c in kinds.items()))
    out = settled(settled(lines, {"_t": F.trim("text")}), {"_fragment": fragment}).drop("_t")
    return out.withColumn("near", F.collect_list("_fragment").over(W.partitionBy("doc_id").orderBy("line_no").rangeBetween(-reach, reach))).drop("_fragment")


def _height_groups(near: Column) -> Column:
    """Runs of an array's lines of which each stands at the height of the one before."""
    last = F.size(near) - 1
    apart = lambda i: (i == 0) | ~F.coalesce(F.abs(F.get(near, i)["y"] - F.get(near, i - 1)["y"]) <= SAME_HEIGHT, F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), last), apart)
    cut = lambda at: F.transform(at, lambda i, k: F.slice(near, i + 1, F.coalesce(F.get(at, k + 1), last + 1) - i))
    return F.get(F.transform(F.array(starts), cut), 0)


def _first(among: Column, test, *used: Column) -> Column:
    """The first fragment that passes and isn't used."""
    return F.get(F.filter(among, lambda x: test(x) & ~_any(x["line_no"] == u["line_no"] for u in used)), F.lit(0))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def stitched(rows: DataFrame) -> DataFrame:
    """Adds ``stitched`` to rows that have ``near`` and aren't complete: the best reading of the groups near them (fields, where the value stands, text, confidence).

    Near are lines of the page that stand at the row's height or are result rows. A group ends where the next line stands higher or
    lower, and counts if it has two lines or more and no wide gap between them. Value, unit, range, flag and name are taken in this
    order, each from a fragment of its own (a flag may stand behind the value); each adds to the confidence, and so does closeness.
    Of equal readings the first group's is taken.
    """
    c = F.col
    near = F.filter("near", lambda x: (x["page"] == c("page")) & ((F.abs(x["y"] - c("y")) <= SAME_HEIGHT) | x["is_row"]))
    out = settled(rows, {"_near": F.when(c("completeness") < COMPLETE, near)}).drop("near")
    out = settled(out, {"_groups": F.when(F.size("_near") >= 2, F.filter(_height_groups(c("_near")), lambda g: F.size(g) >= 2))}).drop("_near")
    ordered = F.transform("_groups", lambda g, k: F.struct(k.alias("k"), F.array_sort(g).alias("all")))
    after = lambda a, use: F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1), use)
    ordered = F.filter(ordered, lambda g: ~F.exists(after(g["all"], lambda b, a: b["x_left"] - a["x_right"]), lambda x: x > L.STITCH_GAP))
    groups, names = F.transform(ordered, lambda g: F.struct(g["k"].alias("k"), g["all"].alias("all"), F.filter(g["all"], lambda x: x["t"] != "").alias("f"))), ["k", "all", "f"]
    groups = F.filter(groups, lambda g: F.size(g["f"]) >= 2)

    def taken(g: Column) -> Column:
        picked = [g[n] for n in "vurgn"]
        return F.filter(g["f"], lambda x: _any(x["line_no"] == p["line_no"] for p in picked))

    def gap(g: Column) -> Column:
        steps = after(g["taken"], lambda b, a: (b["x_left"] - a["x_right"]).cast("double"))
        return F.when(F.size(g["taken"]) >= 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size(g["taken"]) - 1))

    steps = {
        "v": lambda g: _first(g["f"], lambda x: x["is_value"]),
        "u": lambda g: _first(g["f"], lambda x: x["is_unit"], g["v"]),
        "r": lambda g: _first(g["f"], lambda x: x["is_range"], g["v"], g["u"]),
        "g": lambda g: F.when(g["v"]["behind"].isNull(), _first(g["f"], lambda x: x["is_flag"], g["v"], g["u"], g["r"])),
        "w": lambda g: _first(g["f"], lambda x: x["is_word"], g["v"], g["u"], g["r"], g["g"]),
        "n": lambda g: F.coalesce(g["w"], _first(g["f"], lambda x: F.lit(True), g["v"], g["u"], g["r"], g["g"])),
        "taken": taken,
        "gap": gap,
    }
    for name, of in steps.items():
        groups = F.transform(groups, lambda g: F.struct(*(g[n].alias(n) for n in names), of(g).alias(name)))  # noqa: B023
        names.append(name)

    def reading(g: Column) -> Column:
        bonus = F.when(g["gap"].isNull(), 0.0)
        for most, more in GAP_BONUS:
            bonus = bonus.when(g["gap"] <= most, more)
        has = lambda x, share: F.when(x.isNotNull(), share).otherwise(0.0)
        confidence = has(g["v"], 0.2) + has(g["v"]["behind"], 0.1) + has(g["u"], 0.2) + has(g["r"], 0.2) + has(g["g"], 0.1) + bonus.otherwise(0.0)
        read = F.struct(
            g["n"]["t"].alias("test_name"),
            g["v"]["value"].alias("result_value"),
            g["u"]["t"].alias("units"),
            g["r"]["t"].alias("reference_range"),
            F.coalesce(g["v"]["behind"], g["g"]["t"]).alias("flag"),
            g["v"]["x_left"].alias("value_left"),
            g["v"]["x_right"].alias("value_right"),
            F.size(g["taken"]).cast("long").alias("n_used"),
            F.array_join(F.filter(F.transform(g["all"], lambda x: x["text"]), lambda t: t != ""), " ").alias("text"),
            F.least(confidence, F.lit(1.0)).alias("confidence"),
        )
        return F.struct(F.least(confidence, F.lit(1.0)).alias("confidence"), (-g["k"]).alias("k"), read.alias("read"))

    says = lambda r: (r["read"]["result_value"].isNotNull() | r["read"]["test_name"].isNotNull()) & (r["confidence"] > 0)
    out = settled(out, {"_groups": groups})
    return settled(out, {"stitched": F.array_max(F.filter(F.transform("_groups", reading), says))["read"]}).drop("_groups")


def read_rows(lines: DataFrame) -> DataFrame:
    """Result rows with their fields: read from the line and, where that gives no value, from the fragments near it if these say more.

    doc_id, line_no, page, y, role, text and the other columns of lines; test_name, result_value, units, reference_range, flag,
    completeness of the first reading, is_stitched, stitch_confidence.
    """
    out = stitched(read_lines(near_lines(lines)))
    better = F.coalesce(F.col("stitched.confidence") > F.col("completeness"), F.lit(False)) & (F.col("completeness") < COMPLETE)
    out = out.withColumn("is_stitched", better)
    taken = {f: F.when(F.col("is_stitched"), F.coalesce(F.col(f"stitched.{f}"), F.col(f))).otherwise(F.col(f)) for f in FIELDS}
    taken |= {"text": F.when(F.col("is_stitched"), F.col("stitched.text")).otherwise(F.col("text")), "stitch_confidence": F.when(F.col("is_stitched"), F.col("stitched.confidence"))}
    return out.withColumns(taken).drop("stitched")


def _unit_in(text: Column) -> Column:
    return F.get(F.filter(F.split(text, r"\s+"), lambda w: w.isin(L.GUARD_UNITS)), F.lit(0))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order that aren't used up, with the neighbour each takes (``took``: 1, 2 or 0). Between batches two truths are kept: whether the last row uses up the next, and the one after."""
    use, use_next = False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        may, g1, n1, e1, g2, e2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_may_go", "_1gives", "_1near", "_1empties", "_2gives", "_2empties"))
        # a row that can't be used up, nor the one after it, begins anew: near and giving is enough
        took = np.where(g1, 1, np.where(n1 & g2, 2, 0)).astype(np.int32)
        uses, uses_next, gone = (took == 1) & e1, (took == 2) & e2, np.zeros(batch.num_rows, bool)
        for i in np.flatnonzero(may).tolist():
            if i:
                use, use_next = uses[i - 1], uses_next[i - 1]
            first = not use and not use_next and g1[i]
            second = not use and not first and (use_next or n1[i]) and g2[i]
            took[i], gone[i] = 1 if first else 2 if second else 0, use
            uses[i], uses_next[i] = use_next or (first and e1[i]), second and e2[i]
        use, use_next = uses[-1], uses_next[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(took)], names=[*batch.schema.names, "took"]).filter(pa.array(~gone))


def merged_below(rows: DataFrame) -> DataFrame:
    """Rows of panels whose unit or range stands on one of the next two lines: they take it, and a line with nothing left is gone.

    rows: read_rows() with panel_no. Adds merged_from (the line that was used); rows that were used up are left out. In the order
    of a panel's rows, each that has a value but lacks a unit or a range, and is no comment, looks at the next row and then at the one
    after it, and takes the first that is near and has something it lacks; a row that is used up before its turn neither takes nor gives.

    What a row could take from each neighbour doesn't depend on what others take, so windows find it; only who is used up does.
    That can only pass from a row to the next two, so only rows that may be used up are looked at one by one, in order.
    """
    c = F.col
    order = W.partitionBy("doc_id", "panel_no").orderBy("line_no")
    below = {k: F.lead(F.struct("line_no", "page", "y", "text"), k).over(order) for k in (1, 2)}
    out = rows.withColumns({"_1": below[1], "_2": below[2]})
    wants = c("result_value").isNotNull() & (c("units").isNull() | c("reference_range").isNull()) & ~is_comment(c("test_name"), c("result_value"), c("units"))
    for k in ("_1", "_2"):
        text = c(f"{k}.text")
        span = F.coalesce(*(_group(text, p, 0) for p in RANGES_BELOW))
        out = out.withColumns({f"{k}unit": F.when(c("units").isNull(), _unit_in(text)), f"{k}range": F.when(c("reference_range").isNull(), span)})
        rest = F.trim(text)
        for piece in (c(f"{k}unit"), c(f"{k}range")):
            rest = F.trim(F.when(piece.isNotNull(), F.replace(rest, piece, F.lit(""))).otherwise(rest))
        near = F.coalesce((c(f"{k}.page") == c("page")) & (F.abs(c(f"{k}.y") - c("y")) < BELOW), F.lit(False))
        gives = c(f"{k}unit").isNotNull() | c(f"{k}range").isNotNull()
        out = out.withColumns({f"{k}near": wants & near, f"{k}gives": wants & near & gives})
        out = out.withColumn(f"{k}empties", c(f"{k}gives") & (F.length(F.regexp_replace(rest, r"[^\p{L}\p{N}_]", "")) <= 2))
    may_go = F.coalesce(F.lag("_1empties", 1).over(order), F.lit(False)) | F.coalesce(F.lag("_2empties", 1).over(order), F.lit(False)) | F.coalesce(F.lag("_2empties", 2).over(order), F.lit(False))
    told = [f"{k}{w}" for k in ("_1", "_2") for w in ("gives", "near", "empties")]
    out = out.withColumns({"_may_go": may_go} | {f"{k}line": c(f"{k}.line_no") for k in ("_1", "_2")} | {n: F.coalesce(n, F.lit(False)) for n in told}).drop("_1", "_2")
    out = out.sortWithinPartitions("doc_id", "panel_no", "line_no")
    out = out.mapInArrow(_walked, T.StructType([*(T.StructField(f.name, f.dataType) for f in out.schema), T.StructField("took", T.IntegerType())]))
    got = lambda what: F.when(c("took") == 1, c(f"_1{what}")).when(c("took") == 2, c(f"_2{what}"))
    out = out.withColumns({"units": F.coalesce("units", got("unit")), "reference_range": F.coalesce("reference_range", got("range")), "merged_from": got("line")})
    return out.drop("took", "_may_go", *told, *(f"{k}{w}" for k in ("_1", "_2") for w in ("line", "unit", "range")))


def merge_reasons(rows: DataFrame) -> DataFrame:
    """Panels of merged_below() rows of which over a quarter were merged: doc_id, panel_no, n_merged, n_rows, reason."""
    return _repaired(rows.groupBy("doc_id", "panel_no").agg(F.count("merged_from").alias("n_merged"), F.count("*").alias("n_rows")))


def merge_reasons_in_order(rows: DataFrame) -> DataFrame:
    """merge_reasons() of rows as merged_below() leaves them, a panel's on end in one partition: counted as they come, without a shuffle."""
    some = rows.select("doc_id", "panel_no", "merged_from")
    kinds = {f.name: f.dataType for f in some.schema}
    schema = T.StructType([*(T.StructField(n, kinds[n]) for n in ("doc_id", "panel_no")), *(T.StructField(n, T.LongType()) for n in ("n_merged", "n_rows"))])
    return _repaired(some.mapInArrow(_counted, schema))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and merged rows of each panel; the last panel of a batch waits for the next."""
    waiting = None
    for batch in batches:
        one = pa.Table.from_batches([batch]).group_by(["doc_id", "panel_no"], use_threads=False).aggregate([("merged_from", "count"), ([], "count_all")])
        one = one.select(["doc_id", "panel_no", "merged_from_count", "count_all"]).rename_columns(["doc_id", "panel_no", "n_merged", "n_rows"])
        if waiting is not None:
            one = pa.concat_tables([waiting, one]).group_by(["doc_id", "panel_no"], use_threads=False).aggregate([("n_merged", "sum"), ("n_rows", "sum")])
            one = one.rename_columns(["doc_id", "panel_no", "n_merged", "n_rows"])
        if one.num_rows:
            waiting = one.slice(one.num_rows - 1)
            yield from one.slice(0, one.num_rows - 1).combine_chunks().to_batches()
    if waiting is not None:
        yield from waiting.combine_chunks().to_batches()


def _repaired(n: DataFrame) -> DataFrame:
    reason = F.format_string("High split-row repair rate: %d/%d rows repaired", "n_merged", "n_rows")
    return n.where(F.col("n_merged") > REPAIRED_SHARE * F.col("n_rows")).withColumn("reason", reason)


def with_column_cells(lines: DataFrame) -> DataFrame:
    """Adds ``column_unit`` and ``column_range``: what stands at a line's height in the page's column of units and of ranges.

    A column lies about the median x of the page's lines that are nothing but a unit, or a range; a page without any has fixed
    columns. Of several lines the nearest to the column's middle is taken, the first of equals.
    """
    c, cell, page = F.col, F.trim("text"), W.partitionBy("doc_id", "page")
    placed = settled(lines, {"_unit": cell.isin(UNIT_CELLS), "_range": cell.rlike(RANGE_CELL), "_x": c("x_left").cast("double")})
    out = placed.withColumns({f"{kind}_x": F.median(F.when(c(f"_{kind}"), c("_x"))).over(page) for kind in ("unit", "range")})
    beside = page.orderBy("y").rangeBetween(-SAME_ROW, SAME_ROW)

    def nearest(kind: str, window: tuple[float, float], reach: float) -> Column:
        middle = F.coalesce(c(f"{kind}_x"), F.lit(sum(window) / 2))
        inside = F.when(c(f"{kind}_x").isNotNull(), F.abs(c("_x") - middle) <= reach).otherwise(c("_x").between(*window))
        fits = c(f"_{kind}") & inside & c("y").isNotNull() & c("page").isNotNull()
        return F.min_by(F.when(fits, F.trim("text")), F.when(fits, F.struct(F.abs(c("_x") - middle), c("line_no")))).over(beside)

    out = out.withColumns({"column_unit": nearest("unit", UNIT_WINDOW, UNIT_REACH), "column_range": nearest("range", RANGE_WINDOW, RANGE_REACH)})
    return out.drop("_unit", "_range", "_x", "unit_x", "range_x")


def filled(rows: DataFrame) -> DataFrame:
    """Rows of with_column_cells() lines that still lack a unit or a range take it from their page's columns. Adds filled (what was taken)."""
    c = F.col
    lacks = {"_u": ("units", "column_unit"), "_r": ("reference_range", "column_range")}
    out = rows.withColumns({n: F.when(c("result_value").isNotNull() & c(f).isNull(), c(there)) for n, (f, there) in lacks.items()})
    what = F.nullif(F.concat_ws(",", *(F.when(c(n).isNotNull(), F.lit(f)) for n, (f, _) in lacks.items())), F.lit(""))
    return out.withColumns({"filled": what, "units": F.coalesce("units", "_u"), "reference_range": F.coalesce("reference_range", "_r")}).drop("_u", "_r", "column_unit", "column_range")


def filled_from_columns(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """filled() for rows that were read from lines without their columns: these are looked up by line."""
    cells = with_column_cells(lines).select("doc_id", "line_no", "column_unit", "column_range").where("column_unit is not null or column_range is not null")
    return filled(rows.join(cells, ["doc_id", "line_no"], "left"))


def composed_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of panels with their fields and scores, panels with their scores and reasons) of documents.

    rows: doc_id, row_no, page, y, x_left, x_right, text, role, is_bold, font. Panels are composed, rows read, stitched, merged with the lines
    below them and filled from the columns of their page, then scored.
    """
    from panelspark.operators import compose, scoring
    from panelspark.operators import rows as R
    from panelspark.sources.scratch import scratch

    spark, c = rows.sparkSession, F.col
    placed = compose.composed(rows.withColumn("unit", R.coarse_fields(c("text"))["unit"]))
    lines = rows.withColumnRenamed("row_no", "line_no")
    read = read_rows(with_column_cells(lines)).join(placed.select("doc_id", F.col("row_no").alias("line_no"), F.col("panel").alias("panel_no"), F.col("name").alias("panel_name"), "origin", "continuity"), ["doc_id", "line_no"])
    full = filled(merged_below(read))
    scores = {"value_s": R.value_score(c("result_value")), "unit_s": R.unit_score(c("units")), "range_s": R.range_score(c("reference_range")), "name_s": R.name_score(c("test_name"))}
    full = settled(full, scores).withColumn("confidence", R.row_confidence(c("value_s"), c("unit_s"), c("range_s"), c("name_s"), F.lit(None).cast("double")))
    path = scratch(spark, "results")
    full.write.parquet(path)
    full = spark.read.parquet(path)
    names = full.groupBy("doc_id", "panel_no").agg(F.first("panel_name").alias("panel_name"), F.first("origin").alias("origin"))
    panels = scoring.panel_scores(full).join(names, ["doc_id", "panel_no"]).join(merge_reasons(full).select("doc_id", "panel_no", "reason"), ["doc_id", "panel_no"], "left")
    reasons = F.concat_ws(",", F.nullif("reasons", F.lit("")), "reason")
    panels = panels.withColumns({"reasons": reasons, "needs_review": c("needs_review") | c("reason").isNotNull()}).drop("reason")
    return full, panels
