"""Positioned lines of text: readers, and a synthetic view of them over ordinary tables.

A line has (doc_id, line_no, page, x, y, text, is_bold, font): y in thousandths of the page height, 0 at
the top; line_no is its place in reading order, fixed at the source, because order is identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES_DDL = "doc_id string, line_no long, page int, text string, x_left double, x_right double, y_norm double, font_size double, is_bold boolean, has_text boolean, source string"

PANEL_NAMES = ["COMPREHENSIVE METABOLIC PANEL", "CBC", "LIPID PANEL", "Thyroid Panel", "BASIC METABOLIC PANEL"]
TEST_NAMES = ["Glucose", "Sodium", "Potassium", "WBC", "HGB", "TSH", "Total Protein", "Remark code"]
TEST_UNITS = ["mg/dL", "mmol/L", "g/dL", "10^3/uL", "%", "uIU/mL", "furlong"]


#: Items a partition: what is made of them, about five lines each, is sorted in a task's memory, however large the table.
ITEMS_A_PARTITION, LEAST_ITEMS = 100_000, 10_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with an order's items (doc_id) together, in partitions by its number of rows; what follows goes by documents and shuffles no more."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, usual = items.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // ITEMS_A_PARTITION), min(usual, -(-n // LEAST_ITEMS)))
    return items.withColumnRenamed("l_orderkey", "doc_id").repartition(parts, "doc_id")


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def synthetic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of report pages made from lineitem: an order is a document, three of its items a page."""
    items = _items(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    items = items.select("doc_id", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("qty"), (F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).alias("k"))
    items = items.withColumns({"page": F.expr("cast(1 + k div 3 as int)"), "slot": F.expr("cast(k % 3 as int)"), "base": F.expr("cast(100 + k % 3 * 250 as int)")})

    def cell(when, y, x: int, text, bold=None, font: int = 10):
        bold = F.lit(False) if bold is None else bold
        return F.when(when, F.struct(y.cast("int").alias("y"), F.lit(x).alias("x"), text.alias("text"), bold.alias("is_bold"), F.lit(font).alias("font")))

    p, s, base = F.col("l_partkey"), F.col("l_suppkey"), F.col("base")
    first = F.col("slot") == 0
    unit = F.when(s % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), _pick(TEST_UNITS, "l_partkey")))
    low = p % 50
    cells = [
        cell(first, F.lit(10), 50, F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of report")), font=8),
        cell(first & (F.col("page") == 1), F.lit(40), 50, F.concat(F.lit("Patient: P"), (F.col("doc_id") % 1000).cast("string"), F.lit(" DOB: 01/02/1970"))),
        cell(first & (s % 7 != 0), base - 40, 50, _pick(PANEL_NAMES, "l_partkey"), p % 5 != 3, 12),
        cell(F.lit(True), base, 60, _pick(TEST_NAMES, "l_partkey")),
        cell(F.lit(True), base + p % 4, 200, F.concat(F.col("qty").cast("string"), unit)),
        cell(s % 5 != 0, base + 5 + p % 3, 430, F.concat(low.cast("string"), F.lit("-"), (low + 10 + p % 40).cast("string"))),
        cell(F.col("l_returnflag") != "N", base + 2, 520, F.when(F.col("l_returnflag") == "R", "H").otherwise("L")),
        cell(p % 9 == 0, base + 60, 60, F.lit("specimen slightly hemolyzed")),
    ]
    out = items.select("doc_id", "page", "k", F.explode(F.array(*cells)).alias("c")).where("c is not null").select("doc_id", "page", "k", "c.*")
    return out.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "y", "x", "text", "k")).cast("long")).drop("k")


FRAGMENT_KINDS = 9


def synthetic_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages made from lineitem, six items a page, in which a result stands in one line, in fragments side by side, on lines below each other or in far columns."""
    items = _items(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    items = items.select("doc_id", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("int").cast("string").alias("qty"), (F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).alias("k"))
    c, text = F.col, lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    low = c("p") % 50
    items = items.withColumns(
        {
            "page": F.expr("cast(1 + k div 6 as int)"),
            "y0": F.expr("cast(90 + k % 6 * 140 as int)"),
            "kind": (c("p") + c("s")) % FRAGMENT_KINDS,
            "name": _pick(TEST_NAMES, "p"),
            "unit": _pick(TEST_UNITS, "p"),
            "span": F.concat(low.cast("string"), F.lit("-"), (low + 10 + c("p") % 40).cast("string")),
            "mark": F.when(c("f") == "R", " H").when(c("f") == "A", " L").otherwise(""),
            "word": F.when(c("s") % 2 == 0, "NEGATIVE").otherwise("Positive"),
        }
    )

    def cell(when, dy, left: int, right: int, what, role=None):
        role = F.lit("TEST_ROW") if role is None else role
        return F.when(when, F.struct((c("y0") + dy).cast("int").alias("y"), F.lit(left).alias("x_left"), F.lit(right).alias("x_right"), what.alias("text"), role.alias("role")))

    kind, lit = lambda n: c("kind") == n, F.lit
    side = F.when(c("p") % 3 == 0, "COMMENT").otherwise("TEST_ROW")
    sway = c("p") % 4 * 2
    cells = [
        cell((c("k") % 6 == 0) & (c("s") % 7 != 0), lit(-40), 50, 250, _pick(PANEL_NAMES, "p"), lit("SECTION_PANEL")),
        cell(kind(0), lit(0), 60, 300, text(c("name"), " ", c("qty"), " ", c("unit"), " ", c("span"), c("mark"))),
        cell(kind(1), lit(0), 60, 100, c("name")),
        cell(kind(1), sway, 110, 130, text(c("qty"), c("mark"))),
        cell(kind(1), sway, 140, 170, c("unit"), side),
        cell(kind(1), lit(1), 180, 230, c("span"), side),
        cell(kind(2), lit(0), 60, 80, c("qty")),
        cell(kind(2), lit(2), 90, 120, c("unit"), side),
        cell(kind(2), sway, 130, 180, c("span")),
        cell(kind(2), lit(0), 190, 250, c("name")),
        cell(kind(2) & (c("f") != "N"), lit(0), 260, 270, F.trim(c("mark")), side),
        cell(kind(3), lit(0), 60, 130, text(c("name"), " ", c("qty"))),
        cell(kind(3), lit(20), 60, 90, c("unit")),
        cell(kind(3), lit(40), 60, 100, c("span")),
        cell(kind(4), lit(0), 60, 130, text(c("name"), " ", c("qty"))),
        cell(kind(4), 20 + c("p") % 3 * 25, 60, 140, text(c("unit"), " ", c("span"))),
        cell(kind(5), lit(0), 60, 200, text(c("name"), " screen ", c("word"), F.when(c("p") % 2 == 0, " <5").otherwise(""))),
        cell(kind(6), lit(0), 60, 100, c("name")),
        cell(kind(6), lit(0), 140, 170, c("qty")),
        cell(kind(7), lit(0), 60, 130, text(c("name"), " ", c("qty"))),
        cell(kind(7), c("p") % 5, 365 + 0, 395, c("unit"), lit("COMMENT")),
        cell(kind(7), lit(1), 460, 500, c("span"), lit("COMMENT")),
        # lines that are used up by the one before and would use up the next
        cell(kind(8), lit(0), 60, 130, text(c("name"), " ", c("qty"))),
        cell(kind(8), lit(20), 60, 130, text("x ", low.cast("string"), " %")),
        cell(kind(8), lit(40), 60, 130, lit("mg/dL")),
        cell(kind(8), lit(60), 60, 130, text("ok ", c("span"))),
    ]
    out = items.select("doc_id", "page", "k", F.explode(F.array(*cells)).alias("c")).where("c is not null").select("doc_id", "page", "k", "c.*")
    return out.withColumn("line_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "y", "x_left", "text", "role", "k")).cast("long")).drop("k")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line files in any of three shapes: a list of lines, {lines: [...]} or {data: {lines: [...]}}; camelCase keys too."""
    line = "array<struct<page:int,text:string,xLeft:double,xRight:double,yNorm:double,fontSize:double,isBold:boolean,hasText:boolean,x_left:double,x_right:double,y_norm:double,font_size:double,is_bold:boolean,has_text:boolean>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value"))
    # an object isn't read as a list of one
    whole = F.when(F.ltrim("value").startswith("["), F.col("value"))
    lists = F.from_json(F.coalesce(whole, F.get_json_object("value", "$.lines"), F.get_json_object("value", "$.data.lines")), line)
    one = raw.select("source", F.posexplode(lists).alias("line_no", "l"))
    both = lambda a, b, default=None: F.coalesce(*(F.col(f"l.{x}") for x in (a, b)), F.lit(default))
    return one.select(
        F.regexp_replace("source", r"[.]json$", "").alias("doc_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.coalesce("l.page", F.lit(1)).alias("page"),
        F.coalesce("l.text", F.lit("")).alias("text"),
        both("x_left", "xLeft").alias("x_left"),
        both("x_right", "xRight").alias("x_right"),
        both("y_norm", "yNorm", 0.0).alias("y_norm"),
        both("font_size", "fontSize", 12.0).alias("font_size"),
        both("is_bold", "isBold", False).alias("is_bold"),
        both("has_text", "hasText", True).alias("has_text"),
        "source",
    )


def chunked_pages(docs: DataFrame, chars: int = 400) -> DataFrame:
    """Texts of documents as pages of so many characters."""
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chars).cast("int")), lambda i: F.struct((i + 1).cast("int").alias("page"), F.substring("text", i * chars + 1, F.lit(chars)).alias("text")))
    return docs.where(F.length("text") > 0).select("doc_id", F.explode(pages).alias("p")).select("doc_id", "p.page", "p.text")
