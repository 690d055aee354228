"""Queries that write files and read them back, by each of the sinks and sources."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import labels, registry
from panelspark.plans.documents import _case, _cat
from panelspark.sources import files, lines
from panelspark.sources.scratch import scratch
from panelspark.streaming import inbox, ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT c_custkey AS doc_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = scratch(spark, "reports"), F.col("c_custkey")
    files.write_reports(_t(spark, sf_dir, "customer").select(k.alias("doc_id"), F.struct(F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment")).alias("document_info")), path)
    return files.json_lines(spark, path, "doc_id long, document_info struct<name:string,segment:string>").select("doc_id", "document_info.*")


@query("""WITH l AS (SELECT n_nationkey AS k, n_name AS text, row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no FROM nation)
SELECT shape, line_no, text, CAST(k % 3 AS INT) AS page, k / 100.0::DOUBLE AS y, k % 2 = 0 AS is_bold FROM l, (SELECT unnest(['list', 'lines', 'data']) AS shape)""")
def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in each of the three shapes that line files have."""
    nation = _t(spark, sf_dir, "nation")
    line = F.struct(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3).alias("page"), F.col("n_name").alias("text"), (F.col("n_nationkey") / 100).alias("yNorm"), (F.col("n_nationkey") % 2 == 0).alias("isBold"))
    listed = F.to_json(F.array_sort(F.collect_list(line)))
    out = None
    for shape, text in {"list": listed, "lines": _cat('{"lines": ', listed, "}"), "data": _cat('{"data": {"lines": ', listed, "}}")}.items():
        path = scratch(spark, f"lines-{shape}")
        nation.agg(text.alias("value")).coalesce(1).write.text(path)
        read = lines.read_lines(spark, path).select(F.lit(shape).alias("shape"), "line_no", "text", "page", F.col("y_norm").alias("y"), "is_bold")
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT p_partkey AS id, p_name AS text FROM part")
def json_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines appended in two goes."""
    path, part = scratch(spark, "training"), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    for k in (0, 1):
        part.where(F.col("id") % 2 == k).write.mode("append").json(path)
    return files.json_lines(spark, path, "id long, text string")


@query("SELECT kind, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN 'JUNK' ELSE 'TEST_ROW' END AS role, CAST(p_size AS VARCHAR) AS font_size, 'none' AS source FROM part, (SELECT unnest(['csv', 'json']) AS kind)")
def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines from CSV and from JSON, told apart by what is in them."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 3 != 0, "TEST_ROW").alias("label"), F.col("p_size").alias("fontSize"))
    path = scratch(spark, "tagged")
    files.write_training_set(rows, path)
    defaults = {"text": "", "role": "JUNK", "font_size": "12", "source": "none"}
    read = [files.tagged_lines(spark, f"{path}/{folder}", defaults).withColumn("kind", F.lit(kind)) for folder, kind in (("csv", "csv"), ("jsonl", "json"))]
    return read[0].unionByName(read[1])


_LOG_KINDS = "SELECT DISTINCT s_nationkey % 3 AS kind, s_nationkey FROM supplier"


@query(f"WITH k AS ({_LOG_KINDS}) SELECT 'scanned' AS kind, count(*) AS n FROM k UNION ALL SELECT 'lists', count(*) FILTER (kind = 0) FROM k UNION ALL SELECT 'to_migrate', count(*) FILTER (kind = 1) FROM k UNION ALL SELECT 'errors', count(*) FILTER (kind = 2) FROM k")
def correction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each nation's suppliers, at several depths: a list, an object or a broken text."""
    path, k = scratch(spark, "corrections"), F.col("s_nationkey")
    items = F.to_json(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))))
    logs = _t(spark, sf_dir, "supplier").groupBy(k).agg(items.alias("items")).withColumn("deep", k % 4)
    text = F.when(k % 3 == 0, F.col("items")).when(k % 3 == 1, _cat('{"items": ', F.col("items"), "}")).otherwise(F.expr("substring(items, 1, length(items) - 1)"))
    for depth in range(4):
        logs.where(F.col("deep") == depth).select("s_nationkey", text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(f"{path}/{'/'.join('abc'[:depth])}".rstrip("/") if depth else f"{path}/top")
    return registry.shape_stats(files.correction_files(spark, path))


@query("SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY ALL")
def inbox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each nation's suppliers comes into the inbox, and is read as a stream."""
    path = scratch(spark, "inbox")
    _t(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    stream = inbox.inbox(spark, path, "*.txt", scratch(spark, "archive"))
    seen = stream.select(F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("long").alias("nation"), F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")).cast("long").alias("n"))
    return ingest.drained(spark, seen)


@query("SELECT s_nationkey AS nation, 'N' || s_nationkey AS rid, '03_compose' AS stage, count(*) AS n, true AS has_size FROM supplier GROUP BY ALL")
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of each nation's suppliers, written as a file of a stage and scanned with what the file system knows of it."""
    path, raw = scratch(spark, "results"), scratch(spark, "raw")
    items = F.to_json(F.array_sort(F.collect_list(F.col("s_suppkey"))))
    _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(items.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(raw)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(path))
    for row in spark.read.text(raw, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "s_nationkey").toLocalIterator():  # a file a nation
        fs.rename(place(row.p), place(path, f"N{row.s_nationkey}.03_compose.json"))
    found = files.result_files(spark, path)
    return found.select(F.regexp_extract("rid", "N([0-9]+)", 1).cast("long").alias("nation"), "rid", "stage", F.size(F.from_json("data", "array<long>")).cast("long").alias("n"), (F.col("size") > 0).alias("has_size"))


@query("SELECT event_id AS seq, event_type AS kind FROM events")
def log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = scratch(spark, "log"), _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    for k in (0, 1):
        files.append_log(events.where(F.col("seq") % 2 == k), path)
    return spark.read.parquet(path)


@query("SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'job-' || o_orderkey END AS rid, CASE WHEN o_orderkey % 5 = 0 THEN '{broken ' || o_orderkey END AS error FROM orders")
def golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken records are kept, as errors."""
    path, k = scratch(spark, "golden"), F.col("o_orderkey")
    text = F.when(k % 5 == 0, _cat("{broken ", k)).otherwise(_cat('{"rid": "job-', k, '", "promoted_at": "2024"}'))
    _t(spark, sf_dir, "orders").select(text.alias("value")).write.text(path)
    return files.golden_records(spark, path).select("rid", "error")


@query("WITH n AS (SELECT count(DISTINCT s_nationkey) AS n FROM supplier) SELECT unnest(['moved now', 'moved in three days', 'left', 'in the archive']) AS what, unnest([0, n, 0, n]) AS n FROM n")
def archive_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of each nation's suppliers, just written: none is due now, all are in three days."""
    path, archive, now = scratch(spark, "outbox"), scratch(spark, "archive"), datetime.now()
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", F.to_json(F.struct("s_suppkey", "s_name")).alias("value"))
    rows.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    moved = [inbox.archived(spark, path, archive, now + timedelta(days=days), pattern="*.txt") for days in (0, 3)]
    count = lambda folder: spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(folder).select("path").distinct().agg(F.count("*").alias("n"))
    out = spark.createDataFrame([("moved now", moved[0]), ("moved in three days", moved[1])], "what string, n long")
    for what, folder in (("left", path), ("in the archive", archive)):
        out = out.unionByName(count(folder).select(F.lit(what).alias("what"), "n"))
    return out


@query("SELECT '01_lines' AS stage, (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT '02_roles', (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N')")
def stage_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, items = scratch(spark, "stages"), _t(spark, sf_dir, "lineitem")
    files.write_stages({"01_lines": items, "02_roles": items.where("l_returnflag <> 'N'")}, path)
    counts = [spark.read.parquet(f"{path}/{s}").agg(F.count("*").alias("n")).select(F.lit(s).alias("stage"), "n") for s in ("01_lines", "02_roles")]
    return counts[0].unionByName(counts[1])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'TEST_ROW' ELSE 'JUNK' END AS role FROM orders")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelling tasks written a JSON line each, and read as an export."""
    path, k = scratch(spark, "tasks"), F.col("o_orderkey")
    choice = F.struct(F.struct(F.array(_case(k % 2, ["TEST_ROW", "JUNK"])).alias("choices")).alias("value"))
    tasks = _t(spark, sf_dir, "orders").select(k.alias("id"), F.struct(_cat("t", k).alias("text")).alias("data"), F.array(F.struct(F.array(choice).alias("result"))).alias("annotations"))
    tasks.write.json(path)
    return labels.line_labels(labels.tasks(spark.read.text(path).withColumnRenamed("value", "content"))).select("id", "role")
