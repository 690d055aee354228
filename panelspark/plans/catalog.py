"""Queries over values, logs, registries and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import text as T
from panelspark.operators import corrections, meta, registry, roles, training
from panelspark.plans.report import ROLES, _roles
from panelspark.sources.scratch import scratch
from panelspark.streaming import ingest, jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(c):
    return F.round(c + 1e-9, 6)


# Values ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T13:05:00' WHEN o_orderkey % 7 = 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T07:08:09' WHEN o_orderkey % 7 = 6 THEN NULL 
 WHEN o_orderkey % 7 = 1 AND year(o_orderdate) % 100 BETWEEN 1 AND 12 THEN strftime(o_orderdate, '20%d-%y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six ways (and once not at all) and read back.

    Month-first forms are tried anywhere in the text before year-first ones, so 2001-02-03 is read as 01-02-03, as B1's order says.
    """
    d = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, d("MM/dd/yyyy")).when(k == 1, d("yyyy-MM-dd")).when(k == 2, d("MMM dd, yyyy")).when(k == 3, d("dd-MMM-yyyy")).when(k == 4, F.concat(d("yyyy-MM-dd"), F.lit(" 07:08:09"))).when(k == 5, F.concat(F.lit("on "), d("MM/dd/yyyy"), F.lit(" 1:05 pm"))).otherwise("no date 13")
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.normalize_date(text).alias("iso"))


@query("""WITH p AS (SELECT doc_id, regexp_extract(text, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}') AS t FROM documents), d AS (SELECT doc_id, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM p WHERE t <> '')
SELECT doc_id, '(' || substr(d, 2, 3) || ') ' || substr(d, 5, 3) || '-' || substr(d, 8, 4) AS phone FROM d""")
def norm_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract("text", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", 0)
    return _t(spark, sf_dir, "documents").where(found != "").select("doc_id", T.normalize_phone(found).alias("phone"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 3 THEN p_size END::DOUBLE AS low, CASE p_partkey % 6 WHEN 0 THEN p_size + 10 WHEN 2 THEN p_size WHEN 3 THEN p_size WHEN 5 THEN p_size END::DOUBLE AS high FROM part""")
def parse_ref_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(n, F.lit(" – "), (F.col("p_size") + 10).cast("string"))).when(k == 1, F.concat(F.lit(">= "), n)).when(k == 2, F.concat(F.lit("<"), n)).when(k == 3, F.concat(F.lit(" "), n)).when(k == 4, F.lit("negative")).otherwise(F.concat(F.lit("≤ "), n))
    r = T.parse_range(text)
    return _t(spark, sf_dir, "part").select("p_partkey", r["low"].alias("low"), r["high"].alias("high"))


@query("""SELECT c_custkey, (c_custkey % 999) || ' Main St' AS street, 'Town' || (c_nationkey) AS city, CASE WHEN c_custkey % 3 <> 0 THEN 'CA' END AS state, CASE WHEN c_custkey % 3 <> 0 THEN CAST(10000 + c_custkey % 89999 AS VARCHAR) END AS zip FROM customer""")
def split_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    block = F.concat((k % 999).cast("string"), F.lit(" Main  St,  Town"), F.col("c_nationkey").cast("string"), F.when(k % 3 != 0, F.concat(F.lit(",\n CA "), (10000 + k % 89999).cast("string"))).otherwise(""))
    return _t(spark, sf_dir, "customer").select("c_custkey", T.split_address(block).alias("a")).select("c_custkey", "a.*")


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'H' WHEN 1 THEN 'L' WHEN 2 THEN 'CRIT' WHEN 3 THEN 'ABN' WHEN 4 THEN 'ABN' WHEN 5 THEN NULL WHEN 6 THEN 'SOMETHING ' WHEN 7 THEN 'H' ELSE 'L' END AS flag,
 CASE event_id % 9 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 7 THEN 'HIGH' WHEN 4 THEN 'ABNORMAL' WHEN 8 THEN 'LOW' END AS word FROM events""")
def norm_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = ["high", " Low", "panic", "A", "abnormal", " ", "something else", "h", "L"]
    text = F.element_at(F.array(*map(F.lit, written)), (F.col("event_id") % 9 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", T.normalize_flag(text).alias("flag"), T.flag_word(text).alias("word"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '10^3/uL' WHEN 1 THEN '10^6/uL' WHEN 2 THEN 'g/dL' WHEN 3 THEN 'mmol/L' ELSE '10^3/uL' END AS unit, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 5 IN (0, 4) WHEN 1 THEN p_partkey % 5 = 3 ELSE true END AS allowed FROM part""")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*map(F.lit, ["x10E3/uL", " 10e6/uL", "g/dL", "mmol/L", "10^3/uL "])), (k % 5 + 1).cast("int"))
    test = F.element_at(F.array(*map(F.lit, ["wbc ", "Sodium", "Unknown"])), (k % 3 + 1).cast("int"))
    unit = T.normalize_unit(raw)
    return _t(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), T.unit_allowed(test, unit).alias("allowed"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'Unnamed Panel' ELSE trim(regexp_replace(p_name, '[ ]+', ' ', 'g')) END AS title FROM part""")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("Ordered Items:  "), name)).when(k == 1, F.concat(F.lit(" panel: "), name, F.lit("  Panel"))).when(k == 2, F.concat(name, F.lit(" SECTION"))).otherwise("Section: ")
    return _t(spark, sf_dir, "part").select("p_partkey", T.clean_title(text).alias("title"))


@query("SELECT o_orderkey, 'job-' || o_orderkey AS rid FROM orders")
def result_id_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ["", ".debug", ".03_compose", ".03_compose.debug", "/", "//"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.result_id(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string"), suffix)).alias("rid"))


_LINES = "ln AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, trim(regexp_replace(text, '[(]cid:[0-9]+[)]', '', 'g')) AS text FROM ln WHERE length(trim(regexp_replace(text, '[(]cid:[0-9]+[)]', '', 'g'))) >= 3")
def filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.clean_line(F.col("text"))
    return _lines(spark, sf_dir).select("doc_id", "line_no", clean.alias("text")).where(F.length("text") >= 3)


@query("""SELECT p_partkey, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(p_type || p_brand, 1, 12), '[^A-Za-z0-9]', '_', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g'), '_', 'X') AS shape,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_type || p_brand, '[^A-Za-z0-9]', '_', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g'), '_', 'X'), 'A+', 'A', 'g'), 'a+', 'a', 'g'), '9+', '9', 'g'), 'X+', 'X', 'g') AS short FROM part""")
def token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_type", "p_brand")
    return _t(spark, sf_dir, "part").select("p_partkey", T.token_shape(text, 12).alias("shape"), T.short_shape(text).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...[truncated]' ELSE text END AS text FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text")).alias("text"))


@query("""SELECT event_id, array_to_string(['panels', CAST(event_id % 5 AS VARCHAR), 'tests', CAST(event_id % 3 AS VARCHAR), 'value'], '>') AS segments FROM events""")
def split_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("event_id") % 5).cast("string"), (F.col("event_id") % 3).cast("string")
    dotted = F.concat(F.lit("panels["), a, F.lit("].tests["), b, F.lit("].value"))
    pointer = F.concat(F.lit("/panels/"), a, F.lit("/tests/"), b, F.lit("/value"))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(T.path_segments(F.when(F.col("event_id") % 2 == 0, dotted).otherwise(pointer)), ">").alias("segments"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 50) || '–' || (event_id % 50 + 9) || CASE WHEN event_id % 3 = 0 THEN ' mg/dL' ELSE '' END WHEN event_id % 4 = 1 THEN 'negative' END AS span,
 (event_id % 101) || '%' AS pct, CASE WHEN event_id >= 86400 THEN (event_id // 86400) || 'd' WHEN event_id >= 3600 THEN (event_id // 3600) || 'h' WHEN event_id >= 60 THEN (event_id // 60) || 'm' ELSE event_id || 's' END AS age, event_id % 4 IN (2, 3) AS same FROM events""")
def formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    low, high = F.when(k % 4 == 0, k % 50), F.when(k % 4 == 0, k % 50 + 9)
    text = F.when(k % 4 == 1, "negative").when(k % 4 == 2, "")
    return _t(spark, sf_dir, "events").select("event_id", T.format_range(low, high, F.when(k % 3 == 0, "mg/dL").otherwise(""), text).alias("span"), T.format_percent((k % 101) / 100).alias("pct"), T.age_bucket(k).alias("age"), T.equal_values(F.when(k % 4 != 3, F.when(k % 4 == 2, "").otherwise("x")), F.lit(None).cast("string")).alias("same"))


# The correction log -----------------------------------------------------------------------------------------------

_FIELDS = ["vendor.name", "/patient/first_name", "test_name", "result_value", "units", "flag", "unknown_field", "vendor_name", " header_label", "patient.last_name"]
_LOG = """lg AS (SELECT user_id AS doc_id, event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'unset' WHEN event_type = 'purchase' THEN 'set' END AS op,
  ['vendor.name', '/patient/first_name', 'test_name', 'result_value', 'units', 'flag', 'unknown_field', 'vendor_name', ' header_label', 'patient.last_name'][event_id % 10 + 1] AS field,
  event_id % 4 AS line, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'v' || (event_id % 100) END AS value FROM events),
nm AS (SELECT doc_id, seq, ts, coalesce(op, 'replace') AS op, line, value, CASE trim(field) WHEN 'vendor.name' THEN 'vendor_name' WHEN '/patient/first_name' THEN 'patient_first_name' WHEN 'unknown_field' THEN NULL WHEN 'patient.last_name' THEN 'patient_last_name' ELSE trim(field) END AS field FROM lg),
nn AS (SELECT * FROM nm WHERE field IS NOT NULL AND NOT (field = 'vendor_name' AND coalesce(value, '') = '' AND op <> 'unset')),
tp AS (SELECT *, CASE WHEN line > 0 THEN 'test_rows.line_' || line || '.' || field ELSE 'document_info.' || field END AS path FROM nn),
lw AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, path) AS n_items, row_number() OVER (PARTITION BY doc_id, path ORDER BY ts DESC, seq DESC) AS k FROM tp) WHERE k = 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "error", "unset").when(F.col("event_type") == "purchase", "set")
    field = F.element_at(F.array(*map(F.lit, _FIELDS)), (e % 10 + 1).cast("int"))
    value = F.when(e % 13 == 0, "").otherwise(F.concat(F.lit("v"), (e % 100).cast("string")))
    raw = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), e.alias("seq"), "ts", op.alias("op"), F.lit(None).cast("string").alias("path"), field.alias("field"), (e % 4).alias("line"), F.lit("old").alias("value"), value.alias("new_value"))
    out = corrections.normalised(raw)
    return out.withColumn("path", corrections.target_path(F.col("field"), F.col("line"), F.col("path")))


@query(f"WITH {_LOG} SELECT doc_id, seq, op, field, path, value FROM tp")
def corrections_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("doc_id", "seq", "op", "field", "path", "value")


@query("""WITH e AS (SELECT event_id, ['vendor.name', '/patient/first_name', 'test_name', 'nothing'][event_id % 4 + 1] AS f FROM events) SELECT event_id, CASE f WHEN 'vendor.name' THEN 'vendor_name' WHEN '/patient/first_name' THEN 'patient_first_name' WHEN 'test_name' THEN f END AS field FROM e""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.element_at(F.array(*map(F.lit, ["vendor.name", "/patient/first_name", "test_name", "nothing"])), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", corrections.canonical_field(f).alias("field"))


@query(f"WITH {_LOG} SELECT doc_id, path, op, value, n_items FROM lw")
def corrections_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.last_writes(_log(spark, sf_dir)).drop("ts")


_BASE = "bs AS (SELECT DISTINCT user_id AS doc_id, 'document_info.vendor_name' AS path, 'base' AS value FROM events UNION ALL SELECT DISTINCT user_id, 'test_rows.line_1.units', 'mg/dL' FROM events)"


@query(f"""WITH {_LOG}, {_BASE} SELECT doc_id, path, CASE WHEN l.op IS NULL THEN b.value ELSE l.value END AS value FROM bs b FULL JOIN lw l USING (doc_id, path) WHERE l.op IS NULL OR l.op <> 'unset'""")
def corrections_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    base = users.select("doc_id", F.explode(F.array(F.struct(F.lit("document_info.vendor_name").alias("path"), F.lit("base").alias("value")), F.struct(F.lit("test_rows.line_1.units").alias("path"), F.lit("mg/dL").alias("value")))).alias("x")).select("doc_id", "x.*")
    return corrections.replay(base, _log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT split_part(path, '.', 1) AS section, op, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tp GROUP BY ALL")
def corrections_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.substring_index("path", ".", 1).alias("section"), "op").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {_LOG} SELECT doc_id, seq, lag(value) OVER w AS before, row_number() OVER w AS nth FROM tp WINDOW w AS (PARTITION BY doc_id, path ORDER BY ts, seq)")
def corrections_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.running_state(_log(spark, sf_dir)).select("doc_id", "seq", "before", "nth")


@query("""WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '"text"' WHEN 3 THEN '{broken' ELSE '7' END AS j FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'invalid' ELSE 'number' END AS shape, CASE WHEN event_id % 5 = 0 THEN '[' || j || ']' ELSE j END AS migrated FROM p""")
def shape_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    j = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, '"text"').when(k == 3, "{broken").otherwise("7")
    return _t(spark, sf_dir, "events").select("event_id", corrections.shape_of(j).alias("shape"), corrections.migrated(j).alias("migrated"))


@query("""WITH a AS (UNPIVOT (SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 7 <> 0) ON name, segment, nation INTO NAME path VALUE value),
b AS (UNPIVOT (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 11 <> 0) ON name, segment, nation INTO NAME path VALUE value)
SELECT c_custkey, path, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value = b.value THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b USING (c_custkey, path)""")
def doc_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    long = lambda df: df.unpivot("c_custkey", ["name", "segment", "nation"], "path", "value")
    new = c.withColumn("segment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("segment")))
    return corrections.diff(long(c.where("c_custkey % 7 <> 0")), long(new.where("c_custkey % 11 <> 0")), "c_custkey").select("c_custkey", "path", "change")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'unset' ELSE 'set' END AS op FROM events""")
def change_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    return _t(spark, sf_dir, "events").select("event_id", corrections.change_op(F.when(k == 0, F.lit(None).cast("string")).otherwise("a"), F.when(k == 2, "b").otherwise("")).alias("op"))


@query()
def json_set_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("doc_id", "ts", "seq", "op", "path", F.to_json(F.struct("value")).alias("value"))
    docs = log.select("doc_id").distinct().withColumn("json", F.lit('{"document_info": {"vendor_name": "base"}}'))
    return corrections.patched(docs, log)


# Registry ---------------------------------------------------------------------------------------------------------

_JOBS = "jb AS (SELECT user_id AS id, max_by(CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'odd' END, ts) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t == "view", "processing").when(t == "purchase", "completed").when(t == "error", "failed").otherwise("odd")
    return registry.latest_status(_t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), status.alias("status"), "ts"))


@query(f"WITH {_JOBS}, d AS (SELECT unnest(['queued','processing','completed','failed','cancelled']) AS status) SELECT d.status, count(jb.id) AS n FROM d LEFT JOIN jb ON jb.status = d.status GROUP BY d.status")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.status_counts(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT id, status, (SELECT count(*) FROM jb) AS total, (SELECT count(*) FROM jb) > 40 AS has_next FROM jb ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.page(_jobs(spark, sf_dir), [F.desc("updated_at"), F.col("id")], 2, 20).select("id", "status", "total", "has_next")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') ORDER BY p_partkey LIMIT 50")
def results_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.matching(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "AN", "p_name", "p_brand")
    return registry.page(found, [F.col("p_partkey")], 1, 50).select("p_partkey", "p_name")


_FILES = "fl AS (SELECT o_custkey AS rid, 'f' || o_orderkey AS file_name, ['canonical','01_lines','02_roles','03_compose'][o_orderkey % 4 + 1] AS stage, o_orderdate AS modified, o_orderkey % 9 = 0 AS needs_review FROM orders)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*map(F.lit, ["canonical", "01_lines", "02_roles", "03_compose"])), (k % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rid"), F.concat(F.lit("f"), k.cast("string")).alias("file_name"), stage.alias("stage"), F.col("o_orderdate").alias("modified"), (k % 9 == 0).alias("needs_review"))


@query(f"WITH {_FILES} SELECT rid, arg_max(file_name, (modified, file_name)) AS newest, bool_or(stage = 'canonical') AS has_canonical, array_to_string(list_sort(list_distinct(list(stage))), ',') AS stages, bool_or(needs_review) AS needs_review, count(*) AS n_files FROM fl GROUP BY rid")
def artifact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.artifact_groups(_files(spark, sf_dir)).drop("modified")


@query(f"WITH {_FILES}, g AS (SELECT rid, bool_or(needs_review) AS r, max(modified) AS m FROM fl GROUP BY rid) SELECT rid FROM g ORDER BY r DESC, m DESC, rid LIMIT 30")
def review_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = registry.artifact_groups(_files(spark, sf_dir))
    return g.orderBy(F.desc("needs_review"), F.desc("modified"), "rid").limit(30).select("rid")


@query(f"WITH {_FILES} SELECT rid, file_name FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE stage WHEN 'canonical' THEN 0 WHEN '03_compose' THEN 1 ELSE 2 END, file_name) AS k FROM (SELECT rid, stage, min(file_name) AS file_name FROM fl WHERE stage IN ('canonical','03_compose') GROUP BY ALL)) WHERE k = 1")
def canonical_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    of = lambda stage: f.where(F.col("stage") == stage).groupBy("rid").agg(F.min("file_name").alias("file_name"))
    return registry.first_source(of("canonical"), of("03_compose"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).head()[0]
    return registry.retained(e, F.lit(last)).select("event_id")


@query("SELECT event_type, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS fresh FROM events GROUP BY event_type")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).head()[0]
    return e.groupBy("event_type").agg(F.bool_or(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 7 DAYS")).alias("fresh"))


# Facts of documents -----------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES} SELECT doc_id, first(regexp_extract(text, '[0-9]{{3}}-[0-9]{{4}}') ORDER BY line_no) FILTER (regexp_extract(text, '[0-9]{{3}}-[0-9]{{4}}') <> '') AS number, first(regexp_extract(text, '[A-Z][a-z]+') ORDER BY line_no) FILTER (regexp_extract(text, '[A-Z][a-z]+') <> '') AS word FROM ln GROUP BY doc_id""")
def first_match_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda p: F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
    return meta.first_values(_lines(spark, sf_dir), {"number": m("[0-9]{3}-[0-9]{4}"), "word": m("[A-Z][a-z]+")})


@query(f"""WITH {_LINES}, s AS (SELECT *, bool_or(contains(text, 'th')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS i FROM ln) SELECT doc_id, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line_no) AS text FROM s WHERE i GROUP BY doc_id""")
def section_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.continued_section(_lines(spark, sf_dir), F.col("text").contains("th"))


_FACTS = "fc AS (SELECT o_custkey AS doc_id, o_orderpriority AS field, o_orderstatus || (o_orderkey % 5) AS value, (o_orderkey % 11) / 10.0::DOUBLE AS confidence, o_orderkey AS line_no FROM orders)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("field"), F.concat("o_orderstatus", (k % 5).cast("string")).alias("value"), ((k % 11) / 10.0).cast("double").alias("confidence"), k.alias("line_no"))


@query(f"WITH {_FACTS} SELECT doc_id, field, first(value ORDER BY confidence DESC, line_no) AS value, string_agg(value, '; ' ORDER BY line_no) AS texts, round(avg(confidence) + 1e-9, 6) AS confidence FROM fc GROUP BY ALL")
def consolidate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.best_by_confidence(_facts(spark, sf_dir)).withColumn("confidence", _round(F.col("confidence")))


@query(f"""WITH {_FACTS}, q AS (SELECT doc_id, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low FROM fc GROUP BY doc_id),
r AS (SELECT *, (high + medium * 0.6::DOUBLE + low * 0.2::DOUBLE) / (high + medium + low) AS ratio FROM q) SELECT doc_id, high, medium, low, round(ratio + 1e-9, 6) AS ratio, CASE WHEN ratio + 1e-9 >= 0.8 THEN 'high' WHEN ratio + 1e-9 >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM r""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = meta.extraction_quality(_facts(spark, sf_dir))
    r = F.col("ratio") + 1e-9
    return out.withColumn("label", F.when(r >= 0.8, "high").when(r >= 0.5, "medium").otherwise("low")).withColumn("ratio", _round(F.col("ratio")))


# Training sets ----------------------------------------------------------------------------------------------------

_PRED = "pr AS (SELECT d.doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN toxic = 1 OR n_chars < 800 THEN 'bad' ELSE 'good' END AS pred FROM labels JOIN documents d USING (doc_id))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    truth, pred = F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when((F.col("toxic") == 1) | (F.col("n_chars") < 800), "bad").otherwise("good")
    return _t(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), truth.alias("truth"), pred.alias("pred"))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE + 1e-9, 6) AS share FROM documents GROUP BY lang")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.label_stats(_t(spark, sf_dir, "documents"), "lang").withColumn("share", _round(F.col("share")))


@query("SELECT CAST(n_chars // 500 * 500 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.length_bins(_t(spark, sf_dir, "documents"), F.col("n_chars"), 500)


@query("SELECT max(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.keep_last(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query(f"WITH {_PRED} SELECT truth, pred, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.confusion(_predicted(spark, sf_dir))


@query(f"""WITH {_PRED}, l AS (SELECT unnest(['good','bad']) AS label), c AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS predicted, count(*) FILTER (truth = label AND pred = label) AS hit FROM l, pr GROUP BY label),
s AS (SELECT *, hit / predicted::DOUBLE AS p, hit / support::DOUBLE AS r FROM c) SELECT label, support, round(p + 1e-9, 6) AS precision, round(r + 1e-9, 6) AS recall, round(2 * p * r / (p + r) + 1e-9, 6) AS f1 FROM s""")
def prf_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.scores_by_class(_predicted(spark, sf_dir))
    return out.select("label", "support", *[_round(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PRED}, w AS (SELECT *, row_number() OVER (PARTITION BY truth, pred ORDER BY id) AS k FROM pr WHERE truth <> pred) SELECT truth, pred, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 5) AS examples FROM w GROUP BY ALL""")
def misclass_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.worst_confusions(_predicted(spark, sf_dir))


@query("""WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM r GROUP BY ALL""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.split(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang", "part").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey AS id, l_returnflag AS label, l_linenumber AS s FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS id, l_linestatus || '' AS ls, CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS label, l_linenumber AS s FROM lineitem), q AS (SELECT DISTINCT id, label, s FROM p),
j AS (SELECT label, t.id AS t, q.id AS q FROM t FULL JOIN q USING (id, label, s)), c AS (SELECT label, count(*) FILTER (t IS NOT NULL AND q IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (q IS NULL) AS fn FROM j GROUP BY label)
SELECT label, tp, fp, fn, round(tp / (tp + fp)::DOUBLE + 1e-9, 6) AS precision, round(tp / (tp + fn)::DOUBLE + 1e-9, 6) AS recall FROM c""")
def entity_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("s"), "l_partkey")
    pred = li.withColumn("label", F.when(F.col("l_partkey") % 4 == 0, "N").otherwise(F.col("label"))).drop("l_partkey").distinct()
    out = training.entity_scores(li.drop("l_partkey").distinct(), pred, ["id", "label", "s"])
    return out.select("label", "tp", "fp", "fn", _round(F.col("precision")).alias("precision"), _round(F.col("recall")).alias("recall"))


@query("SELECT label FROM (SELECT unnest(['en','fr','de','es','it','pt']) AS label) WHERE label NOT IN (SELECT lang FROM documents)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it", "pt")], "label string")
    return expected.join(_t(spark, sf_dir, "documents").select(F.col("lang").alias("label")).distinct(), "label", "left_anti")


@query(f"WITH {ROLES} SELECT doc_id, row_no, role, coalesce(p, 0.5::DOUBLE) AS p FROM roles LEFT JOIN (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_no, max(l_discount) AS p FROM lineitem GROUP BY ALL) USING (doc_id, row_no)")
def prob_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier probabilities by line; 0.5 where there is none."""
    probs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("row_no")).agg(F.max("l_discount").alias("p"))
    return _roles(spark, sf_dir).select("doc_id", "row_no", "role").join(probs, ["doc_id", "row_no"], "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


@query()
def role_classifier_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits the role classifier on all rows of four fifths of the documents and counts right and wrong on the rest."""
    path = scratch(spark, "roles")  # a fit reads its rows many times
    training.role_features(_roles(spark, sf_dir).select("doc_id", "text", "y", "is_bold", F.col("role").alias("label"))).write.parquet(path)
    rows = spark.read.parquet(path)
    model = training.fit_role_classifier(rows.where("doc_id % 5 <> 0"))
    out = model.transform(roles.alike(rows.where("doc_id % 5 = 0").withColumn("weight", F.lit(1.0))))
    return out.groupBy("label", (F.col("index") == F.col("prediction")).alias("right")).agg(F.sum("n").alias("n"))


# Streams (beyond the batch surface) -------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.drained(spark, ingest.tumbling(ingest.event_stream(spark, sf_dir)), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(_t(spark, sf_dir, "events"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'")
def stream_ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.drained(spark, ingest.event_stream(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", "event_type"))


_STATUS = ["queued", "processing", "completed", "failed", "cancelled"]
_MOVES = [(before, after) for before, some in jobs.MOVES.items() for after in sorted(some)]
_LEGAL = " OR ".join(f"(status = '{after}' AND before {f'= {chr(39)}{before}{chr(39)}' if before else 'IS NULL'})" for before, after in _MOVES)


def _job_events(events: DataFrame) -> DataFrame:
    """Four events on end as those of a job, whose statuses mostly follow each other."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), ((k % 4 + F.floor(k / 4)) % 5 + 1).cast("int"))
    return events.select((k - k % 4).cast("long").alias("id"), k.cast("long").alias("seq"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id - event_id % 4 AS id, event_id AS seq, ['queued', 'processing', 'completed', 'failed', 'cancelled'][(event_id % 4 + event_id // 4) % 5 + 1] AS status, ts AS at_, row_number() OVER (PARTITION BY event_id - event_id % 4 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT id, n, CAST(NULL AS VARCHAR) AS before, status, at_, status = 'queued' AS legal FROM e WHERE n = 1
  UNION ALL SELECT id, n, before, status, at_, coalesce(({_LEGAL}), false) FROM (SELECT e.id, e.n, CASE WHEN w.legal THEN w.status ELSE w.before END AS before, e.status, e.at_ FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1)),
mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS at_ FROM events),
fin AS (SELECT id, arg_max(CASE WHEN legal THEN status ELSE before END, n) AS status, max(at_) FILTER (legal) AS since FROM w GROUP BY id)
SELECT id, before, status, at_ AS at, legal, 'event' AS cause FROM w UNION ALL SELECT id, 'processing', 'failed', date_trunc('milliseconds', since) + INTERVAL 2 HOUR, true, 'stale' FROM fin, mark WHERE status = 'processing' AND date_trunc('milliseconds', since) + INTERVAL 2 HOUR <= date_trunc('milliseconds', mark.at_)""")
def stream_job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event does to its job, and jobs that went stale."""
    moved = jobs.drained_with_state(spark, lambda: jobs.job_moves(_job_events(ingest.event_stream(spark, sf_dir, 1_000_000)), stale="2 hours"))
    return moved.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT ts, event_id % 4 <> 0 AS broken FROM events), s AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i AS start, broken FROM e, unnest([0, 1, 2]) AS r(i))
SELECT start, count(*) FILTER (broken) AS broken, count(*) AS entries FROM s GROUP BY start""")
def stream_broken_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the log that aren't lists, in half hours that begin every ten minutes."""
    k = F.col("event_id").cast("string")
    payload = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), k, F.lit("]"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": '), k, F.lit("}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{"), k)).otherwise(k)
    log = ingest.event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return ingest.drained(spark, jobs.broken_entries(log, payload), "complete")
