"""Queries over result documents, their heads, labels and listings, on data made from the supplied tables by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L
from panelspark.functions import predicates as P
from panelspark.functions import tokens
from panelspark.operators import headers, labels, layout, panels, registry, results, rows, stages, training
from panelspark.plans import report
from panelspark.plans.sql import CELLS
from panelspark.sources.lines import synthetic_cells

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


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else _s(p) for p in parts))


def _case(key: Column, values: list) -> Column:
    """The value of the key's number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v) if isinstance(v, str) or v is None else v).otherwise(out)
    return out


# Layout ---------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem), m AS (SELECT doc_id, unnest(generate_series(1, max(page))) AS page FROM p GROUP BY doc_id)
SELECT doc_id, CAST(page AS INT) AS page FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.page = m.page)""")
def missing_pages_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.missing_pages(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")))


_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


@query(f"""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block, 0 AS par, l_linenumber // 2 AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ITEM_ORDER)}) AS seq,
  CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'w' || (l_partkey % 50) || ' ' END AS text, l_partkey * 7 % 100 AS conf, l_partkey % 800 AS l, l_suppkey % 1000 AS top, l_partkey % 60 AS width, 10 + l_suppkey % 5 AS height FROM lineitem)
SELECT doc_id, block, par, line, string_agg(trim(text), ' ' ORDER BY seq) AS text, min(l) AS x_left, max(l + width) AS x_right, min(top) AS top, round(avg(height) * 0.75, 6) AS font FROM w WHERE conf >= 30 AND trim(text) <> '' GROUP BY ALL""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER))
    text = F.when(p % 11 == 0, " ").otherwise(_cat("w", p % 50, " "))
    words = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n % 2).alias("block"), F.lit(0).alias("par"), F.expr("l_linenumber div 2").alias("line"), seq.alias("seq"), text.alias("text"), (p * 7 % 100).alias("conf"), (p % 800).alias("left"), (s % 1000).alias("top"), (p % 60).alias("width"), (10 + s % 5).alias("height"))
    return layout.ocr_lines(words)


@query(f"""WITH {CELLS}, c AS (SELECT *, x + 6 * length(text) AS x_right, lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS py FROM cells),
r AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y - py) > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS run FROM c),
g AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page, run ORDER BY x, line_no) - x_right AS gap FROM r)
SELECT doc_id, page, CAST(run AS BIGINT) AS run, count(*) AS n, string_agg(text, ' ' ORDER BY x, line_no) AS text FROM g GROUP BY doc_id, page, run HAVING count(*) >= 2 AND max(gap) <= 130""")
def stitch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stitch_groups(synthetic_cells(spark, sf_dir).withColumn("x_right", F.col("x") + 6 * F.length("text")), gap=130)


@query(f"""WITH {report.ROLES}, p AS (SELECT a.doc_id, a.row_no, string_agg(CAST(b.row_no AS VARCHAR), ',' ORDER BY b.row_no) AS candidates FROM roles a JOIN roles b ON a.doc_id = b.doc_id AND a.page = b.page AND a.row_no <> b.row_no AND abs(a.row_no - b.row_no) <= 5 AND (abs(a.y - b.y) <= 6 OR b.role = 'TEST_ROW') GROUP BY ALL)
SELECT r.doc_id, r.row_no, coalesce(p.candidates, '') AS candidates FROM roles r LEFT JOIN p ON r.doc_id = p.doc_id AND r.row_no = p.row_no""")
def stitch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stitch_candidates(report._roles(spark, sf_dir))


@query(f"""WITH {CELLS}, t AS (SELECT *, CASE WHEN page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS turn FROM cells), r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM t)
SELECT doc_id, CAST(run AS BIGINT) AS run, min(page) AS page, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS text FROM r GROUP BY doc_id, run""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(synthetic_cells(spark, sf_dir))


@query(f"""WITH {report.ROLES} SELECT b.doc_id, b.line_no, coalesce(r.role, 'JUNK') AS role, CASE coalesce(r.role, 'NONE') WHEN 'NONE' THEN 0.1 WHEN 'SECTION_PANEL' THEN 0.9 WHEN 'TEST_ROW' THEN 0.8 WHEN 'PAGE_HEADER' THEN 0.8 WHEN 'PAGE_FOOTER' THEN 0.8 WHEN 'COMMENT' THEN 0.5 WHEN 'SECTION_MISC' THEN 0.6 WHEN 'JUNK' THEN 0.1 ELSE 0.7 END::DOUBLE AS role_confidence
FROM bins b LEFT JOIN roles r ON b.doc_id = r.doc_id AND b.page = r.page AND b.bin = r.bin""")
def roles_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.roles_of_cells(synthetic_cells(spark, sf_dir), report._roles(spark, sf_dir))


# Panels ---------------------------------------------------------------------------------------------------------

_CODED = "ln AS (SELECT p_partkey % 9 AS doc_id, p_partkey % 2 + 1 AS page, p_partkey AS line_no, p_partkey % 490 AS x, p_size AS y, CASE p_partkey % 4 WHEN 0 THEN 'LOINC: ' || (p_partkey % 900) || '-5 CPT #80' || (p_partkey % 7) WHEN 1 THEN 'cpt 8' || (p_partkey % 50) WHEN 3 THEN 'xLOINC 5, CPTS' ELSE p_name END AS text FROM part)"


@query(f"""WITH {_CODED}, c AS (SELECT *, CASE WHEN line_no % 4 = 0 THEN (line_no % 900) || '-5' END AS loinc, CASE line_no % 4 WHEN 0 THEN '80' || (line_no % 7) WHEN 1 THEN '8' || (line_no % 50) END AS cpt FROM ln),
t AS (SELECT * FROM ln WHERE line_no % 4 = 2)
SELECT t.doc_id, t.line_no, arg_min(c.loinc, {{'d': abs(c.x - t.x), 'n': c.line_no}}) FILTER (c.loinc IS NOT NULL) AS loinc, arg_min(c.cpt, {{'d': abs(c.x - t.x), 'n': c.line_no}}) FILTER (c.cpt IS NOT NULL) AS cpt
FROM t JOIN c ON t.doc_id = c.doc_id AND t.page = c.page AND abs(t.y - c.y) <= 3 WHERE c.loinc IS NOT NULL OR c.cpt IS NOT NULL GROUP BY t.doc_id, t.line_no""")
def codes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = _case(k % 4, [_cat("LOINC: ", k % 900, "-5 CPT #80", k % 7), _cat("cpt 8", k % 50), F.col("p_name"), "xLOINC 5, CPTS"])
    lines = _t(spark, sf_dir, "part").select((k % 9).alias("doc_id"), (k % 2 + 1).alias("page"), k.alias("line_no"), (k % 490).alias("x"), F.col("p_size").alias("y"), text.alias("text"))
    return panels.codes_near(lines.where("line_no % 4 = 2"), lines, 3)


_LINES = "ln AS (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("n", "line")).select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


_W = "string_split(line, ' ')"


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, {_W}[1] AS name, {_W}[2] AS value, {_W}[3] AS units FROM ln)
SELECT doc_id, line_no, (coalesce(name, '') LIKE '%:' AND ({" OR ".join(f"contains(coalesce(name, ''), '{t}')" for t in L.HEADER_TERMS)})) OR (NOT regexp_matches(coalesce(value, ''), '[0-9]') AND NOT coalesce(units IN ({", ".join(f"'{u}'" for u in L.GUARD_UNITS)}), false)) AS is_comment FROM w""")
def demoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard on documents' lines, read as name, value and unit by their first words."""
    word = lambda i: F.get(F.split("line", " "), i)
    return _lines(spark, sf_dir).select("doc_id", "line_no", panels.is_comment(word(0), word(1), word(2)).alias("is_comment"))


@query(f"""WITH {_LINES}, w AS (SELECT *, list_filter(regexp_split_to_array(line, '[ 	]+'), lambda w: w <> '') AS ws FROM ln)
SELECT doc_id, line_no, (line_no % 3 = 0 AND len(ws) >= 2) OR len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w) AND length(w) >= 2)) >= 2 OR len(list_filter(ws, lambda w: regexp_matches(w, '[a-zA-Z]{{2,}}'))) >= 2 AS likely,
 {" OR ".join(f"contains(lower(line), '{t}')" for t in L.PANEL_INDICATORS)} AS names_panel FROM w""")
def likely_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines, every third in bold."""
    found = _lines(spark, sf_dir)
    return found.select("doc_id", "line_no", panels.likely_header(F.col("line"), F.col("line_no") % 3 == 0).alias("likely"), panels.names_panel(F.col("line")).alias("names_panel"))


@query("""SELECT l_orderkey AS doc_id, l_partkey % 3 AS panel_no, CASE WHEN (l_orderkey * 7 % 100) / 100 < 0.5 THEN 'given,continuity' ELSE 'given' END AS reasons, true AS needs_review FROM lineitem WHERE (l_orderkey * 7 % 100) / 100 >= 0.25 GROUP BY l_orderkey, l_partkey % 3""")
def panel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("panel_no")).agg(F.count("*").alias("n_tests"))
    made = made.withColumns({"continuity": (F.col("doc_id") * 7 % 100) / 100, "reasons": F.array(F.lit("given"))})
    return panels.kept_panels(made).select("doc_id", "panel_no", F.array_join("reasons", ",").alias("reasons"), "needs_review")


@query(f"""WITH {report.PANELS} SELECT reason, count(*) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (SELECT doc_id, unnest(string_split(reasons, ',')) AS reason FROM panels2 WHERE reasons <> '') GROUP BY reason""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.operators import scoring

    found = scoring.panel_scores(report._tests(spark, sf_dir)).where("reasons <> ''")
    return found.select("doc_id", F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') || '-' || (p_size % 4) || '-' || (p_partkey % 3) || CASE WHEN p_partkey % 5 = 0 THEN '-fallback' ELSE '' END AS panel_id FROM part")
def panel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", panels.panel_id(F.col("p_name"), F.col("p_size") % 4, k % 3, F.when(k % 5 == 0, "fallback")).alias("panel_id"))


# Tokens ---------------------------------------------------------------------------------------------------------

_BARE = "regexp_replace(regexp_replace(lower(token), ':+$', ''), ',+$', '')"
_EDGES = "[ \\t.,;:()\\[\\]{}<>+-]+"


def _words_in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(coalesce(text, ''), '[ 	
]+', ' ', 'g'), ' ')) AS token FROM documents UNION SELECT strftime(ts, '%m/%d/%Y') FROM events UNION SELECT strftime(ts, '%H:%M:%S') FROM events UNION SELECT lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 997 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') FROM customer UNION SELECT 'A' || (1000000 + c_custkey) FROM customer)
SELECT token, regexp_matches(token, '{tokens.DATE_FORMS.replace("(?i)", "")}') OR regexp_matches(lower(token), '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') AS is_date, regexp_matches(token, '{tokens.TIME_FORM}') AS is_time, regexp_matches(token, '{tokens.ID_FORMS}') AS is_id, regexp_matches(token, '{tokens.PHONE_FORMS}') AS is_phone,
 lower(token) IN ({_words_in(L.MEDICAL_WORDS)}) AS is_medical, {_BARE} IN ({_words_in(L.LABEL_WORDS)}) AS is_label, regexp_replace(regexp_replace(lower(token), '^{_EDGES}', ''), '{_EDGES}$', '') IN ({_words_in(L.KNOWN_UNITS)}) AS is_unit FROM w""")
def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, and dates, times, phones and numbers of other tables."""
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n]+", " "), " ")).alias("token"))
    events, customers, k = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer"), F.col("c_custkey")
    phone = F.concat_ws("-", F.lpad(_s(k % 1000), 3, "0"), F.lpad(_s(k % 997), 3, "0"), F.lpad(_s(k % 10000), 4, "0"))
    for more in (events.select(F.date_format("ts", "MM/dd/yyyy")), events.select(F.date_format("ts", "HH:mm:ss")), customers.select(phone), customers.select(_cat("A", F.lit(1000000) + F.col("c_custkey")))):
        words = words.union(more)
    return words.distinct().select("token", tokens.token_kinds(F.col("token")).alias("k"), tokens.is_unit_like(F.col("token")).alias("is_unit")).select("token", "k.*", "is_unit")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([,:;(){}])', ' \1 ', 'g'), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS d, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '') AS r FROM documents)
SELECT doc_id, CAST(len(d) AS BIGINT) AS n_tokens, sha256(array_to_string(d, '|')) AS tokens_sha256, CAST(len(r) AS BIGINT) AS n_row_tokens, sha256(array_to_string(r, '|')) AS row_tokens_sha256 FROM t""")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.array_join(c, "|").cast("binary"), 256)
    cut = _t(spark, sf_dir, "documents").select("doc_id", tokens.document_tokens(F.col("text")).alias("d"), tokens.row_tokens(F.col("text")).alias("r"))
    return cut.select("doc_id", F.size("d").cast("long").alias("n_tokens"), sha("d").alias("tokens_sha256"), F.size("r").cast("long").alias("n_row_tokens"), sha("r").alias("row_tokens_sha256"))


# Results --------------------------------------------------------------------------------------------------------


@query("""SELECT event_id AS line_number, 't' || event_id AS text, CASE event_id % 4 WHEN 0 THEN 'HI ' WHEN 1 THEN 'panic' WHEN 2 THEN NULL ELSE 'extraordinarily' END AS flag, CASE event_id % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'CRIT' WHEN 3 THEN 'EXTRAORDIN' END AS flag_norm,
CASE event_id % 3 WHEN 0 THEN '1-' || user_id WHEN 1 THEN 'to ' || user_id END AS reference_range, CASE event_id % 3 WHEN 0 THEN '1-' || user_id WHEN 1 THEN 'to ' || user_id END AS reference_range_text, CASE event_id % 3 WHEN 1 THEN 0.5 END::DOUBLE AS reference_range_low, CASE event_id % 3 WHEN 1 THEN user_id END::DOUBLE AS reference_range_high FROM events""")
def served_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = _case(k % 3, [_cat("1-", F.col("user_id")), _cat('{"text": "to ', F.col("user_id"), '", "low": 0.5, "high": ', F.col("user_id"), "}"), None])
    rows = _t(spark, sf_dir, "events").select(k.alias("line_number"), _cat("t", k).alias("text"), _case(k % 4, ["HI ", "panic", None, "extraordinarily"]).alias("flag"), raw.alias("reference_range"))
    return results.served_rows(rows)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' || user_id || ' – 9.5' WHEN 1 THEN 'r' || user_id WHEN 2 THEN NULL WHEN 3 THEN 'none' END AS text, CASE event_id % 5 WHEN 0 THEN -user_id WHEN 1 THEN user_id WHEN 2 THEN 1.5 END::DOUBLE AS low, CASE event_id % 5 WHEN 0 THEN 9.5 WHEN 1 THEN 7 WHEN 2 THEN user_id END::DOUBLE AS high,
CASE event_id % 5 WHEN 0 THEN '-' || user_id || ' – 9.5' WHEN 3 THEN 'none' END AS street, CASE event_id % 5 WHEN 1 THEN 'Here' END AS city FROM events""")
def coerced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    raw = _case(F.col("event_id") % 5, [_cat("-", u, " – 9.5"), _cat('{"raw": "r', u, '", "min": ', u, ', "high": 7, "city": "Here"}'), _cat('{"low": "1.5", "max": ', u, "}"), "none", None])
    r, a = results.coerced_range(raw), results.served_address(raw)
    return _t(spark, sf_dir, "events").select("event_id", r["text"].alias("text"), r["low"].alias("low"), r["high"].alias("high"), a["street"].alias("street"), a["city"].alias("city"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document a customer, with a field here in one place and there in another."""
    k = F.col("c_custkey")
    name = lambda place: _cat('"', place, "-", k, '"')
    info = F.when(k % 2 == 0, _cat('"patient_first_name": ', name("info"), ', "vendor_name": "", "performing_lab_name": ', name("lab"), ",")).otherwise("")
    top = F.when(k % 3 == 0, _cat('"patient": {"first_name": ', name("top"), ', "last_name": null}, "report": {"ordered_items": " a, b ,c"},')).otherwise("")
    payload = F.when(k % 5 != 0, _cat('"patient": {"first_name": ', name("pay"), ', "last_name": ', name("pay"), '}, "vendor": {"name": ', name("pay"), '}, "report": {"ordered_items": ["x", "y"]}')).otherwise("")
    return _t(spark, sf_dir, "customer").select(k.alias("doc_id"), _cat("{", '"document_info": {', info, '"n": 1}, ', top, ' "ehr_payload": {', payload, "}}").alias("data"))


_MERGED = """m AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'top-' || c_custkey WHEN c_custkey % 2 = 0 THEN 'info-' || c_custkey WHEN c_custkey % 5 <> 0 THEN 'pay-' || c_custkey END AS first_name, CASE WHEN c_custkey % 5 <> 0 THEN 'pay-' || c_custkey END AS last_name,
CASE WHEN c_custkey % 5 <> 0 THEN 'pay-' || c_custkey END AS vendor, CASE WHEN c_custkey % 2 = 0 THEN 'lab-' || c_custkey END AS lab, CASE WHEN c_custkey % 3 = 0 THEN 'a;b;c' WHEN c_custkey % 5 <> 0 THEN 'x;y' END AS ordered FROM customer)"""


@query(f"WITH {_MERGED} SELECT *, first_name IS NULL AND last_name IS NULL AS no_patient, true AS no_specimen FROM m")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = results.merged_documents(_documents(spark, sf_dir))
    return m.select("doc_id", F.col("patient.first_name").alias("first_name"), F.col("patient.last_name").alias("last_name"), F.col("vendor.name").alias("vendor"), F.col("performing_lab.name").alias("lab"), F.array_join("report.ordered_items", ";").alias("ordered"), F.col("patient").isNull().alias("no_patient"), F.col("specimen").isNull().alias("no_specimen"))


@query(f"WITH {_MERGED} SELECT 'patient' AS section, count(first_name) + count(last_name) AS filled FROM m UNION ALL SELECT 'vendor', count(vendor) FROM m UNION ALL SELECT 'performing_lab', count(lab) FROM m UNION ALL SELECT 'report', count(ordered) FROM m UNION ALL SELECT 'ordering', 0 UNION ALL SELECT 'specimen', 0")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.filled_fields(results.merged_documents(_documents(spark, sf_dir)))


@query(f"""WITH {_MERGED}, p AS (SELECT o_custkey AS doc_id, string_agg('{{"panel_no":' || n || ',"panel_name":"P' || n || '","n_tests":' || c || '}}', ',' ORDER BY n) AS panels FROM (SELECT o_custkey, o_orderkey % 3 AS n, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey),
s AS (SELECT doc_id, concat_ws(',', '"vendor":{{"name":"' || vendor || '"}}', '"performing_lab":{{"name":"' || lab || '"}}', CASE WHEN first_name IS NOT NULL THEN '"patient":{{' || concat_ws(',', '"last_name":"' || last_name || '"', '"first_name":"' || first_name || '"') || '}}' END, '"report":{{"ordered_items":["' || replace(ordered, ';', '","') || '"]}}') AS info FROM m)
SELECT s.doc_id, '{{"document_info":{{' || info || '}},"lab_panels":[' || coalesce(panels, '') || ']}}' AS report FROM s LEFT JOIN p ON s.doc_id = p.doc_id""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    made = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), n.alias("panel_no")).agg(F.count("*").alias("n_tests")).withColumn("panel_name", _cat("P", F.col("panel_no")))
    return results.report_json(results.merged_documents(_documents(spark, sf_dir)), made)


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS panel_no, count(*) AS n, count(*) FILTER (l_suppkey % 10 < 7) AS weak, bool_or(l_returnflag = 'R') AS review FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*) AS panels, CAST(sum(n) AS BIGINT) AS tests, CAST(sum(weak) AS BIGINT) AS weak_tests, count(*) FILTER (review) AS panels_in_review, round(sum(n) / count(*) + 1e-9, 6) AS tests_a_panel FROM p GROUP BY doc_id""")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("panel_no"), (F.col("l_suppkey") % 10 / 10).alias("confidence"), (F.col("l_returnflag") == "R").alias("needs_review"))
    return results.document_metrics(tests)


@query("""WITH s AS (SELECT event_id, event_id % 10 AS n, event_id % 7 AS v, event_id % 9 AS u, event_id % 8 AS r FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN n < 4 THEN 'name' END, CASE WHEN v < 6 THEN 'value' END, CASE WHEN u < 6 THEN 'unit' END, CASE WHEN r < 5 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS issues,
CASE least(n, v, u, r) WHEN n THEN 'name' WHEN v THEN 'value' WHEN u THEN 'unit' ELSE 'range' END AS weakest, CASE greatest(n, v, u, r) WHEN n THEN 'name' WHEN v THEN 'value' WHEN u THEN 'unit' ELSE 'range' END AS strongest FROM s""")
def field_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    scores = F.struct((k % 10 / 10).alias("name"), (k % 7 / 10).alias("value"), (k % 9 / 10).alias("unit"), (k % 8 / 10).alias("range"))
    return _t(spark, sf_dir, "events").select("event_id", results.field_issues(scores).alias("x")).select("event_id", "x.*")


@query("""WITH e AS (SELECT event_id AS id, unnest([{'label': 'A', 'p': event_id % 5}, {'label': 'B', 'p': event_id % 7}, {'label': 'C', 'p': event_id % 3}, {'label': 'D', 'p': 2}]) AS x FROM events), r AS (SELECT id, x.label AS label, x.p AS p, row_number() OVER (PARTITION BY id ORDER BY x.p DESC, x.label) AS place FROM e)
SELECT id, CAST(place AS INT) AS place, label, round(p / 10, 6) AS probability FROM r WHERE place <= 3""")
def top_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    made = F.create_map(F.lit("A"), k % 5 / 10, F.lit("B"), k % 7 / 10, F.lit("C"), k % 3 / 10, F.lit("D"), F.lit(0.2))
    return results.top_predictions(_t(spark, sf_dir, "events").select(k.alias("id"), made.alias("probabilities")))


@query("""WITH l AS (SELECT user_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'name' ELSE 'segment' END AS field, arg_max(event_id, event_id) AS seq FROM events GROUP BY ALL),
v AS (SELECT c_custkey AS doc_id, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)
SELECT v.doc_id, v.field, CASE WHEN l.seq IS NULL THEN v.value WHEN l.seq % 3 = 0 THEN NULL ELSE 'v' || l.seq END AS value, l.seq IS NOT NULL AS corrected FROM v LEFT JOIN l ON v.doc_id = l.doc_id AND v.field = l.field""")
def review_field_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = _t(spark, sf_dir, "customer"), F.col("event_id")
    values = c.select(F.col("c_custkey").alias("doc_id"), F.lit("name").alias("field"), F.col("c_name").alias("value")).unionByName(c.select(F.col("c_custkey").alias("doc_id"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")))
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(e % 2 == 0, "name").otherwise("segment").alias("field"), e.alias("seq"), F.when(e % 3 == 0, "unset").otherwise("set").alias("op"), _cat("v", e).alias("new"))
    return results.review_state(values, log)


@query("SELECT unnest(['added', 'removed', 'modified', 'unchanged']) AS kind, unnest([(SELECT count(*) FROM customer WHERE c_custkey % 4 = 0), 0, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 2), (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1)]) AS n")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return results.change_counts(_t(spark, sf_dir, "customer").select(_case(k, ["added", "unchanged", "modified", "unchanged"]).alias("kind")))


@query("SELECT page_id, string_split(coalesce(url, ''), '.')[1] AS base FROM pages")
def result_id_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correction log's variant: everything before the first point, of the pages' addresses."""
    return _t(spark, sf_dir, "pages").select("page_id", F.substring_index(F.coalesce("url", F.lit("")), ".", 1).alias("base"))


# Heads ----------------------------------------------------------------------------------------------------------


#: Customers a partition: a table of few bytes has many lines, which one task would work out alone.
_HEADS_A_PARTITION, _LEAST_HEADS = 10_000, 1_000


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight head lines a customer, dealt out by document before they are made."""
    k = F.col("doc_id")
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    n, usual = customers.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    customers = customers.repartition(max(1, -(-n // _HEADS_A_PARTITION), min(usual, -(-n // _LEAST_HEADS))), "doc_id")
    four = F.lpad(_s(k % 10000), 4, "0")
    two = F.lpad(_s(k % 28 + 1), 2, "0")
    person = _case(k % 3, ["Patient: Smith, Ann", "Patient: Doe, Jane Quinn", "Name: Robert Lee Gray"])
    made = [
        ("PAGE_HEADER", _cat("LabCorp Account: A", k, " Phone: 555-201-", four)),
        ("PAGE_HEADER", _cat("Fax (555) 301-", four)),
        ("PAGE_HEADER", _cat(k % 900 + 100, " Main Street, Springfield, CA ", k % 80000 + 10000)),
        ("HEADER_PATIENT", person),
        ("HEADER_PATIENT", _cat("DOB: 03/", two, "/1980, Sex: Female MRN: M", k)),
        ("HEADER_PHYSICIAN", F.when(k % 2 == 0, _cat("Oak Street Clinic NPI: 12345", F.lpad(_s(k % 100000), 5, "0"))).otherwise("Someone")),
        ("HEADER_SPECIMEN", _cat("Accession: S-", k, " Collected: 04/", two, "/2020, QC 77")),
        ("FREE_TEXT", F.when(k % 2 == 0, "Tests ordered: Lipid Panel, Thyroid Screen, Lipid Panel").otherwise("Serum")),
        ("FREE_TEXT", _cat("LabCorp Account: B", k, " Phone: 555-999-", four)),
    ]
    lines = F.array(*(F.struct(F.lit(i).alias("line_no"), F.lit(role).alias("role"), text.alias("text")) for i, (role, text) in enumerate(made)))
    return customers.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*")


@query("""WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS four, lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS two FROM customer),
f AS (SELECT k AS doc_id, unnest([
 {'section': 'vendor', 'field': 'name', 'value': 'LabCorp'}, {'section': 'vendor', 'field': 'account_number', 'value': 'A' || k}, {'section': 'vendor', 'field': 'phone', 'value': '(555) 201-' || four}, {'section': 'vendor', 'field': 'fax', 'value': '(555) 301-' || four},
 {'section': 'patient', 'field': 'last_name', 'value': ['Smith', 'Doe', 'Gray'][k % 3 + 1]}, {'section': 'patient', 'field': 'first_name', 'value': ['Ann', 'Jane', 'Robert'][k % 3 + 1]}, {'section': 'patient', 'field': 'middle', 'value': [NULL, 'Quinn', 'Lee'][k % 3 + 1]},
 {'section': 'patient', 'field': 'dob', 'value': '1980-03-' || two}, {'section': 'patient', 'field': 'sex', 'value': 'F'}, {'section': 'patient', 'field': 'mrn', 'value': 'M' || k}, {'section': 'patient', 'field': 'phone', 'value': '(555) 201-' || four},
 {'section': 'ordering', 'field': 'npi', 'value': CASE WHEN k % 2 = 0 THEN '12345' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') END},
 {'section': 'specimen', 'field': 'id', 'value': 'S-' || k}, {'section': 'specimen', 'field': 'control_id', 'value': '77'}, {'section': 'specimen', 'field': 'collected_at', 'value': '2020-04-' || two}, {'section': 'specimen', 'field': 'type', 'value': CASE WHEN k % 2 = 1 THEN 'Serum' END}]) AS f FROM c)
SELECT doc_id, f.section AS section, f.field AS field, f.value AS value FROM f WHERE f.value IS NOT NULL""")
def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.document_fields(_heads(spark, sf_dir))


@query("""SELECT c_custkey AS doc_id, 'vendor' AS section, (c_custkey % 900 + 100) || ' Main Street' AS street, 'Springfield' AS city, 'CA' AS state, CAST(c_custkey % 80000 + 10000 AS VARCHAR) AS zip FROM customer""")
def head_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.document_addresses(_heads(spark, sf_dir))


@query("""SELECT c_custkey AS doc_id, 'Oak Street Clinic NPI: 12345' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS name, 'Lipid Panel; Thyroid Screen' AS items FROM customer WHERE c_custkey % 2 = 0""")
def ordering_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _heads(spark, sf_dir)
    return headers.ordering_locations(lines).join(headers.ordered_items(lines), "doc_id")


_FIELD = lambda section, field: f"max(value) FILTER (section = '{section}' AND field = '{field}')"


@query(f"""WITH h AS ({ORACLES["document_heads"]}), o AS (SELECT doc_id, {_FIELD("patient", "first_name")} || ' ' || coalesce({_FIELD("patient", "last_name")}, '') AS name, {", ".join(f"{_FIELD(*where)} AS {name}" for name, where in stages.LEGACY.items())},
{", ".join(f"count(*) FILTER (section = '{section}') AS {name}" for section, name in stages.COUNTED.items())} FROM h GROUP BY doc_id) SELECT * FROM o""")
def header_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers under the names that clients know."""
    return stages.header_stage(_heads(spark, sf_dir))


# Labels ---------------------------------------------------------------------------------------------------------


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    result = _case(k % 4, ['{"from_name": "r", "value": {"choices": ["TEST_ROW", "X"]}}', '{"value": {"rectanglelabels": ["PAGE_HEADER"], "x": 1.5}}', "", '{"value": {"start": 4, "end": 14, "labels": ["NAME"]}}, {"value": {"start": 15, "end": 17, "labels": ["VALUE"]}}'])
    task = _cat('{"id": ', k, ', "data": {"text": "the total count ', k % 90 + 10, ' mg", "page": ', k % 3, '}, "annotations": [{"result": [', result, "]}]}")
    return _t(spark, sf_dir, "orders").select(F.when(k % 7 == 0, _cat("[", task, "]")).when(k % 13 == 1, "broken {").otherwise(task).alias("content"))


@query("""SELECT o_orderkey AS id, 'the total count ' || (o_orderkey % 90 + 10) || ' mg' AS text, o_orderkey % 3 AS page, CASE o_orderkey % 4 WHEN 0 THEN 'TEST_ROW' WHEN 1 THEN 'PAGE_HEADER' ELSE 'JUNK' END AS role FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 13 <> 1""")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.line_labels(labels.tasks(_exports(spark, sf_dir)))


@query("""WITH t AS (SELECT o_orderkey AS id, unnest([{'token': 'the', 'start': 0, 'tag': 'O'}, {'token': 'total', 'start': 4, 'tag': 'B-NAME'}, {'token': 'count', 'start': 10, 'tag': 'I-NAME'}, {'token': CAST(o_orderkey % 90 + 10 AS VARCHAR), 'start': 16, 'tag': 'I-VALUE'}, {'token': 'mg', 'start': 19, 'tag': 'O'}]) AS x FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 13 <> 1)
SELECT id, x.token AS token, x.start AS start, CASE WHEN id % 4 = 3 THEN x.tag ELSE 'O' END AS tag FROM t""")
def span_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.span_examples(labels.tasks(_exports(spark, sf_dir)))


_TEMPLATES = ["{name}: 5 {unit}", "Result of {name} in {unit}", "{unit} ({name})"]


@query("""SELECT p_partkey AS value_no, CAST((p_partkey + i) % 3 AS INT) AS template_no, CASE (p_partkey + i) % 3 WHEN 0 THEN p_name || ': 5 ' || p_type WHEN 1 THEN 'Result of ' || p_name || ' in ' || p_type ELSE p_type || ' (' || p_name || ')' END AS text FROM part, (SELECT unnest([0, 1]) AS i)""")
def template_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(enumerate(_TEMPLATES)), "template_no int, template string")
    values = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("value_no"), F.col("p_name").alias("name"), F.col("p_type").alias("unit"))
    return labels.from_templates(templates, values, 2).withColumn("template_no", F.col("template_no").cast("int"))


# Listings -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS promoted_at FROM orders ORDER BY coalesce(promoted_at, '') DESC, rid LIMIT 40""")
def golden_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return registry.golden_list(_t(spark, sf_dir, "orders").select(k.alias("rid"), F.when(k % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("promoted_at")), 40)


@query("""SELECT id, strftime(at_, '%Y-%m-%d') AS at FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderdate END AS at_ FROM orders) ORDER BY at_ DESC NULLS LAST, id LIMIT 60""")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    named = {c: F.when(k % 5 == i, d).when((k % 5 < i) | (k % 5 == 4), F.lit("soon" if i else None)) for i, c in enumerate(("updated_at", "started_at", "created_at", "completed_at"))}
    jobs = _t(spark, sf_dir, "orders").select(k.alias("id"), *(v.alias(c) for c, v in named.items()))
    return registry.newest_first(jobs, 60).select("id", F.date_format("at", "yyyy-MM-dd").alias("at"))


_URL = "coalesce(url, '')"
_FOLDER = f"CASE length({_URL}) % 4 WHEN 0 THEN 'inbox' WHEN 1 THEN 'outbox' WHEN 2 THEN split_part({_URL}, '/', 3) ELSE 'golden' END"
_NAME = f"CASE WHEN page_id % 3 = 0 THEN {_URL} ELSE split_part({_URL}, '/', CAST(1 + page_id % 6 AS INT)) END"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and names cut from the pages' addresses."""
    url = F.coalesce("url", F.lit(""))
    part = lambda i: F.split_part(url, F.lit("/"), i)
    folder = F.when(F.length(url) % 4 == 0, "inbox").when(F.length(url) % 4 == 1, "outbox").when(F.length(url) % 4 == 2, part(F.lit(3))).otherwise("golden")
    name = F.when(F.col("page_id") % 3 == 0, url).otherwise(part((1 + F.col("page_id") % 6).cast("int")))
    return _t(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), name.alias("name"))


@query(f"""WITH p AS (SELECT page_id, {_FOLDER} AS folder, {_NAME} AS name FROM pages) SELECT page_id, folder IN ('inbox', 'outbox', 'golden') AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AND NOT contains(name, '..') AND name <> '' AS servable FROM p""")
def servable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("page_id", registry.is_servable(F.col("folder"), F.col("name")).alias("servable"))


@query("SELECT unnest(['scanned', 'lists', 'to_migrate', 'errors']) AS kind, unnest([count(*), count(*) FILTER (event_id % 4 = 0), count(*) FILTER (event_id % 4 IN (1, 2)), count(*) FILTER (event_id % 4 = 3)]) AS n FROM events")
def migration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _case(F.col("event_id") % 4, [_cat(" [", F.col("props"), "]"), F.col("props"), '{"a": []}', "{broken"])
    return registry.shape_stats(_t(spark, sf_dir, "events").select(text.alias("content")))


@query("SELECT event_type AS kind, event_id AS seq, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS INT) AS place FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 7")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.last_events(_t(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq")), 7)


# Measures -------------------------------------------------------------------------------------------------------

_JUDGED = "j AS (SELECT l_returnflag AS truth, CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS pred, (l_suppkey * 3 + l_partkey) % 100 / 100.0::DOUBLE AS confidence FROM lineitem)"


@query(f"""WITH {_JUDGED} SELECT truth, count(*) AS n, count(*) FILTER (truth = pred) AS "right", round(avg(confidence) + 1e-9, 6) AS mean_confidence, count(*) FILTER (confidence > 0.9) AS over_90, count(*) FILTER (confidence > 0.7 AND confidence <= 0.9) AS to_90,
count(*) FILTER (confidence > 0.5 AND confidence <= 0.7) AS to_70, count(*) FILTER (confidence <= 0.5) AS to_50, round(count(*) FILTER (truth = pred) / count(*)::DOUBLE + 1e-9, 6) AS accuracy FROM j GROUP BY ROLLUP (truth)""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = F.col("l_partkey"), F.col("l_returnflag")
    judged = _t(spark, sf_dir, "lineitem").select(f.alias("truth"), F.when(p % 4 == 0, "N").otherwise(f).alias("pred"), ((F.col("l_suppkey") * 3 + p) % 100 / 100).alias("confidence"))
    out = training.classification_metrics(judged)
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean_confidence", "accuracy")})


@query(f"""WITH {report.ROLES}, c AS (SELECT role, count(*) AS n FROM roles GROUP BY role)
SELECT count(*) AS labels, max(n) AS most, min(n) AS fewest, count(*) FILTER (n < 5) AS rare, coalesce(max(n) FILTER (role = 'TEST_ROW'), 0) AS test_rows, max(n) > 10 * min(n) AS unbalanced, coalesce(max(n) FILTER (role = 'TEST_ROW'), 0) < 20 AS few_test_rows FROM c""")
def training_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.set_checks(report._roles(spark, sf_dir).select(F.col("role").alias("label")))


@query("""WITH t AS (SELECT event_id // 10 AS id, CASE event_id % 6 WHEN 0 THEN 'B-NAME' WHEN 1 THEN 'I-NAME' WHEN 2 THEN 'B-VALUE' ELSE 'O' END AS tag FROM events), e AS (SELECT CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS type, count(*) FILTER (tag LIKE 'B-%') AS entities, count(*) AS tokens, count(DISTINCT id) AS examples FROM t GROUP BY 1)
SELECT *, CASE WHEN type = 'O' THEN round(tokens / (SELECT sum(tokens) FROM e)::DOUBLE, 6) END AS share, CASE WHEN type = 'O' THEN 'balanced' END AS band FROM e""")
def tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return training.tag_stats(_t(spark, sf_dir, "events").select(F.floor(k / 10).alias("id"), _case(k % 6, ["B-NAME", "I-NAME", "B-VALUE", "O", "O", "O"]).alias("tag")))


@query("""WITH t AS (SELECT DISTINCT p_partkey % 25 AS doc_id, lower(p_name || ' ' || p_type) AS text FROM part), n AS (SELECT doc_id, count(*) AS texts FROM t GROUP BY doc_id),
g AS (SELECT doc_id, text, substr(text, i, k) AS run FROM t, (SELECT unnest([2, 3, 4]) AS k), unnest(range(1, length(text) - k + 2)) AS r(i)),
tf AS (SELECT doc_id, text, run, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT doc_id, run, count(*) AS df FROM tf GROUP BY ALL),
w AS MATERIALIZED (SELECT tf.doc_id, text, tf.run, tf * (1 + ln((1 + texts) / (1 + df)::DOUBLE)) AS w FROM tf JOIN df ON tf.doc_id = df.doc_id AND tf.run = df.run JOIN n ON n.doc_id = tf.doc_id),
u AS MATERIALIZED (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, text)) AS u FROM w)
SELECT a.doc_id, a.text AS a, b.text AS b, round(sum(a.u * b.u), 6) AS cosine FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.run = b.run AND a.text < b.text GROUP BY ALL HAVING sum(a.u * b.u) >= 0.4""")
def similar_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("doc_id"), F.lower(_cat(F.col("p_name"), " ", F.col("p_type"))).alias("text"))
    return layout.similar_texts(texts, 0.4).withColumn("cosine", F.round("cosine", 6))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dry ' || p_size WHEN 1 THEN 'HPLC' END AS methodology, CASE p_partkey % 4 WHEN 2 THEN '9:05 am' WHEN 3 THEN '19:30' END AS observed_at,
CASE p_partkey % 4 WHEN 0 THEN 'Method  dry ' || p_size WHEN 2 THEN 'at 9 05 am  hemolyzed' END AS comments FROM part""")
def row_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    text = _case(F.col("p_partkey") % 4, [_cat("Glucose 777 Method: dry ", n, ""), "Glucose 777 HPLC", "Glucose 777 at 9:05 am (hemolyzed)", "Glucose 777 19:30"])
    return _t(spark, sf_dir, "part").select("p_partkey", rows.row_extras(text, F.lit("Glucose"), F.lit("777")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.8 END * ((p_partkey % 11) / 10.0 * 0.6 + (p_size % 11) / 10.0 * 0.4) + 1e-9, 6)::DOUBLE AS confidence FROM part")
def lexicon_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(rows.lexicon_confidence(k % 11 / 10, F.col("p_size") % 11 / 10, k % 2 == 0) + 1e-9, 6).alias("confidence"))


@query(fr"""WITH {report.ROLES}, t AS (SELECT *, trim(text) AS t, lower(trim(text)) AS low, {report._UP} AS caps, CASE WHEN y <= 330 THEN 0 WHEN y <= 670 THEN 1 ELSE 2 END AS third FROM roles)
SELECT doc_id, row_no, CASE WHEN t = '' THEN 'EMPTY' WHEN (is_bold OR caps) AND regexp_matches(t, '(?i)\b(CMP|COMPREHENSIVE METABOLIC PANEL|CBC|COMPLETE BLOOD COUNT|LIPID PANEL|TSH|THYROID|BASIC METABOLIC PANEL|BMP|LIVER FUNCTION|KIDNEY FUNCTION|ELECTROLYTES|CHEMISTRY)\b') THEN 'SECTION_PANEL'
  WHEN regexp_matches(t, '(?i)\b[0-9]+[.]?[0-9]*[ \t]*(mmol|mEq|IU|U/L|ng/mL|mg/dL|g/dL|mcg/dL|µg/L|pg/mL|x10\^[0-9]+|%|cells/µL|fL|pg|g/L|mL|L|U|ng|mg|mcg|µg|cells|K/µL|/µL|/uL|per µL|per uL)\b') THEN 'TEST_ROW'
  WHEN contains(low, 'page') THEN 'PAGE_HEADER' WHEN regexp_matches(low, 'patient|name|dob|date of birth') THEN 'HEADER_PATIENT' WHEN regexp_matches(low, 'specimen|collected|accession') THEN 'HEADER_SPECIMEN' ELSE 'OTHER' END AS assigned,
 CASE WHEN t = '' THEN 'EMPTY' WHEN caps AND length(t) > 10 THEN 'SECTION_PANEL' WHEN regexp_matches(low, 'test|result|normal|high|low') THEN 'TEST_ROW' WHEN regexp_matches(low, 'patient|name|dob|id') THEN 'PATIENT_INFO' WHEN contains(low, 'page') THEN 'PAGE_HEADER' ELSE 'OTHER' END AS simple,
 CASE WHEN is_bold OR third = 2 THEN CASE WHEN regexp_matches(low, 'patient|name|dob|id') THEN 'HEADER_PATIENT' ELSE 'SECTION_PANEL' END WHEN third = 0 THEN 'PAGE_FOOTER' WHEN regexp_matches(low, 'test|result|value') THEN 'TEST_ROW' WHEN low LIKE '#%' OR contains(low, 'comment') THEN 'COMMENT' ELSE 'SECTION_MISC' END AS hinted FROM t""")
def other_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, third = F.col("text"), F.when(F.col("y") <= 330, 0).when(F.col("y") <= 670, 1).otherwise(2)
    return report._roles(spark, sf_dir).select("doc_id", "row_no", P.assigned_role(text, F.col("is_bold")).alias("assigned"), P.simple_role(text).alias("simple"), P.hinted_role(text, F.col("is_bold"), third).alias("hinted"))


@query()
def rows_tagged_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.tagged_by_rule(report._roles(spark, sf_dir).where("role = 'TEST_ROW'"))
    return found.select("doc_id", "row_no", F.array_join("tags", " ").alias("tags"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'docx' END AS kind, CASE o_orderkey % 5 WHEN 3 THEN 'job' WHEN 4 THEN 'job.03_compose' ELSE ['job.pdf', 'job.jpeg', 'job.docx'][o_orderkey % 5 + 1] END AS job FROM orders")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _case(F.col("o_orderkey") % 5, ["job.pdf", "job.jpeg", "job.docx", "job.03_compose.debug", "job.03_compose"])
    return _t(spark, sf_dir, "orders").select("o_orderkey", registry.file_kind(name).alias("kind"), registry.job_id(name).alias("job"))


@query(f"""WITH {report.ROLES}, r AS (SELECT doc_id, role, count(*) AS n, sum(CASE role WHEN 'SECTION_PANEL' THEN 0.9 WHEN 'TEST_ROW' THEN 0.8 WHEN 'PAGE_HEADER' THEN 0.8 WHEN 'PAGE_FOOTER' THEN 0.8 WHEN 'COMMENT' THEN 0.5 WHEN 'SECTION_MISC' THEN 0.6 WHEN 'JUNK' THEN 0.1 ELSE 0.7 END::DOUBLE) AS c FROM roles GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, round(sum(c) / sum(n) + 1e-9, 6) AS confidence, '{{' || string_agg('"' || role || '":' || n, ',' ORDER BY role) || '}}' AS roles FROM r GROUP BY doc_id""")
def role_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.role_documents(report._roles(spark, sf_dir))


@query(f"""WITH {report.ROLES} SELECT doc_id, row_no, regexp_matches(lower(text), 'patient|specimen|lab|report|results|test|name:|dob:|mrn:|accession:|collected:|received:|provider:|location:|status:|reference|range|panel|profile|chemistry|hematology|urinalysis') AS hint,
CASE WHEN y / 1000 <= 0.33 THEN 0 WHEN y / 1000 <= 0.67 THEN 1 ELSE 2 END AS third FROM roles""")
def header_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report._roles(spark, sf_dir).select("doc_id", "row_no", P.header_hint(F.col("text")).alias("hint"), P.third_of_page(F.col("y") / 1000).alias("third"))


@query(f"""WITH {report.ROLES} SELECT doc_id, count(*) AS expected, count(*) FILTER (role = 'SECTION_PANEL') AS headers FROM roles WHERE regexp_matches(text, '(?i)CBC.*With.*Differential|Comprehensive.*Metabolic.*Panel|CMP|Complete.*Blood.*Count') GROUP BY doc_id""")
def expected_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.expected_panels(report._roles(spark, sf_dir))


@query("""WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS line_no, l_partkey AS p FROM lineitem),
l AS (SELECT doc_id, line_no, 1 + (line_no - 1) // 8 AS page, line_no % 6 = 1 AS head, CASE WHEN line_no % 6 = 1 THEN 'Panel ' || CASE p % 3 WHEN 0 THEN '*' WHEN 1 THEN '[1]' ELSE '' END WHEN p % 4 = 0 THEN '* note ' || p % 5 WHEN p % 4 = 1 THEN ' [1]also ' || p % 3 ELSE 'row' END AS text, p % 3 AS kind, count(*) OVER (PARTITION BY doc_id, 1 + (line_no - 1) // 8) - row_number() OVER (PARTITION BY doc_id, 1 + (line_no - 1) // 8 ORDER BY line_no) AS below FROM n),
h AS (SELECT * FROM l WHERE head AND kind < 2),
f AS (SELECT h.doc_id, h.line_no, CASE h.kind WHEN 0 THEN trim(substr(trim(x.text), 2)) ELSE trim(substr(trim(x.text), 4)) END AS note, min(CASE WHEN x.line_no > h.line_no AND x.line_no <= h.line_no + 10 THEN x.line_no ELSE 1000000 + x.line_no END) AS place FROM h JOIN l x ON h.doc_id = x.doc_id AND h.page = x.page AND ((x.line_no > h.line_no AND x.line_no <= h.line_no + 10) OR x.below < 5) AND starts_with(trim(x.text), CASE h.kind WHEN 0 THEN '*' ELSE '[1]' END) GROUP BY ALL)
SELECT doc_id, line_no, string_agg(note, '; ' ORDER BY place) AS comments FROM f WHERE note <> '' GROUP BY doc_id, line_no""")
def panel_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("l_partkey"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER))
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("line_no"), p.alias("l_partkey"))
    head = F.col("line_no") % 6 == 1
    text = F.when(head, _cat("Panel ", F.when(p % 3 == 0, "*").when(p % 3 == 1, "[1]").otherwise(""))).when(p % 4 == 0, _cat("* note ", p % 5)).when(p % 4 == 1, _cat(" [1]also ", p % 3)).otherwise("row")
    lines = items.select("doc_id", "line_no", F.expr("1 + (line_no - 1) div 8").alias("page"), F.when(head, "SECTION_PANEL").otherwise("TEST_ROW").alias("role"), text.alias("text"))
    return panels.panel_notes(lines)
