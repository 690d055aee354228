"""Queries over the synthetic report pages: layout, roles, rows, panels, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import predicates as P
from panelspark.operators import compose, layout, panels, rows, scoring
from panelspark.plans.sql import BINS, CELLS, ROWS
from panelspark.sources.lines import chunked_pages, synthetic_cells

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(name: str):
    """To six places; the nudge makes ties fall alike whatever the order of additions."""
    return F.round(F.col(name) + 1e-9, 6)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_rows(synthetic_cells(spark, sf_dir))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _rows(spark, sf_dir).withColumn("_text", F.trim("text")).withColumn("_low", F.lower("_text"))  # once a row, not at every rung
    ladder = P.ladder_of(F.col("_text"), F.col("_low"), F.col("is_bold"), F.col("y"))
    return made.withColumn("_l", ladder).select("*", F.col("_l.role").alias("role"), F.col("_l.confidence").alias("role_confidence")).drop("_l", "_text", "_low")


# The role ladder in SQL.
_UP = "(text = upper(text) AND text <> lower(text))"
_ANALYTE = "sodium|potassium|chloride|co2|calcium|glucose|bun|creatinine|albumin|total protein|ast|alt|alk phos|bilirubin|wbc|rbc|hemoglobin|hgb|hematocrit|hct|mcv|mch|mchc|rdw|platelets|plt|cholesterol|triglycerides|hdl|ldl|vldl|non-hdl|tsh|free t4|free t3"
_RULE_ROW = f"""(regexp_matches(text, '(?i)[0-9]+([.][0-9]+)?[ \t]*(mg/dL|mmol/L|IU/L|U/L|g/dL|%|x10[\\^][0-9]+|pg/mL|ng/mL|fL|pg)') OR (regexp_matches(lower(text), '{_ANALYTE}') AND regexp_matches(text, '[0-9]')))"""
ROLES = (
    ROWS
    + f""",
roles AS (SELECT *, CASE
  WHEN regexp_matches(upper(text), '(^|[^A-Z0-9_])(CMP|COMPREHENSIVE METABOLIC|CBC|COMPLETE BLOOD COUNT|LIPID|TSH|THYROID|BASIC METABOLIC PANEL|BMP)([^A-Z0-9_]|$)') AND (is_bold OR {_UP}) THEN 'SECTION_PANEL'
  WHEN {_RULE_ROW} THEN 'TEST_ROW'
  WHEN contains(lower(text), 'page') AND y > 900 THEN 'PAGE_HEADER'
  WHEN contains(lower(text), 'page') THEN 'PAGE_FOOTER'
  WHEN regexp_matches(lower(text), 'patient:|patient name') THEN 'HEADER_PATIENT_NAME'
  WHEN regexp_matches(lower(text), 'dob:|date of birth|sex:|mrn:') THEN 'HEADER_PATIENT_DEMO'
  WHEN regexp_matches(lower(text), 'address:|phone:|street|city') THEN 'HEADER_PATIENT_CONTACT'
  WHEN regexp_matches(lower(text), 'ordering|physician|doctor|provider') THEN 'HEADER_ORDERING'
  WHEN regexp_matches(lower(text), 'laboratory|lab:|clia:|performing') THEN 'HEADER_LAB'
  WHEN regexp_matches(lower(text), 'specimen|collected|accession') THEN 'HEADER_SPECIMEN'
  WHEN text <> '' AND NOT regexp_matches(text, '[0-9]') THEN 'COMMENT'
  WHEN {_UP} AND length(text) > 5 THEN 'SECTION_MISC' ELSE 'JUNK' END AS role FROM rows_)"""
)
ASSIGNED = (
    ROLES
    + """,
assigned AS (SELECT *, last_value(CASE WHEN role = 'SECTION_PANEL' THEN text END IGNORE NULLS) OVER w AS panel_name,
  CAST(sum(CASE WHEN role = 'SECTION_PANEL' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS panel_no
  FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY row_no ROWS UNBOUNDED PRECEDING))"""
)
_V = "([<>=]*[ ]*[0-9]+([.][0-9]+)?)"
_R = "([0-9]+([.][0-9]+)?[ ]*[-–][ ]*[0-9]+([.][0-9]+)?)"
COARSE = (
    ASSIGNED
    + f""",
val AS (SELECT *, nullif(regexp_extract(trim(text), '{_V}', 1), '') AS v FROM assigned WHERE role = 'TEST_ROW'),
pos AS (SELECT *, instr(trim(text), v) AS at_ FROM val),
coarse AS (SELECT doc_id, row_no, panel_no, panel_name, trim(v) AS result_value,
  CASE WHEN v IS NOT NULL THEN nullif(trim(substr(trim(text), 1, at_ - 1)), '') END AS test_name,
  CASE WHEN v IS NOT NULL THEN nullif(regexp_extract(substr(trim(text), at_ + length(v), 20), '(?i)(mg/dL|mmol/L|g/dL|IU/L|U/L|pg/mL|ng/mL|x10[\\^][0-9]+|%|fL|pg)', 1), '') END AS unit,
  CASE WHEN v IS NOT NULL THEN nullif(trim(regexp_extract(trim(text), '{_R}', 1)), '') END AS reference_range,
  CASE WHEN v IS NULL THEN 0 ELSE CAST(len(list_filter(regexp_split_to_array(trim(text), '[ \t]+'), lambda t: upper(t) IN ('HIGH','LOW','H','L','↑','↓'))) AS BIGINT) END AS n_flags FROM pos)"""
)
_N = "[0-9]+[.]?[0-9]*"
_SCORED = "'mg/dL','g/dL','g/L','mg/L','mcg/dL','mcg/L','ng/mL','pg/mL','mmol/L','umol/L','nmol/L','pmol/L','mEq/L','IU/L','U/L','mU/L','uU/mL','mIU/L','K/uL','M/uL','cells/uL','10^3/uL','10^6/uL','10^9/L','x10^3/uL','x10^6/uL','thou/uL','mill/uL','%','percent','ratio','index','score','units','sec','seconds','min','minutes','hr','hours','day','days','mmHg','cmH2O','kPa','C','F','mL','L','uL','dL','g','kg','mg','ug','ng','pg','IU','U','mU','uU','KU','MU'"
_TERMS = "glucose sodium potassium chloride cholesterol triglyceride hemoglobin hematocrit platelet white red cell count protein albumin globulin bilirubin creatinine urea enzyme hormone vitamin mineral electrolyte lipid".split()
_MATCHES = " + ".join(f"CAST(contains(lower(test_name), '{t}') AS INT)" for t in _TERMS)
SCORED = (
    COARSE
    + f""",
scored AS (SELECT *,
  CASE WHEN coalesce(result_value, '') = '' THEN 0.0::DOUBLE WHEN regexp_matches(result_value, '^[0-9]+([.][0-9]+)?$') THEN 1.0 WHEN regexp_matches(result_value, '^[<>~]?[ ]*{_N}$') THEN 0.8 WHEN regexp_matches(result_value, '[0-9]') THEN 0.4 ELSE 0.1 END AS value_s,
  CASE WHEN coalesce(unit, '') = '' THEN 0.0::DOUBLE WHEN unit IN ({_SCORED}) THEN 1.0 WHEN lower(unit) IN ({_SCORED.lower()}) THEN 0.9 WHEN regexp_matches(unit, '^[a-zA-Z]+/[a-zA-Z]+$') THEN 0.6 WHEN regexp_matches(unit, '^[a-zA-Z%]+$') THEN 0.4 ELSE 0.3 END AS unit_s,
  CASE WHEN coalesce(reference_range, '') = '' THEN 0.0::DOUBLE WHEN regexp_matches(reference_range, '^{_N}[ ]*-[ ]*{_N}$') THEN 1.0 ELSE 0.5 END AS range_s,
  CASE WHEN coalesce(test_name, '') = '' THEN 0.0::DOUBLE ELSE least(1.0, least(length(test_name) / 20.0::DOUBLE, 1.0) * CASE WHEN length(test_name) < 3 THEN 0.5 ELSE 1.0 END * (0.5::DOUBLE + least(({_MATCHES}) * 0.1::DOUBLE, 0.3)
    - CASE WHEN regexp_matches(test_name, '[^A-Za-z0-9_ /()-]') THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN test_name = upper(test_name) AND test_name <> lower(test_name) AND length(test_name) > 10 THEN 0.05::DOUBLE ELSE 0 END
    - CASE WHEN regexp_matches(test_name, '[0-9]{{3,}}') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(test_name, '^[A-Z]') AND NOT (test_name = upper(test_name) AND test_name <> lower(test_name)) THEN 0.05::DOUBLE ELSE 0 END)) END AS name_s FROM coarse),
tests AS (SELECT *, least(1.0, value_s * 0.3::DOUBLE + unit_s * 0.25::DOUBLE + range_s * 0.2::DOUBLE + name_s * 0.15::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE) AS confidence, CASE WHEN panel_no = 0 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS continuity FROM scored)"""
)
PANELS = (
    SCORED
    + """,
agg AS (SELECT doc_id, panel_no, count(*) AS n_tests, avg(confidence) AS avg_confidence, min(continuity) AS continuity, (count(unit) + count(reference_range)) / (2.0::DOUBLE * count(*)) AS coherence,
  count(*) FILTER (value_s < 0.7) / count(*)::DOUBLE AS v, count(*) FILTER (unit_s < 0.8) / count(*)::DOUBLE AS u, count(*) FILTER (range_s < 0.6) / count(*)::DOUBLE AS r FROM tests GROUP BY doc_id, panel_no),
panels AS (SELECT *, least(1.0, avg_confidence * 0.5::DOUBLE + continuity * 0.25::DOUBLE + coherence * 0.25::DOUBLE) AS score,
  concat_ws(',', CASE WHEN v > 0.3 THEN 'values' END, CASE WHEN u > 0.4 THEN 'units' END, CASE WHEN r > 0.5 THEN 'ranges' END, CASE WHEN continuity < 0.5 THEN 'continuity' END, CASE WHEN coherence < 0.6 THEN 'coherence' END) AS reasons FROM agg),
panels2 AS (SELECT *, score < 0.7 OR reasons <> '' AS needs_review FROM panels)"""
)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panels.assign_panels(_roles(spark, sf_dir)).where("role = 'TEST_ROW'")
    return found.select("doc_id", "row_no", "panel_no", "panel_name", rows.coarse_fields(F.col("text")).alias("f")).select("doc_id", "row_no", "panel_no", "panel_name", "f.*")


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    scored = _coarse(spark, sf_dir).withColumns({"value_s": rows.value_score(c("result_value")), "unit_s": rows.unit_score(c("unit")), "range_s": rows.range_score(c("reference_range")), "name_s": rows.name_score(c("test_name"))})
    confidence = rows.row_confidence(c("value_s"), c("unit_s"), c("range_s"), c("name_s"), F.lit(None).cast("double"))
    return scored.withColumn("confidence", confidence).withColumn("continuity", F.when(c("panel_no") == 0, 0.35).otherwise(1.0)).withColumnRenamed("unit", "units")


def best_panels(scored: DataFrame, most: int = 500) -> DataFrame:
    """The panels of the best scores as they are shown, to six places: scores that differ by their additions alone are ties, which go by doc_id and panel_no."""
    shown = scored.select("doc_id", "panel_no", "n_tests", _rounded("avg_confidence").alias("avg_confidence"), _rounded("score").alias("score"), "reasons", "needs_review")
    return shown.orderBy(F.desc("score"), "doc_id", "panel_no").limit(most)


@query(f"WITH {PANELS} SELECT doc_id, panel_no, n_tests, round(avg_confidence + 1e-9, 6) AS avg_confidence, round(score + 1e-9, 6) AS score, reasons, needs_review FROM panels2 ORDER BY score DESC, doc_id, panel_no LIMIT 500")
def flagship_panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 best panels: cells to rows, roles, panels, fields, scores."""
    return best_panels(scoring.panel_scores(_tests(spark, sf_dir)))


@query(f"WITH {CELLS} SELECT doc_id, line_no, page, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, text, is_bold FROM cells")
def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_cells(spark, sf_dir).select("doc_id", "line_no", "page", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "text", "is_bold")


@query(f"WITH {BINS} SELECT doc_id, page, line_no, CAST(bin AS BIGINT) AS bin FROM bins")
def row_merge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_bins(synthetic_cells(spark, sf_dir)).select("doc_id", "page", "line_no", "bin")


@query(f"WITH {ROWS} SELECT doc_id, row_no, page, text, round(y, 6) AS y, is_bold, CAST(font AS DOUBLE) AS font, CAST(x_left AS BIGINT) AS x_left, CAST(x_right AS BIGINT) AS x_right, n_cells FROM rows_")
def row_merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    return r.select("doc_id", "row_no", "page", "text", F.round("y", 6).alias("y"), "is_bold", "font", F.col("x_left").cast("long").alias("x_left"), F.col("x_right").cast("long").alias("x_right"), "n_cells")


@query(f"""WITH {CELLS} SELECT doc_id, page, median(x) FILTER (regexp_matches(text, '^[0-9]+ [A-Za-z%]')) AS unit_x, median(x) FILTER (regexp_matches(text, '^[0-9]+-[0-9]+$')) AS range_x FROM cells GROUP BY doc_id, page""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_anchors(synthetic_cells(spark, sf_dir))


_PAGES = "pages_ AS (SELECT doc_id, i + 1 AS page, substr(text, i * 400 + 1, 400) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 400 + 1)) AS i FROM documents WHERE length(text) > 0))"


@query(f"""WITH {_PAGES}, p AS (SELECT * FROM pages_ WHERE (doc_id + page) % 11 <> 0), s AS (SELECT doc_id, page, sum(length(trim(text))) AS chars FROM p GROUP BY ALL),
m AS (SELECT doc_id, unnest(range(1, max(page) + 1)) AS page FROM s GROUP BY doc_id)
SELECT doc_id, CAST(page AS INT) AS page FROM s WHERE chars < 120 UNION SELECT doc_id, CAST(page AS INT) FROM m ANTI JOIN s USING (doc_id, page)""")
def low_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chunked_pages(spark.read.parquet(f"{sf_dir}/documents.parquet")).where((F.col("doc_id") + F.col("page")) % 11 != 0)
    return layout.low_text_pages(pages, 120)


@query(f"WITH {ROWS} SELECT doc_id, regexp_replace(lower(trim(text)), '[0-9]+', '[NUM]', 'g') AS masked, count(DISTINCT page) AS pages, count(*) AS lines FROM rows_ WHERE y < 100 OR y > 900 GROUP BY ALL HAVING count(DISTINCT page) >= 2")
def repeat_header_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_texts(_rows(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t]+'), lambda w: w <> ''))"


@query(f"""WITH {ROWS}, e AS MATERIALIZED (SELECT doc_id, page, row_no, y, {_WORDS} AS w FROM rows_ WHERE y < 100 OR y > 900),
p AS MATERIALIZED (SELECT doc_id, a.row_no AS row_a, b.row_no AS row_b, a.page AS page_a, b.page AS page_b, a.y AS y_a, b.y AS y_b, a.w AS w_a, b.w AS w_b FROM e a JOIN e b USING (doc_id)),
j AS (SELECT doc_id, row_a, row_b, len(list_filter(w_a, lambda w: list_contains(w_b, w))) AS shared, len(w_a) + len(w_b) AS words FROM p WHERE page_a < page_b AND abs(y_a - y_b) < 100)
SELECT doc_id, row_a, row_b, CAST(shared AS BIGINT) AS shared, CAST(words - shared AS BIGINT) AS total FROM j WHERE shared * 100 >= (words - shared) * 60""")
def repeat_header_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_pairs(_rows(spark, sf_dir), 60)


@query()
def quarantine_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.greedy_repeats(_rows(spark, sf_dir), 60)


@query(f"WITH {ROWS} SELECT doc_id, row_no, count(*) OVER (PARTITION BY doc_id) >= 10 AND (y > 950 OR y < 50 OR regexp_matches(lower(text), 'page|copyright|confidential')) AS quarantine FROM rows_")
def quarantine_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.quarantined(_rows(spark, sf_dir)).select("doc_id", "row_no", "quarantine")


@query(f"WITH {ROLES} SELECT doc_id, row_no, role FROM roles")
def role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("doc_id", "row_no", "role")


@query(f"WITH {ROLES} SELECT role, count(*) AS n FROM roles GROUP BY role")
def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {ROLES} SELECT doc_id, row_no, CASE WHEN role IN ('PAGE_HEADER','PAGE_FOOTER','HEADER_PATIENT','HEADER_SPECIMEN','SECTION_PANEL','TEST_ROW','COMMENT','SECTION_MISC','JUNK') THEN role WHEN contains(upper(role), 'SECTION') THEN 'SECTION_MISC' ELSE 'JUNK' END AS role FROM roles""")
def role_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("doc_id", "row_no", P.served_role(F.col("role")).alias("role"))


_HAS_UNITS = "regexp_matches(lower(text), 'mg/dl|mmol/l|g/dl|iu/l|u/l|ng/ml|pg/ml|/ul|%|fl|iu/ml')"
_HEUR = f"""(role <> 'SECTION_PANEL' AND trim(text) <> '' AND NOT (len(list_filter(regexp_split_to_array(text, '[ \t]+'), lambda t: t <> '')) >= 12 AND NOT contains(text, chr(9)) AND NOT {_HAS_UNITS} AND NOT regexp_matches(text, '{_R}'))
  AND ((regexp_matches(text, '[0-9]') AND {_HAS_UNITS}) OR regexp_matches(text, '{_R}') OR (regexp_matches(text, '[0-9]') AND regexp_matches(upper(text), '(^|[^A-Z0-9_])(H|L|HIGH|LOW|ABN|CRIT|CRITICAL)([^A-Z0-9_]|$)'))))"""


@query(f"WITH {ROLES} SELECT doc_id, row_no, {_HEUR} AS is_row FROM roles")
def row_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("doc_id", "row_no", P.is_heuristic_row(F.col("text"), F.col("role")).alias("is_row"))


@query(f"""WITH {ROLES}, g AS (SELECT *, count(*) FILTER (role = 'TEST_ROW') OVER (PARTITION BY doc_id) AS n FROM roles) SELECT doc_id, row_no, CASE WHEN n < 3 AND {_HEUR} THEN 'TEST_ROW' ELSE role END AS role FROM g""")
def heuristic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.count(F.when(F.col("role") == "TEST_ROW", 1)).over(W.partitionBy("doc_id"))
    role = F.when((n < 3) & P.is_heuristic_row(F.col("text"), F.col("role")), "TEST_ROW").otherwise(F.col("role"))
    return _roles(spark, sf_dir).select("doc_id", "row_no", role.alias("role"))


_MED = "'mg/dL','g/dL','g/L','mg/L','mcg/dL','mcg/L','ng/mL','pg/mL','mmol/L','umol/L','nmol/L','pmol/L','mEq/L','IU/L','U/L','mU/L','uU/mL','mIU/L','uIU/mL','mL/min/1.73','K/uL','M/uL','cells/uL','10^3/uL','10^6/uL','10^9/L','x10^3/uL','x10^6/uL','thou/uL','mill/uL','%','percent','ratio','index','score','units','sec','seconds','min','minutes','hr','hours','day','days','mmHg','cmH2O','kPa','C','F','mL','L','uL','dL','g','kg','mg','ug','ng','pg','IU','U','mU','uU','KU','MU','fL','copies/mL','cells/mL','cm','mm','bpm'"
_AN1 = "glucose|cholesterol|triglyceride|sodium|potassium|chloride|co2|bun|creatinine|hemoglobin|hematocrit|wbc|rbc|platelet|mcv|mch|mchc|tsh|t4|t3|cortisol|insulin|hba1c|psa|cea|alt|ast|alp|ggt|ldh|ck|troponin|bnp|procalcitonin|temperature|weight|height|age|bp|pulse|resp"


@query(f"""WITH {ROWS}, t AS (SELECT doc_id, row_no, trim(text) AS text, list_filter(regexp_split_to_array(trim(text), '[ \t]+'), lambda t: t <> '') AS ts FROM rows_),
u AS (SELECT *, ts[1] AS f, coalesce(list_position(list_transform(ts, lambda t: regexp_matches(t, '[0-9]')), true), 0) AS at_, len(list_filter(ts, lambda t: regexp_replace(t, '[^A-Za-z0-9_/^.-]', '', 'g') IN ({_MED}))) > 0 AS has_unit FROM t)
SELECT doc_id, row_no, coalesce(NOT regexp_matches(lower(text), 'specimen[ ]+id[ ]*:|accession|acct[ ]*#|mrn|patient[ ]+id|phone|fax|rte|clia|npi|director|location|collected|received|entered|reported')
 AND NOT regexp_matches(text, '[(][0-9]{{3}}[)][ ]*[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}') AND length(text) - length(replace(text, ':', '')) < 2 AND len(ts) >= 2 AND at_ > 0
 AND CASE WHEN has_unit THEN lower(f) NOT IN ('the','and','or','in','on','at','to','for') AND NOT (f LIKE '%:' OR regexp_matches(f, '^[0-9]+$')) AND at_ <= 6
   ELSE at_ <= 2 AND NOT (f LIKE '%:' OR regexp_matches(f, '^[0-9]+$')) AND regexp_matches(lower(f), '^({_AN1})$') END, false) AS is_row FROM u""")
def is_probable_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", "row_no", P.is_probable_row(F.col("text")).alias("is_row"))


@query(f"""WITH {ROWS} SELECT doc_id, row_no, round(CASE WHEN upper(trim(text)) IN ('COMPREHENSIVE METABOLIC PANEL','CMP','BASIC METABOLIC PANEL','BMP','COMPLETE BLOOD COUNT','CBC','CBC WITH DIFFERENTIAL','LIPID PANEL','TSH','THYROID STIMULATING HORMONE') THEN 0.7 ELSE 0 END::DOUBLE + CASE WHEN is_bold THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN y <= 200 THEN 0.15 ELSE 0 END::DOUBLE, 6) AS score FROM rows_""")
def panel_header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", "row_no", F.round(P.header_score(F.col("text"), F.col("is_bold"), F.col("y")), 6).alias("score"))


@query(f"WITH {COARSE} SELECT doc_id, row_no, test_name, result_value, unit, reference_range, n_flags FROM coarse")
def coarse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir).select("doc_id", "row_no", "test_name", "result_value", "unit", "reference_range", "n_flags")


_FLAG = "(?:HIGH|LOW|H|L|ABN|ABNORMAL|CRIT|CRITICAL|ALERT)"
_PRIMARY = rows.PRIMARY.replace("'", "''")


@query(f"""WITH {ROLES}, t AS (SELECT doc_id, row_no, replace(text, chr(9), ' ') AS text FROM roles WHERE role = 'TEST_ROW'),
g AS (SELECT doc_id, row_no, nullif(trim(regexp_extract(text, '{_PRIMARY}', 1)), '') AS g1, nullif(regexp_extract(text, '{_PRIMARY}', 2), '') AS g2, nullif(regexp_extract(text, '{_PRIMARY}', 3), '') AS g3, nullif(regexp_extract(text, '{_PRIMARY}', 4), '') AS g4, nullif(regexp_extract(text, '{_PRIMARY}', 5), '') AS g5 FROM t),
h AS (SELECT *, coalesce(regexp_matches(upper(g4), '^{_FLAG}$') AND g3 IS NULL, false) AS moved FROM g),
i AS (SELECT *, upper(coalesce(g3, CASE WHEN moved THEN g4 END)) AS f, CASE WHEN NOT moved THEN g4 END AS raw FROM h)
SELECT doc_id, row_no, g1 AS test_name, g2 AS result_value, raw AS units, replace(g5, ' ', '') AS reference_range,
 CASE WHEN f IN ('HIGH','H') THEN 'HIGH' WHEN f IN ('LOW','L') THEN 'LOW' WHEN f IN ('ABN','ABNORMAL') THEN 'ABNORMAL' WHEN f IN ('CRIT','CRITICAL') THEN 'CRITICAL' WHEN f = 'ALERT' THEN 'ALERT' END AS flag,
 CASE WHEN (upper(g1) = 'WBC' AND raw NOT IN ('x10E3/uL','10^3/uL','10e3/uL')) OR (upper(g1) = 'HGB' AND raw <> 'g/dL') OR (upper(g1) = 'GLUCOSE' AND raw NOT IN ('mg/dL','mmol/L')) OR (upper(g1) IN ('SODIUM','POTASSIUM') AND raw <> 'mmol/L') OR (upper(g1) = 'TSH' AND raw NOT IN ('uIU/mL','mIU/L')) THEN 'unit_unlikely_for_test' END AS warning FROM i""")
def parse_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _roles(spark, sf_dir).where("role = 'TEST_ROW'")
    return r.select("doc_id", "row_no", rows.parse_row(F.replace("text", F.lit("\t"), F.lit(" "))).alias("p")).select("doc_id", "row_no", "p.*")


_TOKENS = f"""tk AS (SELECT doc_id, row_no, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM (SELECT doc_id, row_no, list_filter(regexp_split_to_array(text, '[ \t]+'), lambda t: t <> '') AS ts FROM roles WHERE role = 'TEST_ROW')),
kd AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9]+([.][0-9]+)?-[0-9]+([.][0-9]+)?$') THEN 'RANGE' WHEN regexp_matches(token, '^[<>]?[0-9]+([.][0-9]+)?$') THEN 'VALUE' WHEN token IN ('H','L') THEN 'FLAG' WHEN token IN ({_MED}) THEN 'UNIT' ELSE 'NAME' END AS label FROM tk)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.tagged_tokens(_roles(spark, sf_dir).where("role = 'TEST_ROW'"))


@query(f"""WITH {ROLES}, {_TOKENS}, n AS (SELECT *, sum(CASE WHEN lag_ IS NOT DISTINCT FROM label THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, row_no ORDER BY pos) AS span FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id, row_no ORDER BY pos) AS lag_ FROM kd)),
sp AS (SELECT doc_id, row_no, span, label, string_agg(token, ' ' ORDER BY pos) AS text, min(pos) AS s FROM n GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row_no, label ORDER BY length(text) DESC, s) AS k FROM sp) SELECT doc_id, row_no, label, text FROM rk WHERE k = 1""")
def bio_to_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.longest_spans(rows.spans(_tokens(spark, sf_dir)))


@query(f"""WITH {ROLES}, {_TOKENS} SELECT doc_id, row_no, pos, token, lag(token, 1, 'BOS') OVER w AS before, lead(token, 1, 'EOS') OVER w AS after FROM kd WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY pos)""")
def context_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.context(_tokens(spark, sf_dir))


@query(f"""WITH {ROLES}, {_TOKENS}, sp AS (SELECT doc_id, row_no, text, CAST(instr(text, t) AS BIGINT) AS a, CAST(instr(text, t) + length(t) AS BIGINT) AS b FROM (SELECT doc_id, row_no, text, regexp_extract(text, '[0-9]+ [A-Za-z%]+') AS t FROM roles WHERE role = 'TEST_ROW') WHERE t <> ''),
tp AS (SELECT doc_id, row_no, pos, token, a1, a1 + length(token) AS b1 FROM (SELECT k.doc_id, k.row_no, k.pos, k.token, 1 + coalesce(sum(length(k.token) + 1) OVER (PARTITION BY k.doc_id, k.row_no ORDER BY k.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a1 FROM kd k))
SELECT t.doc_id, t.row_no, t.pos, t.token FROM tp t JOIN sp s ON t.doc_id = s.doc_id AND t.row_no = s.row_no AND t.a1 < s.b AND t.b1 > s.a""")
def span_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that overlap a value-with-unit span (interval join within a row)."""
    from pyspark.sql import Window as W

    r = _roles(spark, sf_dir).where("role = 'TEST_ROW'")
    found = F.regexp_extract("text", "[0-9]+ [A-Za-z%]+", 0)
    spans = r.select("doc_id", "row_no", F.instr("text", found).alias("a"), (F.instr("text", found) + F.length(found)).alias("b"), found.alias("t")).where("t <> ''").drop("t")
    before = W.partitionBy("doc_id", "row_no").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    toks = rows.tagged_tokens(r).withColumn("a1", 1 + F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0)))
    return toks.join(spans, ["doc_id", "row_no"]).where((F.col("a1") < F.col("b")) & (F.col("a1") + F.length("token") > F.col("a"))).select("doc_id", "row_no", "pos", "token")


@query(f"WITH {SCORED} SELECT doc_id, row_no, value_s, unit_s, range_s, round(name_s + 1e-9, 6) AS name_s FROM tests")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(spark, sf_dir).select("doc_id", "row_no", "value_s", "unit_s", "range_s", _rounded("name_s").alias("name_s"))


@query(f"WITH {SCORED} SELECT doc_id, row_no, round(confidence + 1e-9, 6) AS confidence FROM tests")
def row_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(spark, sf_dir).select("doc_id", "row_no", _rounded("confidence").alias("confidence"))


@query(f"WITH {ASSIGNED} SELECT doc_id, row_no, panel_name, panel_no FROM assigned")
def panel_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.assign_panels(_roles(spark, sf_dir)).select("doc_id", "row_no", "panel_name", "panel_no")


@query(f"WITH {ROLES} SELECT doc_id, row_no, page > coalesce(max(page) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS is_break FROM roles")
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.page_breaks(_roles(spark, sf_dir)).select("doc_id", "row_no", "is_break")


@query(f"""WITH {ROLES}, f AS (SELECT doc_id, row_no, {", ".join(f"coalesce(lead(CAST(role = 'TEST_ROW' AS INT), {i}) OVER w, 0) AS f{i}" for i in range(5))} FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY row_no))
SELECT doc_id, row_no, f0 + f1 + f2 = 3 OR f1 + f2 + f3 = 3 OR f2 + f3 + f4 = 3 AS enough_ahead FROM f""")
def k_in_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.k_in_m(_roles(spark, sf_dir)).select("doc_id", "row_no", "enough_ahead")


@query(f"""WITH {ROLES}, h AS (SELECT *, last_value(CASE WHEN is_bold AND regexp_matches(text, '[A-Za-z]+ [A-Za-z]+|^[A-Z]{{3,}}$') THEN {{'p': page, 't': text}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS h FROM roles)
SELECT doc_id, row_no, CASE WHEN h.p = page THEN h.t ELSE 'UNNAMED' END AS name FROM h WHERE role = 'TEST_ROW'""")
def panel_name_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.named_by_lookback(_roles(spark, sf_dir))


@query(f"""WITH {ASSIGNED}, l AS (SELECT *, CASE WHEN row_no - lag(row_no) OVER (PARTITION BY doc_id ORDER BY row_no) > 5 THEN 1 ELSE 0 END AS n FROM assigned WHERE panel_name IS NULL AND role = 'TEST_ROW'),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY row_no) AS cluster FROM l) SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n_rows, min(row_no) AS first_row FROM c GROUP BY ALL""")
def unknown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.unknown_clusters(_roles(spark, sf_dir))


_SIM = ", ".join(f"coalesce(sum(CAST(role = '{r}' AS INT)) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS a{i}, coalesce(sum(CAST(role = '{r}' AS INT)) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 0) AS b{i}" for i, r in enumerate(("TEST_ROW", "SECTION_PANEL", "COMMENT")))


@query(f"""WITH {ROLES}, s AS (SELECT doc_id, row_no, page, page > coalesce(max(page) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS is_break, {_SIM} FROM roles)
SELECT doc_id, row_no, page, round(1 - CAST(abs(a0 - b0) + abs(a1 - b1) + abs(a2 - b2) AS DOUBLE) / CAST(greatest(a0, b0, 1) + greatest(a1, b1, 1) + greatest(a2, b2, 1) AS DOUBLE), 6) AS similarity FROM s WHERE is_break""")
def break_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.break_similarity(_roles(spark, sf_dir))


@query(f"""WITH {CELLS}, j AS (SELECT v.doc_id, v.line_no, r.text, row_number() OVER (PARTITION BY v.doc_id, v.line_no ORDER BY abs(r.x - v.x), r.line_no) AS k FROM cells v JOIN cells r ON v.doc_id = r.doc_id AND v.page = r.page AND abs(v.y - r.y) <= 7 WHERE v.x = 200 AND regexp_matches(r.text, '^[0-9]+-[0-9]+$'))
SELECT doc_id, line_no, text AS range_text FROM j WHERE k = 1""")
def codes_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.nearest_ranges(synthetic_cells(spark, sf_dir))


@query(f"""WITH {CELLS}, j AS (SELECT n.doc_id, n.line_no, c.text, c.x, c.line_no AS cl FROM cells n LEFT JOIN cells c ON n.doc_id = c.doc_id AND n.page = c.page AND abs(n.y - c.y) <= 7 AND c.x > 60 WHERE n.x = 60)
SELECT doc_id, line_no, first(text ORDER BY abs(x - 200), cl) FILTER (x BETWEEN 150 AND 250) AS unit_text, first(text ORDER BY abs(x - 475), cl) FILTER (x BETWEEN 430 AND 520) AS range_text FROM j GROUP BY doc_id, line_no""")
def column_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.column_repairs(synthetic_cells(spark, sf_dir), (150, 250))


@query(f"""WITH {ROLES}, n AS (SELECT *, lead(page) OVER w AS np, lead(y) OVER w AS ny, lead(text) OVER w AS nt FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY row_no))
SELECT doc_id, row_no, regexp_extract(nt, '^([0-9]+-[0-9]+)', 1) AS range_text FROM n WHERE role = 'TEST_ROW' AND NOT regexp_matches(text, '[0-9]+-[0-9]+') AND np = page AND ny - y < 60 AND regexp_extract(nt, '^([0-9]+-[0-9]+)', 1) <> ''""")
def split_row_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.split_rows(_roles(spark, sf_dir))


@query(f"""WITH {SCORED}, u AS (SELECT doc_id, panel_no, unit, count(*) AS n FROM tests WHERE unit IS NOT NULL GROUP BY ALL), t AS (SELECT doc_id, panel_no, max(n) AS top, CAST(sum(n) AS BIGINT) AS with_units FROM u GROUP BY ALL)
SELECT *, CASE WHEN with_units >= 2 AND top * 2 > with_units THEN 0.1 ELSE 0.0 END::DOUBLE AS boost FROM t""")
def common_unit_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_unit_boost(_tests(spark, sf_dir))


@query()
def compose_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _roles(spark, sf_dir)
    return compose.composed(r.withColumn("unit", rows.coarse_fields(F.col("text"))["unit"]))


@query(f"WITH {PANELS} SELECT doc_id, panel_no, n_tests, round(avg_confidence + 1e-9, 6) AS avg_confidence, continuity, round(coherence + 1e-9, 6) AS coherence, round(score + 1e-9, 6) AS score, reasons, needs_review FROM panels2")
def panel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.panel_scores(_tests(spark, sf_dir))
    return out.withColumns({c: _rounded(c) for c in ("avg_confidence", "coherence", "score")})


@query(f"""WITH {PANELS}, p AS (SELECT doc_id, count(*) AS n_panels, avg(score) AS avg_panel, count(*) FILTER (needs_review) AS in_review, count(*) FILTER (score >= 0.8) AS high, count(*) FILTER (score < 0.5) AS low FROM panels2 GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_tests, avg(confidence) AS mean, median(confidence) AS median, min(confidence) AS min, max(confidence) AS max, stddev_pop(confidence) AS std FROM tests GROUP BY doc_id),
d AS (SELECT *, avg_panel * 0.6::DOUBLE + mean * 0.3::DOUBLE + least(n_panels / 5.0::DOUBLE, 1.0) * 0.1::DOUBLE AS score FROM p JOIN t USING (doc_id))
SELECT doc_id, n_panels, n_tests, in_review, high, low, round(avg_panel + 1e-9, 6) AS avg_panel, round(mean + 1e-9, 6) AS mean, round(median + 1e-9, 6) AS median, round(min + 1e-9, 6) AS min, round(max + 1e-9, 6) AS max, round(std + 1e-9, 5) AS std, round(score + 1e-9, 6) AS score,
 score < 0.75 OR in_review > n_panels * 0.3 OR avg_panel < 0.6 OR low > 0 OR n_tests < 5 AS needs_review FROM d""")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.document_scores(scoring.panel_scores(_tests(spark, sf_dir), with_tests=True))
    return out.withColumns({c: _rounded(c) for c in ("avg_panel", "mean", "median", "min", "max", "score")} | {"std": F.round(F.col("std") + 1e-9, 5)})


@query(f"""WITH {SCORED} SELECT panel_name, unit AS units, count(*) AS n, round(avg(confidence) + 1e-9, 6) AS confidence FROM tests GROUP BY ROLLUP (panel_name, unit)""")
def rollup_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(spark, sf_dir).rollup("panel_name", "units").agg(F.count("*").alias("n"), F.round(F.avg("confidence") + 1e-9, 6).alias("confidence"))


@query(f"""WITH {SCORED} SELECT CASE WHEN confidence >= 0.9 THEN '>0.9' WHEN confidence >= 0.7 THEN '0.7-0.9' WHEN confidence >= 0.5 THEN '0.5-0.7' ELSE '<0.5' END AS band, count(*) AS n FROM tests GROUP BY ALL""")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c >= 0.9, ">0.9").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("<0.5")
    return _tests(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query()
def header_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of like texts in the margins of documents' pages."""
    return layout.clustered_texts(layout.edge_texts(_rows(spark, sf_dir)), 0.85)
