"""Queries over header lines made from orders: facts of lines, of documents, and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L
from panelspark.operators import header_bank as H
from panelspark.operators import stages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _choice(values: list[str], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


# The lines' texts, in SQL that both engines read.
_FIRST = _choice(["John", "Zelda", "Mary", "Sarah Jane", "Mike", "Ravi"], "o_custkey")
_LAST = _choice(["Smith", "O''Neil".replace("''", "'"), "De La Cruz", "Nguyen-Le", "Xu"], "(o_custkey + o_orderkey)")
_KEY, _Y = "CAST(o_orderkey AS STRING)", "CAST(year(o_orderdate) AS STRING)"
_M, _D = "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
_MM, _DD, _YY = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')", f"substring({_Y}, 3, 2)"
_PATIENT = [
    f"'Patient: ' || {_LAST} || ', ' || {_FIRST} || ' (Male)'", f"'Patient Name: ' || {_FIRST} || ' ' || {_LAST} || ' Female'", f"'Mr. ' || {_LAST} || ', ' || {_FIRST}", f"upper({_LAST}) || ', ' || upper({_FIRST}) || ' F'", f"'Name : ' || {_LAST} || ',  ' || {_FIRST} || ' Jr. Sex: woman'",
    "'Sex: M'", "'MRN 12345 adult'", "'Patient name, hospital name'", f"lower({_FIRST}) || '  ' || lower({_LAST}) || ' jr'", "'  '", f"'Gender: x ' || {_LAST} || ',' || {_FIRST}",
]
_SPECIMEN = [
    f"'Collected: ' || {_MM} || '/' || {_DD} || '/' || {_Y} || ' Received: ' || {_M} || '-' || {_D} || '-' || {_YY} || ' 10:30 AM'", f"'Specimen Number: LAB' || {_KEY}", f"'Accession: ACC-' || {_KEY} || ' Collection Date: ' || {_Y} || '-' || {_MM} || '-' || {_DD}",
    f"'Specimen ID: S' || CAST(o_orderkey % 1000 AS STRING) || ' Entered: ' || {_Y} || '-' || {_M} || '-' || {_D} || ' Reported: ' || {_DD} || '/' || {_MM} || '/' || {_Y}", f"'reported on: ' || {_M} || '.' || {_D} || '.' || {_YY} || '  blood tube'", f"'A_' || lpad({_KEY}, 9, '0')", "'Collected: 99/99/2024'", "'Sample No: x'",
    f"'received: ' || {_D} || '-' || {_M} || '-' || {_Y} || ' at noon collected on: ' || {_MM} || '/' || {_DD} || '/' || {_YY}", "'accession: TEST'", f"'Lab #: ' || {_KEY} || {_KEY} || ' urine'",
]


def _case(texts: list[str], key: str) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


_LINES = [
    ("1", "'HEADER_PATIENT'", _case(_PATIENT, "o_custkey"), "true"),
    ("2", "'HEADER_SPECIMEN'", _case(_SPECIMEN, "o_orderkey"), "true"),
    ("3", "'COMMENT'", "'Patient: Nobody, At All'", "o_orderkey % 5 = 0"),
    ("4", "'HEADER_PATIENT'", _case(_PATIENT, "(o_custkey + o_orderkey)"), "o_orderkey % 2 = 0"),
    ("5", "'HEADER_SPECIMEN'", _case(_SPECIMEN, "(o_custkey + o_orderkey)"), "o_orderkey % 3 = 0"),
]


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, out = spark.read.parquet(f"{sf_dir}/orders.parquet"), None
    for line, role, text, when in _LINES:
        some = orders.where(when).selectExpr("o_orderkey AS doc_id", f"CAST({line} AS BIGINT) AS line_no", f"{role} AS role", f"{text} AS text")
        out = some if out is None else out.unionByName(some)
    return out


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return ", ".join(map(_q, words))


def _any(text: str, words: list[str]) -> str:
    return f"len(list_filter([{_in(words)}], lambda w: contains(lower({text}), w))) > 0"


def _titled(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _first(patterns: list[str], sure: tuple[float, float], table: str, clean: str, valid: str) -> str:
    """A row a line: the first pattern with a valid match, its value and confidence."""
    each = " UNION ALL ".join(f"SELECT doc_id, line_no, {i} AS rank, regexp_matches(t, {_q('(?i)' + p)}) AS hit, regexp_extract(t, {_q('(?i)' + p)}, 1) AS raw FROM {table}" for i, p in enumerate(patterns))
    ranks = " ".join(f"WHEN {i} THEN {max(sure[0] - i * 0.1, sure[1])!r}::DOUBLE" for i in range(len(patterns)))
    return f"(SELECT doc_id, line_no, value, CASE rank {ranks} END AS sure FROM (SELECT *, {clean} AS value FROM (SELECT *, {_strip("regexp_replace(raw, '\\s+', ' ', 'g')")} AS one FROM ({each}) WHERE hit)) WHERE {valid} QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY rank) = 1)"


_CLEAN = f"CASE WHEN len(string_split(one, ',')) = 2 THEN {_titled("trim(string_split(one, ',')[1])")} || ', ' || {_titled("trim(string_split(one, ',')[2])")} ELSE {_titled('one')} END"
_DAY = "lpad({0}, 4, '0') || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0')"


def _date(s: str) -> str:
    """Of the thirteen forms those that the patterns can find: numbers only."""
    out = []
    part = _strip(f"regexp_replace({_strip(s)}, {_q(H.CLOCK_TAIL)}, '', 'g')")
    for sep, order in (("/", "mdY"), ("/", "mdy"), ("-", "mdY"), ("-", "mdy"), ("-", "Ymd"), ("/", "dmY"), ("/", "dmy"), ("[.]", "mdY"), ("[.]", "mdy")):
        pattern = "^" + sep.join({"Y": "([0-9]{4})", "y": "([0-9]{2})"}.get(x, "([0-9]{1,2})") for x in order) + "$"
        g = {x.lower(): f"regexp_extract({part}, '{pattern}', {i})" for i, x in enumerate(order, 1)}
        year = g["y"] if "Y" in order else f"(CASE WHEN {g['y']} >= '69' THEN '19' ELSE '20' END || {g['y']})"
        out.append(f"CASE WHEN regexp_matches({part}, '{pattern}') THEN TRY_CAST({_DAY.format(year, g['m'], g['d'])} AS DATE) END")
    a, b, y = (f"regexp_extract({s}, {_q(H.LOOSE_DATE)}, {i})" for i in (1, 2, 3))
    n = f"TRY_CAST({y} AS INT)"
    year = f"CAST(CASE WHEN {n} < 50 THEN {n} + 2000 WHEN {n} < 100 THEN {n} + 1900 WHEN {n} >= 1000 THEN {n} END AS VARCHAR)"
    out += [f"TRY_CAST({_DAY.format(year, x, z)} AS DATE)" for x, z in ((a, b), (b, a))]
    return "CAST(coalesce(" + ", ".join(out) + ") AS VARCHAR)"


_RAW = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, CAST({line} AS BIGINT) AS line_no, {role} AS role, {text} AS text FROM orders WHERE {when}" for line, role, text, when in _LINES)
_FOUND = " UNION ALL ".join(f"SELECT doc_id, line_no, {i} AS rank, 'date_{kind}' AS field, unnest(regexp_extract_all(t, {_q('(?i)' + p)}, 1)) AS s, unnest(range(len(regexp_extract_all(t, {_q('(?i)' + p)}, 1)))) AS nth FROM sp" for i, (p, kind) in enumerate(H.DATE_PATTERNS))
_NAME_PARTS = "string_split(patient_name, ',')"
FACTS = f"""
hl AS MATERIALIZED (SELECT doc_id, line_no, role, {_strip("text")} AS t FROM ({_RAW}) WHERE role IN ('HEADER_PATIENT', 'HEADER_SPECIMEN') AND {_strip("text")} <> ''),
pt AS (SELECT * FROM hl WHERE role = 'HEADER_PATIENT'), sp AS (SELECT * FROM hl WHERE role = 'HEADER_SPECIMEN'),
nm AS {_first(H.NAME_PATTERNS, H.NAME_SURE, "pt", _CLEAN, f"length(value) BETWEEN 2 AND 100 AND regexp_matches(value, '[A-Za-z]') AND trim(lower(value), ',') NOT IN ({_in(L.NO_NAMES)})")},
sx AS {_first(H.SEX_PATTERNS, H.SEX_SURE, "pt", "CASE WHEN lower(raw) IN ('male', 'm', 'man') THEN 'M' WHEN lower(raw) IN ('female', 'f', 'woman') THEN 'F' END", "true")},
nr AS {_first(H.NUMBER_PATTERNS, H.NUMBER_SURE, "sp", "raw", f"length(value) BETWEEN 3 AND 50 AND lower(value) NOT IN ({_in(L.NO_NUMBERS)})")},
dt AS MATERIALIZED (SELECT * FROM (SELECT doc_id, line_no, rank, nth, field, {_date("s")} AS day FROM ({_FOUND})) WHERE day IS NOT NULL),
dd AS (SELECT doc_id, line_no, count(*) AS n, {", ".join(f"arg_max(day, rank * 1000 + nth) FILTER (field = '{d}') AS {d}" for d in H.DATES)} FROM dt GROUP BY ALL),
f0 AS (SELECT hl.*, nm.value AS patient_name, sx.value AS sex, nr.value AS specimen_number, {", ".join(H.DATES)}, coalesce(nm.sure, 0) + coalesce(sx.sure, 0) + coalesce(nr.sure, 0) + coalesce(n, 0) * 0.8::DOUBLE AS total
  FROM hl LEFT JOIN nm USING (doc_id, line_no) LEFT JOIN sx USING (doc_id, line_no) LEFT JOIN nr USING (doc_id, line_no) LEFT JOIN dd USING (doc_id, line_no)),
f1 AS (SELECT *, least(total, 1.0::DOUBLE) AS base FROM f0 WHERE coalesce({", ".join(H.FIELDS)}) IS NOT NULL),
f2 AS (SELECT *,
  CASE WHEN len({_NAME_PARTS}) > 1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN len({_NAME_PARTS}) = 2 AND regexp_extract(lower({_NAME_PARTS}[2]), '[^ ]+', 0) IN ({_in(L.FIRST_NAMES)}) THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len({_NAME_PARTS}) = 2 AND length(trim({_NAME_PARTS}[1])) BETWEEN 2 AND 20 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(lower(patient_name), '^(mr|ms|mrs|dr|prof)[.]?[ ]+') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(string_split(lower(patient_name), ' '), lambda w: rtrim(w, '.') IN ({_in(L.NAME_SUFFIXES)}))) > 0 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(lower(patient_name), {_q("|".join(L.NAME_LABELS))}) THEN 0.5::DOUBLE ELSE 0 END AS by_name,
  least(0.5::DOUBLE + CASE WHEN {_any("specimen_number", L.NUMBER_PREFIXES)} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(specimen_number, '^[A-Za-z]{{2,6}}[0-9]{{4,12}}$') THEN 0.2::DOUBLE WHEN regexp_matches(specimen_number, '^[0-9]{{6,15}}$') THEN 0.1::DOUBLE WHEN regexp_matches(specimen_number, '^[A-Za-z0-9_-]{{8,20}}$') THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN length(specimen_number) < 4 THEN -0.2::DOUBLE WHEN length(specimen_number) > 25 THEN -0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS by_number, coalesce({", ".join(H.DATES)}) IS NOT NULL AS dated FROM f1),
f3 AS (SELECT *, CASE WHEN role = 'HEADER_PATIENT' THEN CASE WHEN patient_name IS NOT NULL THEN greatest(0, least(base + by_name, 1.0::DOUBLE)) END WHEN specimen_number IS NOT NULL THEN least(base * 0.6::DOUBLE + by_number * 0.4::DOUBLE, 1.0::DOUBLE) END AS listed,
  CASE WHEN role = 'HEADER_PATIENT' THEN {_any("t", L.PATIENT_WORDS)} ELSE {_any("t", L.SPECIMEN_WORDS)} END AS fits, CASE WHEN role = 'HEADER_PATIENT' THEN 'name' ELSE 'specimen' END AS what FROM f2),
f4 AS (SELECT *, greatest(base, coalesce(listed, base)) * CASE WHEN fits THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS lexicon FROM f3),
facts AS MATERIALIZED (SELECT doc_id, line_no, CASE WHEN role = 'HEADER_PATIENT' THEN 'patient' ELSE 'specimen' END AS kind, t AS raw_text, {", ".join(H.FIELDS)}, base AS confidence, lexicon AS lexicon_confidence, base * 0.6::DOUBLE + lexicon * 0.4::DOUBLE AS final_confidence,
  concat_ws(',', CASE WHEN listed > base THEN 'lexicon_enhanced_' || what WHEN listed < base THEN 'lexicon_warning_' || what END, CASE WHEN dated AND ({_any("t", L.TIME_WORDS)} OR regexp_matches(t, '[0-9]{{1,2}}:[0-9]{{2}}')) THEN 'has_time_component' END, CASE WHEN dated AND NOT {_any("t", L.DATE_WORDS)} THEN 'weak_date_context' END, CASE WHEN NOT fits THEN 'context_mismatch' END) AS flags FROM f4)"""


def _six(name: str):
    return F.round(F.col(name) + 1e-9, 6).alias(name)


@query(f"WITH {FACTS} SELECT doc_id, line_no, kind, {', '.join(H.FIELDS)}, round(confidence + 1e-9, 6) AS confidence, round(lexicon_confidence + 1e-9, 6) AS lexicon_confidence, round(final_confidence + 1e-9, 6) AS final_confidence, flags FROM facts")
def header_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and word lists on every header line."""
    return H.line_facts(header_lines(spark, sf_dir)).select("doc_id", "line_no", "kind", *H.FIELDS, _six("confidence"), _six("lexicon_confidence"), _six("final_confidence"), "flags")


def _best(f: str) -> str:
    return f"arg_max({f}, round(confidence * 1000000) * 100 - line_no) FILTER ({f} IS NOT NULL) AS {f}, max(confidence) FILTER ({f} IS NOT NULL) AS sure_{f}"


@query(f"""WITH {FACTS}, b AS (SELECT doc_id, {", ".join(map(_best, H.FIELDS))} FROM facts GROUP BY doc_id)
SELECT doc_id, {", ".join(H.FIELDS)}, round((coalesce(sure_patient_name, 0) + coalesce(sure_sex, 0)) / 2 + 1e-9, 6) AS patient_confidence, round(coalesce(list_sum([{", ".join("sure_" + f for f in H.FIELDS[2:])}]), 0) / greatest(list_count([{", ".join("sure_" + f for f in H.FIELDS[2:])}]), 1) + 1e-9, 6) AS specimen_confidence FROM b""")
def header_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.document_facts(H.line_facts(header_lines(spark, sf_dir)))
    return found.select("doc_id", *H.FIELDS, _six("patient_confidence"), _six("specimen_confidence"))


@query(f"""WITH {FACTS}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (final_confidence >= 0.8) AS high, count(*) FILTER (final_confidence >= 0.6 AND final_confidence < 0.8) AS medium, count(*) FILTER (final_confidence < 0.6) AS low, count(*) FILTER (contains(flags, 'warning')) AS warnings FROM facts GROUP BY doc_id),
s AS (SELECT *, (high / n) * 1.0::DOUBLE + (medium / n) * 0.6::DOUBLE + (low / n) * 0.2::DOUBLE AS score FROM n)
SELECT doc_id, high, medium, low, warnings, round(score + 1e-9, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS quality, concat_ws('; ', CASE WHEN low / n > 0.3 THEN 'many lines of low confidence' END, CASE WHEN warnings > n * 0.2::DOUBLE THEN 'many warnings' END) AS advice FROM s""")
def header_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fact_quality(H.line_facts(header_lines(spark, sf_dir))).withColumn("score", _six("score"))


@query(f"""WITH {FACTS}, c AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER (role LIKE 'HEADER\\_%' ESCAPE '\\') AS header_lines, count(*) FILTER (role = 'TEST_ROW') AS row_lines FROM ({_RAW}) GROUP BY doc_id),
p AS (SELECT * FROM facts WHERE kind = 'patient' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY final_confidence DESC, line_no) = 1), s AS (SELECT * FROM facts WHERE kind = 'specimen' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY final_confidence DESC, line_no) = 1)
SELECT c.doc_id, total_lines, header_lines, row_lines, p.patient_name, p.sex, round(p.final_confidence + 1e-9, 6) AS patient_confidence, s.specimen_number, {", ".join("s." + d for d in H.DATES)}, round(s.final_confidence + 1e-9, 6) AS specimen_confidence FROM c LEFT JOIN p ON p.doc_id = c.doc_id LEFT JOIN s ON s.doc_id = c.doc_id""")
def training_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stages.training_documents(header_lines(spark, sf_dir))
    return found.withColumns({"patient_confidence": _six("patient_confidence"), "specimen_confidence": _six("specimen_confidence")})
