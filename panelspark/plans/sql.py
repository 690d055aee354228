"""SQL of the shared synthetic views, for DuckDB."""

from panelspark.sources.lines import PANEL_NAMES, TEST_NAMES, TEST_UNITS


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CELLS = f"""
it AS (
  SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, CAST(l_quantity AS INT) AS qty,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS k
  FROM lineitem),
it2 AS (SELECT *, CAST(1 + k // 3 AS INT) AS page, CAST(k % 3 AS INT) AS slot, CAST(100 + k % 3 * 250 AS INT) AS base FROM it),
cl AS (
  SELECT doc_id, page, k, 10 AS y, 50 AS x, 'Page ' || page || ' of report' AS text, false AS is_bold, 8 AS font FROM it2 WHERE slot = 0
  UNION ALL SELECT doc_id, page, k, 40, 50, 'Patient: P' || (doc_id % 1000) || ' DOB: 01/02/1970', false, 10 FROM it2 WHERE slot = 0 AND page = 1
  UNION ALL SELECT doc_id, page, k, base - 40, 50, {_list(PANEL_NAMES)}[p % 5 + 1], p % 5 <> 3, 12 FROM it2 WHERE slot = 0 AND s % 7 <> 0
  UNION ALL SELECT doc_id, page, k, base, 60, {_list(TEST_NAMES)}[p % 8 + 1], false, 10 FROM it2
  UNION ALL SELECT doc_id, page, k, base + p % 4, 200, qty || CASE WHEN s % 6 = 0 THEN '' ELSE ' ' || {_list(TEST_UNITS)}[p % 7 + 1] END, false, 10 FROM it2
  UNION ALL SELECT doc_id, page, k, base + 5 + p % 3, 430, (p % 50) || '-' || (p % 50 + 10 + p % 40), false, 10 FROM it2 WHERE s % 5 <> 0
  UNION ALL SELECT doc_id, page, k, base + 2, 520, CASE WHEN f = 'R' THEN 'H' ELSE 'L' END, false, 10 FROM it2 WHERE f <> 'N'
  UNION ALL SELECT doc_id, page, k, base + 60, 60, 'specimen slightly hemolyzed', false, 10 FROM it2 WHERE p % 9 = 0),
cells AS (SELECT doc_id, page, y, x, text, is_bold, font, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, text, k) AS line_no FROM cl)"""

BINS = (
    CELLS
    + """,
lagged AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, line_no) AS py FROM cells),
bins AS (SELECT *, sum(CASE WHEN py IS NULL OR y - py > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, line_no) AS bin FROM lagged)"""
)

ROWS = (
    BINS
    + """,
merged AS (
  SELECT doc_id, page, bin, string_agg(trim(text), chr(9) ORDER BY x, line_no) AS text, avg(y) AS y, bool_or(is_bold) AS is_bold,
    median(font) AS font, min(x) AS x_left, max(x) AS x_right, count(*) AS n_cells, min(line_no) AS first_line
  FROM bins GROUP BY doc_id, page, bin),
rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, bin) AS row_no FROM merged
  WHERE n_cells >= 2 OR regexp_matches(text, '[0-9]') OR (is_bold AND font >= 11) OR length(text) >= 10)"""
)

_PIECES = [
    ("k % 6 = 0 AND s % 7 <> 0", "-40", 50, 250, "{names}", "'SECTION_PANEL'"),
    ("kind = 0", "0", 60, 300, "name || ' ' || qty || ' ' || unit || ' ' || span || mark", "'TEST_ROW'"),
    ("kind = 1", "0", 60, 100, "name", "'TEST_ROW'"),
    ("kind = 1", "sway", 110, 130, "qty || mark", "'TEST_ROW'"),
    ("kind = 1", "sway", 140, 170, "unit", "side"),
    ("kind = 1", "1", 180, 230, "span", "side"),
    ("kind = 2", "0", 60, 80, "qty", "'TEST_ROW'"),
    ("kind = 2", "2", 90, 120, "unit", "side"),
    ("kind = 2", "sway", 130, 180, "span", "'TEST_ROW'"),
    ("kind = 2", "0", 190, 250, "name", "'TEST_ROW'"),
    ("kind = 2 AND f <> 'N'", "0", 260, 270, "trim(mark)", "side"),
    ("kind = 3", "0", 60, 130, "name || ' ' || qty", "'TEST_ROW'"),
    ("kind = 3", "20", 60, 90, "unit", "'TEST_ROW'"),
    ("kind = 3", "40", 60, 100, "span", "'TEST_ROW'"),
    ("kind = 4", "0", 60, 130, "name || ' ' || qty", "'TEST_ROW'"),
    ("kind = 4", "20 + p % 3 * 25", 60, 140, "unit || ' ' || span", "'TEST_ROW'"),
    ("kind = 5", "0", 60, 200, "name || ' screen ' || CASE WHEN s % 2 = 0 THEN 'NEGATIVE' ELSE 'Positive' END || CASE WHEN p % 2 = 0 THEN ' <5' ELSE '' END", "'TEST_ROW'"),
    ("kind = 6", "0", 60, 100, "name", "'TEST_ROW'"),
    ("kind = 6", "0", 140, 170, "qty", "'TEST_ROW'"),
    ("kind = 7", "0", 60, 130, "name || ' ' || qty", "'TEST_ROW'"),
    ("kind = 7", "p % 5", 365, 395, "unit", "'COMMENT'"),
    ("kind = 7", "1", 460, 500, "span", "'COMMENT'"),
    ("kind = 8", "0", 60, 130, "name || ' ' || qty", "'TEST_ROW'"),
    ("kind = 8", "20", 60, 130, "'x ' || (p % 50) || ' %'", "'TEST_ROW'"),
    ("kind = 8", "40", 60, 130, "'mg/dL'", "'TEST_ROW'"),
    ("kind = 8", "60", 60, 130, "'ok ' || span", "'TEST_ROW'"),
]
FRAGMENTS = f"""
fi AS (
  SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS k FROM lineitem),
fi2 AS (SELECT *, CAST(1 + k // 6 AS INT) AS page, CAST(90 + k % 6 * 140 AS INT) AS y0, (p + s) % 9 AS kind, {_list(TEST_NAMES)}[p % 8 + 1] AS name, {_list(TEST_UNITS)}[p % 7 + 1] AS unit, (p % 50) || '-' || (p % 50 + 10 + p % 40) AS span,
  CASE f WHEN 'R' THEN ' H' WHEN 'A' THEN ' L' ELSE '' END AS mark, CASE WHEN p % 3 = 0 THEN 'COMMENT' ELSE 'TEST_ROW' END AS side, p % 4 * 2 AS sway FROM fi),
fp AS ({" UNION ALL ".join(f"SELECT doc_id, page, k, CAST(y0 + {dy} AS INT) AS y, {left} AS x_left, {right} AS x_right, {text.format(names=_list(PANEL_NAMES) + '[p % 5 + 1]')} AS text, {role} AS role FROM fi2 WHERE {when}" for when, dy, left, right, text, role in _PIECES)}),
frags AS MATERIALIZED (SELECT doc_id, page, y, x_left, x_right, text, role, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x_left, text, role, k) AS line_no FROM fp)"""
