"""SQL for DuckDB of the queries that SQL can express on small tables, written from their contracts."""

from __future__ import annotations

from panelspark.llm.chat import INSTRUCT, Template

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRINGS = f"""
WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, ws[i:i + 12] AS w FROM t, unnest(range(1, len(ws) - 11)) AS r(i)),
first_ AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at_ FROM win JOIN first_ USING (w) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at_, unnest(ws) AS word FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY at_) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, at_) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id"""

DECONTAMINATE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
item_win AS MATERIALIZED (SELECT DISTINCT item, ws[i:i + 12] AS w, least(len(ws), 13) AS n FROM b, unnest(range(1, greatest(len(ws) - 11, 2))) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM item_win),
doc_win AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS w FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS r(i)),
found AS MATERIALIZED (SELECT doc_id, i, doc_win.n, item FROM doc_win JOIN item_win USING (w)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS r(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""


_DRAW = "CAST('0x' || substr(h, {}, 8) AS UBIGINT)"
_JOINED = "array_to_string(u[{}:{}], '')"
INFILL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {", ".join(f"{_DRAW.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce({_JOINED.format("1", "a")}, '') AS prefix, coalesce({_JOINED.format("a + 1", "b")}, '') AS middle, coalesce({_JOINED.format("b + 1", "n")}, '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
m AS (SELECT *, CASE form WHEN 'psm' THEN strpos(output, '<S>') WHEN 'spm' THEN strpos(output, '<P>') END AS second, strpos(output, '<M>') AS third FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, second - 4) || substr(output, third + 3) || substr(output, second + 3, third - second - 3)
    ELSE substr(output, second + 3, third - second - 3) || substr(output, third + 3) || substr(output, 4, second - 4) END) AS restored_sha256 FROM m"""



def _leaf(more: int) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST(n_chars + {more} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in fields) + ")"


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS UBIGINT) for i in range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END))"
MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf(0)} AS leaf, CASE WHEN xor({_CRC}, CAST(4294967295 AS UBIGINT)) % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf(1)} END AS changed FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, n FROM (SELECT lang, count(*) AS n FROM d GROUP BY lang)),
l AS MATERIALIZED (SELECT doc_id, leaf, coalesce(changed, leaf) AS claim, grp, n, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
low AS (SELECT grp, 0 AS level, place, n, leaf AS h FROM l UNION ALL SELECT grp, level + 1, place // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY grp, level, place // 2),
sub AS MATERIALIZED (SELECT grp, h AS subroot FROM low WHERE n = 1),
high AS (SELECT 0 AS level, grp AS place, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub UNION ALL SELECT level + 1, place // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 2),
root AS (SELECT h AS root FROM high WHERE n = 1),
nodes AS MATERIALIZED (SELECT grp, level, place, n, h FROM low UNION ALL SELECT -1, level, place, n, h FROM high),
steps AS MATERIALIZED (
  SELECT doc_id, l.grp, l.place, 0 AS part, level, (l.place >> level) % 2 AS side, o.h FROM l JOIN nodes o ON o.grp = l.grp AND o.n > 1 AND o.place = xor(l.place >> level, 1)
  UNION ALL SELECT doc_id, l.grp, l.place, 1, level, (l.grp >> level) % 2, o.h FROM l JOIN nodes o ON o.grp = -1 AND o.n > 1 AND o.place = xor(l.grp >> level, 1)),
proof AS (SELECT grp, place, string_agg(h, '' ORDER BY part, level) AS proof FROM steps GROUP BY grp, place),
path AS MATERIALIZED (
  SELECT x.grp, x.place, x.part, x.level, row_number() OVER (PARTITION BY x.grp, x.place ORDER BY x.part, x.level) AS step, side, h
  FROM (SELECT l.grp, l.place, CASE WHEN k.grp = -1 THEN 1 ELSE 0 END AS part, k.level FROM l JOIN (SELECT DISTINCT grp, level FROM nodes WHERE n > 1) k ON k.grp = l.grp OR k.grp = -1) x LEFT JOIN steps s ON s.grp = x.grp AND s.place = x.place AND s.part = x.part AND s.level = x.level),
up AS (SELECT grp, place, 0 AS step, claim AS h FROM l UNION ALL SELECT up.grp, up.place, up.step + 1, sha256(CASE WHEN path.h IS NULL THEN up.h WHEN side = 1 THEN path.h || up.h ELSE up.h || path.h END) FROM up JOIN path ON path.grp = up.grp AND path.place = up.place AND path.step = up.step + 1),
folded AS (SELECT grp, place, arg_max(h, step) AS folded FROM up GROUP BY grp, place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN sub USING (grp) CROSS JOIN root JOIN folded USING (grp, place) LEFT JOIN proof USING (grp, place)"""


def chat_format(template: Template = INSTRUCT) -> str:
    """The digest and the formatted length; the latter and the turn order from the template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    escaped = "replace(text, '\\', '\\\\')"
    for c in template.strings():
        escaped = f"replace({escaped}, {quoted(c)}, {quoted(c[0] + chr(92) + '!' + c[1:])})"
    known = " ".join(f"WHEN {quoted(name)} THEN {len(r.opening) + len(r.closing)}" for name, r in template.roles.items())
    other = len(template.other.opening) + len(template.other.closing) + 1
    bears = ", ".join(quoted(name) for name, r in template.roles.items() if r.loss)
    letter = {name: chr(97 + i) for i, name in enumerate(template.roles)}
    moves = "".join(f" UNION ALL SELECT {quoted(a)}, {quoted(letter[r])}, {quoted(b)}" for (a, r), b in template.moves.items()).removeprefix(" UNION ALL ")
    names = " ".join(f"WHEN {quoted(n)} THEN {quoted(x)}" for n, x in letter.items())
    accept = ", ".join(map(quoted, template.accept))
    probe = "'</s>[INST] ok [/INST]'"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {probe} UNION ALL SELECT -7, 1, 'assistant', {probe}),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns, coalesce(string_agg(text, '' {order}) FILTER (role IN ({bears})), '') AS loss,
  CAST(sum(length({escaped}) + CASE role {known} ELSE {other} + length(to_base64(encode(role))) END) AS BIGINT) AS formatted_chars, string_agg(CASE role {names} ELSE '?' END, '' {order}) AS roles FROM r GROUP BY conv_id),
moves AS (SELECT * FROM ({moves}) AS m(state, role, next)),
walk AS (SELECT conv_id, {quoted(template.start)} AS state, 1 AS at_ FROM c UNION ALL SELECT walk.conv_id, moves.next, at_ + 1 FROM walk JOIN c ON walk.conv_id IS NOT DISTINCT FROM c.conv_id JOIN moves ON moves.state = walk.state AND moves.role = substr(c.roles, at_, 1))
SELECT c.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  EXISTS (SELECT 1 FROM walk WHERE walk.conv_id IS NOT DISTINCT FROM c.conv_id AND at_ = c.n_turns + 1 AND walk.state IN ({accept})) AS valid FROM c"""
