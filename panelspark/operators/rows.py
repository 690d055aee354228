"""Fields of result rows, their spans and their scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L
from panelspark.functions.text import _group, flag_word, normalize_unit, unit_allowed

VALUE = "([<>=]*[ ]*[0-9]+([.][0-9]+)?)"
RANGE = "([0-9]+([.][0-9]+)?[ ]*[-–][ ]*[0-9]+([.][0-9]+)?)"
_UNIT_TOKEN = "[A-Za-z0-9%/^.]*[A-Za-z%][A-Za-z0-9%/^.]*"
_FLAG_TOKEN = "(?:HIGH|LOW|H|L|ABN|ABNORMAL|CRIT|CRITICAL|ALERT)"
#: name, value, flag, unit and range of a well-formed row.
PRIMARY = f"(?i)^[ ]*(.+?)[ ]+([<>]?[0-9]+(?:[.][0-9]+)?)(?:[ ]+({_FLAG_TOKEN}))?(?:[ ]+({_UNIT_TOKEN}))?(?:[ ]+([0-9]+(?:[.][0-9]+)?[ ]*-[ ]*[0-9]+(?:[.][0-9]+)?))?(?:[ ]+.*)?$"


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once a row however often it is used: it is a lambda's variable."""
    return F.get(F.transform(F.array(value), use), 0)


def coarse_fields(text: Column) -> Column:
    """struct(test_name, result_value, unit, reference_range, n_flags): the first number splits the row, a unit may follow within 20 characters."""
    return once(F.trim(text), lambda t: once(_group(t, VALUE, 1), lambda v: _around_value(t, v)))


def _around_value(text: Column, value: Column) -> Column:
    def fields(at: Column) -> Column:
        name = F.nullif(F.trim(F.substring(text, F.lit(1), at - 1)), F.lit(""))
        after = F.substring(text, at + F.length(value), F.lit(20))
        unit = _group(after, L.UNIT_AFTER_VALUE, 1)
        flags = F.size(F.filter(F.split(text, "[ \t]+"), lambda t: F.upper(t).isin("HIGH", "LOW", "H", "L", "↑", "↓")))
        only = lambda c: F.when(value.isNotNull(), c)
        return F.struct(only(name).alias("test_name"), F.trim(value).alias("result_value"), only(unit).alias("unit"), only(F.trim(_group(text, RANGE, 1))).alias("reference_range"), F.coalesce(only(flags), F.lit(0)).cast("long").alias("n_flags"))

    return once(F.instr(text, value), fields)


def parse_row(text: Column) -> Column:
    """struct(test_name, result_value, units, reference_range, flag, warning) by the primary pattern; a flag read as unit is moved.

    The pattern spans the row, so one replacement by its groups gives all of them.
    """
    mark = "\x01"
    groups = F.split(F.regexp_replace(text, PRIMARY, mark.join(["", *(f"${i}" for i in range(1, 6))])), mark)
    return once(groups, _parsed)


def _parsed(groups: Column) -> Column:
    g = lambda n: F.nullif(F.trim(F.get(groups, n)), F.lit(""))
    unit_is_flag = F.upper(g(4)).rlike(f"^{_FLAG_TOKEN}$") & g(3).isNull()
    flag = flag_word(F.coalesce(g(3), F.when(unit_is_flag, g(4))))
    raw = F.when(F.coalesce(unit_is_flag, F.lit(False)), F.lit(None)).otherwise(g(4))
    unit = normalize_unit(raw)
    warning = F.when(unit != raw, F.lit("unit_coerced")).when(~unit_allowed(g(1), unit), F.lit("unit_unlikely_for_test"))
    return F.struct(g(1).alias("test_name"), g(2).alias("result_value"), unit.alias("units"), F.replace(g(5), F.lit(" "), F.lit("")).alias("reference_range"), flag.alias("flag"), warning.alias("warning"))


# Fixed values.
METHODS = ["(?i)(?:Method|Methodology)[ \t:]*([^,\n]+)", "(?i)(?:^|[^A-Za-z0-9_])(Immunoassay|LC/MS-MS|LC-MS|HPLC|RIA|ELISA|PCR|Flow Cytometry|Microscopy)(?:[^A-Za-z0-9_]|$)"]
CLOCK = ["(?i)(?:^|[^A-Za-z0-9_])([0-9]{1,2}:[0-9]{2}[ \t]*(?:AM|PM))(?:[^A-Za-z0-9_]|$)", "(?:^|[^A-Za-z0-9_])([0-9]{1,2}:[0-9]{2})(?:[^A-Za-z0-9_]|$)"]


def row_extras(text: Column, *fields: Column) -> Column:
    """struct(methodology, observed_at, comments): the latter is what is left of the text without its fields, if it is more than a few characters or a number."""
    rest = text
    for f in fields:
        rest = F.trim(F.when(F.nullif(f, F.lit("")).isNotNull(), F.replace(rest, f, F.lit(""))).otherwise(rest))
    rest = F.trim(F.regexp_replace(rest, "[^A-Za-z0-9_ \t\n]", " "))
    says = (F.length(rest) > 5) & ~rest.rlike("^[0-9]+[.]?[0-9]*$")
    return F.struct(F.trim(F.coalesce(*(_group(text, p, 1) for p in METHODS))).alias("methodology"), F.coalesce(*(_group(text, p, 1) for p in CLOCK)).alias("observed_at"), F.when(says, rest).alias("comments"))


def lexicon_confidence(base: Column, lexicon: Column, in_context: Column) -> Column:
    """Three fifths of a pattern's confidence and two of the word lists', less a fifth where the line's role doesn't fit; between 0 and 1."""
    mixed = base * 0.6 + lexicon * 0.4
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(in_context, mixed).otherwise(mixed * 0.8)))


def value_score(v: Column) -> Column:
    v = F.trim(v)
    n = "[0-9]+[.]?[0-9]*"
    out = F.when(v.isNull() | (v == ""), 0.0).when(v.rlike("^[0-9]+([.][0-9]+)?$"), 1.0).when(v.rlike(f"^{n}[eE][+-]?[0-9]+$") | v.rlike(f"^{n}[ ]*-[ ]*{n}$"), 0.9).when(v.rlike(f"^[<>~]?[ ]*{n}$"), 0.8)
    for word, score in (("NEGATIVE", 0.9), ("POSITIVE", 0.9), ("NORMAL", 0.8), ("HIGH", 0.7), ("LOW", 0.7), ("CRITICAL", 0.7), ("DETECTED", 0.6)):
        out = out.when(F.upper(v).contains(word), score)
    return out.when(v.rlike("[0-9]"), 0.4).otherwise(0.1)


def unit_score(u: Column) -> Column:
    u = F.trim(u)
    lower = [x.lower() for x in L.SCORED_UNITS]
    return F.when(u.isNull() | (u == ""), 0.0).when(u.isin(L.SCORED_UNITS), 1.0).when(F.lower(u).isin(lower), 0.9).when(u.rlike("^[a-zA-Z]+/[a-zA-Z]+$"), 0.6).when(u.rlike("^[a-zA-Z%]+$"), 0.4).when(u.rlike("[0-9]"), 0.3).otherwise(0.1)


def range_score(r: Column) -> Column:
    r = F.trim(r)
    n = "[0-9]+[.]?[0-9]*"
    out = F.when(r.isNull() | (r == ""), 0.0).when(r.rlike(f"^{n}[ ]*-[ ]*{n}$"), 1.0).when(r.rlike(f"^[<>][ ]*{n}$"), 0.9)
    out = out.when(F.upper(r).isin("NORMAL", "ABNORMAL", "POSITIVE", "NEGATIVE"), 0.8).when(F.upper(r).isin("HIGH", "LOW", "CRITICAL", "BORDERLINE"), 0.7)
    out = out.when(r.rlike(f"{n}[ ]*-[ ]*{n}"), 0.8).when(r.rlike(f"[<>][ ]*{n}"), 0.7).when(r.rlike("[0-9]"), 0.5)
    return out.when(F.lower(r).rlike("normal|high|low|positive|negative|detected"), 0.4).otherwise(0.1)


def name_score(t: Column) -> Column:
    """Length (20 characters are best) times clarity: medical words, no odd signs, first letter upper but not all."""
    t = F.trim(t)
    size = F.least(F.length(t) / 20.0, F.lit(1.0)) * F.when(F.length(t) < 3, 0.5).otherwise(1.0)
    terms = reduce(add, (F.when(F.lower(t).contains(m), 1).otherwise(0) for m in L.MEDICAL_TERMS))
    upper = (t == F.upper(t)) & (t != F.lower(t))
    quality = 0.5 + F.least(terms * 0.1, F.lit(0.3)) - F.when(t.rlike("[^A-Za-z0-9_ /()-]"), 0.1).otherwise(0.0) - F.when(upper & (F.length(t) > 10), 0.05).otherwise(0.0)
    quality = quality - F.when(t.rlike("[0-9]{3,}"), 0.1).otherwise(0.0) + F.when(t.rlike("^[A-Z]") & ~upper, 0.05).otherwise(0.0)
    return F.when(t.isNull() | (t == ""), 0.0).otherwise(F.least(size * quality, F.lit(1.0)))


def row_confidence(value: Column, unit: Column, range_: Column, name: Column, classifier: Column) -> Column:
    w = L.ROW_WEIGHTS
    return F.least(F.lit(1.0), value * w["value"] + unit * w["unit"] + range_ * w["range"] + name * w["name"] + F.coalesce(classifier, F.lit(0.5)) * w["classifier"])


def tagged_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of rows (doc_id, row_no, text) with their tags: name words first, then value, unit, range and flag."""
    toks = rows.select("doc_id", "row_no", F.posexplode(F.filter(F.split("text", "[ \t]+"), lambda t: t != "")).alias("pos", "token"))
    kind = F.when(F.col("token").rlike("^[0-9]+([.][0-9]+)?-[0-9]+([.][0-9]+)?$"), "RANGE").when(F.col("token").rlike("^[<>]?[0-9]+([.][0-9]+)?$"), "VALUE")
    kind = kind.when(F.col("token").isin("H", "L"), "FLAG").when(F.col("token").isin(L.MEDICAL_UNITS), "UNIT").otherwise("NAME")
    toks = toks.withColumn("kind", kind)
    begins = F.lag("kind").over(W.partitionBy("doc_id", "row_no").orderBy("pos")).eqNullSafe(F.col("kind"))
    return toks.select("doc_id", "row_no", F.col("pos").cast("long").alias("pos"), "token", F.concat(F.when(begins, "I-").otherwise("B-"), "kind").alias("tag"))


def spans(tokens: DataFrame) -> DataFrame:
    """Runs of tags: a B begins one, and so does an I of another label."""
    w = W.partitionBy("doc_id", "row_no").orderBy("pos")
    label = F.substring("tag", 3, 100)
    new = F.col("tag").startswith("B-") | ~F.lag(label).over(w).eqNullSafe(label)
    runs = tokens.withColumn("label", label).withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("span", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return runs.groupBy("doc_id", "row_no", "span", "label").agg(text.alias("text"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def longest_spans(found: DataFrame) -> DataFrame:
    """Per label the longest span, the earliest of equals."""
    return found.groupBy("doc_id", "row_no", "label").agg(F.max_by("text", F.struct(F.length("text"), -F.col("start"))).alias("text"))


def context(tokens: DataFrame) -> DataFrame:
    """Neighbouring tokens, with marks at the ends of a row."""
    w = W.partitionBy("doc_id", "row_no").orderBy("pos")
    return tokens.select("doc_id", "row_no", "pos", "token", F.lag("token", 1, "BOS").over(w).alias("before"), F.lead("token", 1, "EOS").over(w).alias("after"))
