"""Patients and specimens read from header lines by a bank of patterns, weighed by word lists, and put together by document.

lines: doc_id, line_no, role, text. Each pattern of a field has its place in the bank, and the earlier it is the surer its value. A line's
confidence is the sum of its fields', at most 1; word lists raise or question it, and a line that doesn't speak of its subject loses
a fifth of what they give. Everything is Column functions and aggregates by document.

Where the surveyed library fails (a comma with nothing behind it, a year of three digits), the word lists say nothing and the date is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L
from panelspark.operators.stitch import settled

# Fixed values.
NAME_PATTERNS = [
    r"(?:patient|name)\s*:\s*([A-Za-z\-\'\s]+,\s*[A-Za-z\-\'\s]+)",
    r"patient\s+name\s*:\s*([A-Za-z\-\'\s]+)",
    r"^([A-Za-z\-\'\s]+,\s*[A-Za-z\-\'\s]+)",
    r"^([A-Z][a-z]+\s+[A-Z][a-z\-\']+(?:\s+[A-Z][a-z\-\']+)?)",
    r"(?:mr|ms|mrs|dr|prof)\.?\s+([A-Za-z\-\'\s]+,\s*[A-Za-z\-\'\s]+)",
]
SEX_PATTERNS = [
    r"(?:sex|gender)\s*:\s*(male|female|m|f|man|woman)",
    r"\(\s*(male|female|m|f)\s*\)",
    r"[A-Za-z\-\'\s]+,\s*[A-Za-z\-\'\s]+\s+(male|female|m|f)",
    r"\b(male|female|m|f)\b(?:\s|$)",
]
NUMBER_PATTERNS = [
    r"specimen\s*(?:number|#|no\.?|id)\s*:\s*([A-Za-z0-9\-_]+)",
    r"accession\s*(?:number|#|no\.?|id)?\s*:\s*([A-Za-z0-9\-_]+)",
    r"lab\s*(?:number|#|no\.?|id)\s*:\s*([A-Za-z0-9\-_]+)",
    r"sample\s*(?:number|#|no\.?|id)\s*:\s*([A-Za-z0-9\-_]+)",
    r"^\s*([A-Za-z0-9\-_]{6,})\s*$",
]
DATE_PATTERNS = [
    (r"collected\s*(?:date|on)?\s*:\s*([0-9\/\-\.\s]+)", "collected"),
    (r"collection\s*(?:date|on)?\s*:\s*([0-9\/\-\.\s]+)", "collected"),
    (r"received\s*(?:date|on)?\s*:\s*([0-9\/\-\.\s]+)", "received"),
    (r"entered\s*(?:date|on)?\s*:\s*([0-9\/\-\.\s]+)", "entered"),
    (r"reported\s*(?:date|on)?\s*:\s*([0-9\/\-\.\s]+)", "reported"),
    (r"collected\s*:\s*([0-9\/\-\.\s]+\s+[0-9:]+\s*(?:AM|PM)?)", "collected"),
    (r"received\s*:\s*([0-9\/\-\.\s]+\s+[0-9:]+\s*(?:AM|PM)?)", "received"),
]
CLOCK_TAIL = r"\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM)?.*"
LOOSE_DATE = r"(\d{1,2})[\/\-\.](\d{1,2})[\/\-\.](\d{2,4})"
NAME_SURE, SEX_SURE, NUMBER_SURE, DATE_SURE = (0.9, 0.5), (0.8, 0.6), (0.9, 0.5), 0.8  # the first pattern's, and the least
HIGH, MEDIUM = 0.8, 0.6

DATES = ("date_collected", "date_received", "date_entered", "date_reported")
FIELDS = ("patient_name", "sex", "specimen_number", *DATES)


def titled(text: Column) -> Column:
    """Every run of letters with its first letter upper and the others lower."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def header_date(text: Column) -> Column:
    """yyyy-mm-dd of a date in one of thirteen forms, without the time behind it, or of numbers like one anywhere in the text; else null."""
    part = _stripped(F.regexp_replace(_stripped(text), CLOCK_TAIL, ""))

    def form(pattern: str, order: str) -> Column:
        g = {name: F.regexp_extract(part, f"^{pattern}$", i) for i, name in enumerate(order, 1)}
        # two-digit years are those from 1969 to 2068
        year = g["Y"] if "Y" in g else F.concat(F.when(g["y"] >= "69", "19").otherwise("20"), g["y"])
        month = g.get("m")
        if month is None:
            names = [(n, i + 1) for i, n in enumerate(L.MONTH_NAMES)]
            table = F.create_map(*[F.lit(x) for n, i in dict((k, i) for n, i in names for k in (n, n[:3])).items() for x in (n, i)])
            month = F.try_element_at(table, F.lower(g["B"])).cast("string")
        return F.when(part.rlike(f"^{pattern}$"), _ymd(year, month, g["d"]))

    d, y4, y2, word = r"(\d{1,2})", r"(\d{4})", r"(\d{2})", "([A-Za-z]+)"
    forms = [form(f"{d}/{d}/{y4}", "mdY"), form(f"{d}/{d}/{y2}", "mdy"), form(f"{d}-{d}-{y4}", "mdY"), form(f"{d}-{d}-{y2}", "mdy"), form(f"{y4}-{d}-{d}", "Ymd"), form(f"{d}/{d}/{y4}", "dmY"), form(f"{d}/{d}/{y2}", "dmy")]
    forms += [form(rf"{d}\.{d}\.{y4}", "mdY"), form(rf"{d}\.{d}\.{y2}", "mdy"), form(rf"{word}\s+{d},\s+{y4}", "BdY"), form(rf"{d}\s+{word}\s+{y4}", "dBY")]
    a, b, c = (F.regexp_extract(text, LOOSE_DATE, i) for i in (1, 2, 3))
    n = c.try_cast("int")
    year = F.when(n < 50, n + 2000).when(n < 100, n + 1900).when(n >= 1000, n).cast("string")
    return F.coalesce(*forms, _ymd(year, a, b), _ymd(year, b, a)).cast("string")


def _ranked(text: Column, patterns: list[str], sure: tuple[float, float], clean, valid) -> Column:
    """struct(value, confidence) by the first pattern whose first match is valid."""
    out = None
    for i, pattern in enumerate(patterns):
        value = clean(F.regexp_extract(text, f"(?i){pattern}", 1))
        hit = text.rlike(f"(?i){pattern}") & valid(value)
        found = F.struct(value.alias("value"), F.lit(max(sure[0] - i * 0.1, sure[1])).alias("confidence"))
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def _clean_name(name: Column) -> Column:
    name = _stripped(F.regexp_replace(name, r"\s+", " "))
    parts = F.split(name, ",")
    return F.when(F.size(parts) == 2, F.concat_ws(", ", titled(F.trim(F.get(parts, F.lit(0)))), titled(F.trim(F.get(parts, F.lit(1)))))).otherwise(titled(name))


def _is_name(name: Column) -> Column:
    return F.length(name).between(2, 100) & name.rlike("[A-Za-z]") & ~F.regexp_replace(F.lower(name), "^,+|,+$", "").isin(L.NO_NAMES)


def _is_number(number: Column) -> Column:
    return F.length(number).between(3, 50) & ~F.lower(number).isin(L.NO_NUMBERS)


def _has(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def name_weight(name: Column) -> Column:
    """What the word lists add to a name's confidence."""
    low, parts = F.lower(name), F.split(name, ",")
    two = F.size(parts) == 2
    first = F.get(F.filter(F.split(F.lower(F.get(parts, F.lit(1))), r"\s+"), lambda w: w != ""), F.lit(0))
    some = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    suffix = F.exists(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, "[.]+$", "").isin(L.NAME_SUFFIXES))
    out = some(F.size(parts) > 1, 0.3) + some(two & first.isin(L.FIRST_NAMES), 0.4) + some(two & F.length(F.trim(F.get(parts, F.lit(0)))).between(2, 20), 0.2)
    return out + some(low.rlike(r"^(mr|ms|mrs|dr|prof)\.?\s+"), 0.2) + some(suffix, 0.1) + some(low.rlike("|".join(L.NAME_LABELS)), -0.5)


def number_weight(number: Column) -> Column:
    """How much a specimen's number looks like one."""
    form = F.when(number.rlike("^[A-Za-z]{2,6}[0-9]{4,12}$"), 0.2).when(number.rlike("^[0-9]{6,15}$"), 0.1).when(number.rlike("^[A-Za-z0-9_-]{8,20}$"), 0.15).otherwise(0.0)
    size = F.when(F.length(number) < 4, -0.2).when(F.length(number) > 25, -0.1).otherwise(0.0)
    return F.least(F.lit(0.5) + F.when(_has(number, L.NUMBER_PREFIXES), 0.2).otherwise(0.0) + form + size, F.lit(1.0))


def line_facts(lines: DataFrame) -> DataFrame:
    """A row a header line that says something: kind, its fields, confidence of the patterns, of the word lists and of both, flags."""
    c = F.col
    out = lines.where(c("role").isin("HEADER_PATIENT", "HEADER_SPECIMEN")).select("doc_id", "line_no", "role", _stripped(F.col("text")).alias("raw_text")).where("raw_text <> ''")
    t, patient = c("raw_text"), c("role") == "HEADER_PATIENT"
    sex_of = lambda s: F.when(F.lower(s).isin("male", "m", "man"), "M").when(F.lower(s).isin("female", "f", "woman"), "F")
    always = lambda _: F.lit(True)

    # a text gives each pattern its matches, and each match that is a date counts; of one kind the last found stands
    def found(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(1)), lambda m: F.struct(F.lit(f"date_{kind}").alias("field"), m.alias("text")))

    matches = F.flatten(F.array(*(found(p, kind) for p, kind in DATE_PATTERNS)))
    out = settled(out, {"_matches": F.when(~patient, matches).otherwise(F.slice(matches, 1, 0))})
    dated = F.transform("_matches", lambda m: F.struct(m["field"].alias("field"), header_date(m["text"]).alias("day")))
    out = settled(
        out,
        {
            "_name": F.when(patient, _ranked(t, NAME_PATTERNS, NAME_SURE, _clean_name, _is_name)),
            "_sex": F.when(patient, _ranked(t, SEX_PATTERNS, SEX_SURE, sex_of, always)),
            "_number": F.when(~patient, _ranked(t, NUMBER_PATTERNS, NUMBER_SURE, lambda x: x, _is_number)),
            "_dates": F.filter(dated, lambda d: d["day"].isNotNull()),
        },
    )
    last = lambda field: F.try_element_at(F.filter("_dates", lambda d: d["field"] == field), F.lit(-1))["day"]
    fields = {"patient_name": c("_name.value"), "sex": c("_sex.value"), "specimen_number": c("_number.value")} | {d: last(d) for d in DATES}
    sure = F.coalesce("_name.confidence", F.lit(0.0)) + F.coalesce("_sex.confidence", F.lit(0.0)) + F.coalesce("_number.confidence", F.lit(0.0))
    sure = F.aggregate("_dates", sure, lambda s, _: s + DATE_SURE)
    out = settled(out, fields | {"confidence": F.least(sure, F.lit(1.0))}).where(F.coalesce(*FIELDS).isNotNull())
    base = c("confidence")
    by_name = F.when(c("patient_name").isNotNull(), F.greatest(F.lit(0.0), F.least(base + name_weight(c("patient_name")), F.lit(1.0))))
    by_number = F.when(c("specimen_number").isNotNull(), F.least(base * 0.6 + number_weight(c("specimen_number")) * 0.4, F.lit(1.0)))
    out = settled(out, {"_by": F.when(patient, by_name).otherwise(by_number), "_fits": F.when(patient, _has(t, L.PATIENT_WORDS)).otherwise(_has(t, L.SPECIMEN_WORDS)), "_dated": F.coalesce(*DATES).isNotNull()})
    what = F.when(patient, "name").otherwise("specimen")
    timed = _has(t, L.TIME_WORDS) | t.rlike("[0-9]{1,2}:[0-9]{2}")
    flags = F.array_compact(F.array(F.when(c("_by") > base, F.concat(F.lit("lexicon_enhanced_"), what)).when(c("_by") < base, F.concat(F.lit("lexicon_warning_"), what)), F.when(c("_dated") & timed, "has_time_component"), F.when(c("_dated") & ~_has(t, L.DATE_WORDS), "weak_date_context"), F.when(~c("_fits"), "context_mismatch")))
    lexicon = F.greatest(base, F.coalesce("_by", base)) * F.when(c("_fits"), 1.0).otherwise(0.8)
    out = settled(out, {"kind": F.when(patient, "patient").otherwise("specimen"), "lexicon_confidence": lexicon, "flags": F.array_join(flags, ",")})
    return out.select("doc_id", "line_no", "kind", "raw_text", *FIELDS, "confidence", "lexicon_confidence", (base * 0.6 + c("lexicon_confidence") * 0.4).alias("final_confidence"), "flags")


def document_facts(facts: DataFrame) -> DataFrame:
    """line_facts() by document: of every field the surest line's value (the first of equals), and how sure the patient's and the specimen's are."""
    c = F.col
    order = F.struct(c("confidence"), -c("line_no"))
    # a person without a name, or without a sex, is half as sure
    best = lambda f: F.max_by(F.struct(c(f).alias("value"), c("confidence").alias("sure")), F.when(c(f).isNotNull(), order))
    one = facts.groupBy("doc_id").agg(*(best(f).alias(f) for f in FIELDS))
    half = lambda f: F.coalesce(c(f"{f}.sure"), F.lit(0.0))
    found = F.array_compact(F.array(*(c(f"{f}.sure") for f in FIELDS[2:])))
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(found), F.lit(1))
    return one.select("doc_id", *(c(f"{f}.value").alias(f) for f in FIELDS), ((half("patient_name") + half("sex")) / 2).alias("patient_confidence"), mean.alias("specimen_confidence"))


def fact_quality(facts: DataFrame) -> DataFrame:
    """line_facts() by document: how many lines are sure, fairly sure and not, a score of these, its word, and what to look at."""
    c, n = F.col, F.count("*")
    many = lambda test: F.count(F.when(test, 1))
    final = c("final_confidence")
    one = facts.groupBy("doc_id").agg(n.alias("n"), many(final >= HIGH).alias("high"), many((final >= MEDIUM) & (final < HIGH)).alias("medium"), many(final < MEDIUM).alias("low"), F.sum(F.size(F.regexp_extract_all("flags", F.lit("(warning)"), F.lit(1)))).alias("warnings"))
    score = (c("high") / c("n")) * 1.0 + (c("medium") / c("n")) * 0.6 + (c("low") / c("n")) * 0.2
    advice = F.concat_ws("; ", F.when(c("low") / c("n") > 0.3, "many lines of low confidence"), F.when(c("warnings") > c("n") * 0.2, "many warnings"))
    return one.withColumn("score", score).select("doc_id", "high", "medium", "low", "warnings", "score", F.when(c("score") >= 0.8, "high").when(c("score") >= 0.6, "medium").otherwise("low").alias("quality"), advice.alias("advice"))
