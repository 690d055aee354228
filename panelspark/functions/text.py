"""Normalisers and formatters of single values, as Column functions. Null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L


def _group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null without a match or when the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _date(year: Column, month: Column, day: Column) -> Column:
    """An ISO date if the parts are in range; only ranges are checked, so 31 February passes."""
    ok = (year >= 1900) & (year <= 2100) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    return F.when(ok, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), _two(month), F.lit("-"), _two(day)))


def _full_year(year: Column) -> Column:
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def _month(name: Column) -> Column:
    """Number of an English month, written out or as its first three letters (four of September)."""
    names = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    known = {**{m: i for i, m in enumerate(L.MONTHS, 1)}, **{m: i for i, m in enumerate(names, 1)}, "sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(name))


def _time(hour: Column, minute: Column, second: Column) -> Column:
    ok = (hour >= 0) & (hour <= 23) & (minute >= 0) & (minute <= 59) & (second >= 0) & (second <= 59)
    return F.when(ok, F.concat(F.lit("T"), _two(hour), F.lit(":"), _two(minute), F.lit(":"), _two(second)))


def _hour24(hour: Column, half: Column) -> Column:
    pm = F.upper(half) == "PM"
    return F.when(pm & (hour != 12), hour + 12).when(~pm & (hour == 12), F.lit(0)).otherwise(hour)


def normalize_date(s: Column) -> Column:
    """ISO string of the first date form that fits: with a time first, then M/D/Y, D/M/Y, Y-M-D, Month D, Y and D Mon Y."""
    # as a lambda's variable the text is computed once, however many groups are taken from it
    return F.get(F.transform(F.array(F.trim(s)), _iso), 0)


def _iso(s: Column) -> Column:
    sep = "[/.-]"
    g = lambda p, n: _group(s, p, n)
    iso = f"([0-9]{{4}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}})"
    iso_time = iso + "[ ]+([0-9]{1,2}):([0-9]{1,2})(:([0-9]{1,2}))?"
    mdy = f"([0-9]{{1,2}}){sep}([0-9]{{1,2}}){sep}([0-9]{{2,4}})"
    dmy = f"([0-9]{{1,2}}){sep}([0-9]{{1,2}}){sep}([0-9]{{4}})"
    half = "[ ]*([AaPp][Mm])"
    mdy_time = mdy + "[ ]+([0-9]{1,2}):([0-9]{1,2})" + half
    named = "([A-Za-z0-9_]+)[ ]+([0-9]{1,2}),?[ ]+([0-9]{4})"
    named_time = named + "[ ]+(at[ ]+)?([0-9]{1,2}):([0-9]{1,2})" + half
    dmon = "([0-9]{1,2})[/. -]([A-Za-z0-9_]+)[/. -]([0-9]{2,4})"
    i = lambda p, n: _int(g(p, n))
    zero = F.lit(0)
    # groups are taken only from a form that is there
    forms = [
        (iso_time, F.concat(_date(i(iso_time, 1), i(iso_time, 2), i(iso_time, 3)), _time(i(iso_time, 4), i(iso_time, 5), F.coalesce(i(iso_time, 7), zero)))),
        (mdy_time, F.concat(_date(_full_year(i(mdy_time, 3)), i(mdy_time, 1), i(mdy_time, 2)), _time(_hour24(i(mdy_time, 4), g(mdy_time, 6)), i(mdy_time, 5), zero))),
        (named_time, F.concat(_date(i(named_time, 3), _month(g(named_time, 1)), i(named_time, 2)), _time(_hour24(i(named_time, 5), g(named_time, 7)), i(named_time, 6), zero))),
        (mdy, _date(_full_year(i(mdy, 3)), i(mdy, 1), i(mdy, 2))),
        (dmy, F.when(i(dmy, 1) > 12, _date(i(dmy, 3), i(dmy, 2), i(dmy, 1)))),
        (iso, _date(i(iso, 1), i(iso, 2), i(iso, 3))),
        (named, _date(i(named, 3), _month(g(named, 1)), i(named, 2))),
        (dmon, _date(_full_year(i(dmon, 3)), _month(g(dmon, 2)), i(dmon, 1))),
    ]
    return F.coalesce(*(F.when(s.rlike(form), date) for form, date in forms))


def normalize_phone(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    ten = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    return F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))


def parse_range(s: Column) -> Column:
    """struct(text, low, high): a-b, then at least, over, at most, under, then one number for both; malformed numbers fall through."""
    s = F.trim(s)
    num = "([0-9.]+)"
    d = lambda p, n: _group(s, p, n).try_cast("double")
    span = f"{num}[ ]*[-–—][ ]*{num}"
    lo, hi = d(span, 1), d(span, 2)
    both = lo.isNotNull() & hi.isNotNull()
    ge, gt, le, lt, one = d(f"(≥|>=)[ ]*{num}", 2), d(f">[ ]*{num}", 1), d(f"(≤|<=)[ ]*{num}", 2), d(f"<[ ]*{num}", 1), d(f"^[ ]*{num}[ ]*$", 1)
    up, down = F.coalesce(ge, gt), F.coalesce(le, lt)
    low = F.when(both, lo).when(up.isNotNull(), up).when(down.isNull(), one)
    high = F.when(both, hi).when(up.isNotNull(), F.lit(None)).when(down.isNotNull(), down).otherwise(one)
    return F.struct(s.alias("text"), low.alias("low"), high.alias("high"))


def normalize_flag(s: Column) -> Column:
    """H, L, CRIT or ABN; anything else in upper case, cut to ten characters; blank is null."""
    f = F.nullif(F.upper(F.trim(s)), F.lit(""))
    return F.when(f.isin("H", "HIGH", "HI"), "H").when(f.isin("L", "LOW", "LO"), "L").when(f.isin("CRIT", "CRITICAL", "PANIC"), "CRIT").when(f.isin("ABN", "ABNORMAL", "A"), "ABN").otherwise(F.substring(f, 1, 10))


def flag_word(s: Column) -> Column:
    """The row parser's vocabulary."""
    f = F.upper(F.trim(s))
    return F.when(f.isin("HIGH", "H"), "HIGH").when(f.isin("LOW", "L"), "LOW").when(f.isin("ABN", "ABNORMAL"), "ABNORMAL").when(f.isin("CRIT", "CRITICAL"), "CRITICAL").when(f == "ALERT", "ALERT")


def normalize_unit(s: Column) -> Column:
    out = F.trim(s)
    for spelling, unit in L.UNIT_SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(unit))
    return out


def unit_allowed(test: Column, unit: Column) -> Column:
    """False only for a known test with a unit outside its list."""
    name = F.upper(F.trim(test))
    ok = F.lit(True)
    for known, units in L.ALLOWED_UNITS.items():
        ok = F.when(name == known, unit.isin(units)).otherwise(ok)
    return F.coalesce(ok, F.lit(True))


def split_address(s: Column) -> Column:
    """struct(street, city, state, zip) of a one-line block."""
    flat = F.trim(F.regexp_replace(s, "[ \t\r\n]+", " "))
    zip_ = _group(flat, "([0-9]{5}(-[0-9]{4})?)", 1)
    state = _group(flat, "([A-Z]{2})[ ]+[0-9]{5}", 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(flat, "[0-9]{5}(-[0-9]{4})?", ""), "[ ,]+([A-Z]{2})[ ]*$", ""))
    parts = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 2, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", ")).when(n == 1, F.get(parts, 0)).alias("street"),
        F.when(n >= 2, F.element_at(parts, -1)).alias("city"),
        state.alias("state"),
        zip_.alias("zip"),
    )


def clean_title(s: Column) -> Column:
    """A panel's name without its labels; 'Unnamed Panel' if nothing is left."""
    out = F.regexp_replace(F.trim(s), "(?i)^ordered items:[ ]*", "")
    out = F.regexp_replace(out, "(?i)^(section_panel|panel:|section:)[ ]*", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, "(?i)[ ]+(panel|section)$", ""), "[ ]+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Unnamed Panel"))


def result_id(s: Column) -> Column:
    """A document's id without trailing slashes and stage suffixes."""
    return F.regexp_replace(F.regexp_replace(s, "/+$", ""), "([.]0[0-9][a-z]?_[a-z_]+)?([.]debug)?$", "")


def path_segments(s: Column) -> Column:
    """Segments of a dotted path with [n], or of a JSON pointer."""
    return F.filter(F.split(F.regexp_replace(s, "\\[([0-9]+)\\]", ".$1"), "[./]"), lambda x: x != "")


def token_shape(s: Column, length: int = 8) -> Column:
    """A for upper case, a for lower case, 9 for digits, X for the rest."""
    out = F.regexp_replace(F.substring(s, 1, length), "[^A-Za-z0-9]", "_")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return F.replace(out, F.lit("_"), F.lit("X"))


def short_shape(s: Column) -> Column:
    out = token_shape(s, 1_000_000)
    for c in "Aa9X":
        out = F.regexp_replace(out, f"{c}+", c)
    return out


def truncated(s: Column, most: int = 500, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit(mark))).otherwise(s)


def clean_line(s: Column) -> Column:
    """A line without (cid:n) marks."""
    return F.trim(F.regexp_replace(s, "[(]cid:[0-9]+[)]", ""))


def format_range(low: Column, high: Column, unit: Column, text: Column) -> Column:
    """low–high unit, else the text."""
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws(" ", F.concat(low.cast("string"), F.lit("–"), high.cast("string")), F.nullif(unit, F.lit(""))))
    return F.coalesce(span, F.nullif(text, F.lit("")))


def format_percent(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))


def equal_values(a: Column, b: Column) -> Column:
    """Null and the empty string are the same."""
    return F.nullif(a, F.lit("")).eqNullSafe(F.nullif(b, F.lit("")))


def age_bucket(seconds: Column) -> Column:
    n = lambda d: F.floor(seconds / d).cast("string")
    return F.when(seconds >= 86400, F.concat(n(86400), F.lit("d"))).when(seconds >= 3600, F.concat(n(3600), F.lit("h"))).when(seconds >= 60, F.concat(n(60), F.lit("m"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))
