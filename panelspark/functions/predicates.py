"""Predicates and role ladders over a row's text, as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L


def any_of(text: Column, words: list[str]) -> Column:
    """If the text contains any of the words."""
    return reduce(or_, (text.contains(w) for w in words))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t]+"), lambda t: t != "")


def is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def is_probable_row(text: Column) -> Column:
    """A result row: a number soon after a plausible name, and a known unit or a known analyte; no header marks."""
    text = F.trim(text)
    low = F.lower(text)
    ts = tokens(text)
    first = F.get(ts, 0)
    at = F.array_position(F.transform(ts, lambda t: t.rlike("[0-9]")), True)  # from 1; 0 if none
    has_unit = F.exists(ts, lambda t: F.regexp_replace(t, "[^A-Za-z0-9_/^.-]", "").isin(L.MEDICAL_UNITS))
    header = low.rlike("|".join(L.HEADER_MARKS)) | text.rlike("[(][0-9]{3}[)][ ]*[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}")
    many = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) >= 2
    odd_first = F.endswith(first, F.lit(":")) | first.rlike("^[0-9]+$")
    analyte = F.lower(first).rlike("^(glucose|cholesterol|triglyceride|sodium|potassium|chloride|co2|bun|creatinine|hemoglobin|hematocrit|wbc|rbc|platelet|mcv|mch|mchc|tsh|t4|t3|cortisol|insulin|hba1c|psa|cea|alt|ast|alp|ggt|ldh|ck|troponin|bnp|procalcitonin|temperature|weight|height|age|bp|pulse|resp)$")
    with_unit = ~F.lower(first).isin(L.STOP_WORDS) & ~odd_first & (at <= 6)
    without = (at <= 2) & ~odd_first & analyte
    ok = ~header & ~many & (F.size(ts) >= 2) & (at > 0) & F.when(has_unit, with_unit).otherwise(without)
    return F.coalesce(ok, F.lit(False))


def has_units(text: Column) -> Column:
    return any_of(F.lower(text), ["mg/dl", "mmol/l", "g/dl", "iu/l", "u/l", "ng/ml", "pg/ml", "/ul", "%", "fl", "iu/ml"])


def has_range(text: Column) -> Column:
    return text.rlike("[0-9]+([.][0-9]+)?[ ]*[-–][ ]*[0-9]+([.][0-9]+)?")


def is_heuristic_row(text: Column, role: Column) -> Column:
    digit = text.rlike("[0-9]")
    flag = F.upper(text).rlike("(^|[^A-Z0-9_])(H|L|HIGH|LOW|ABN|CRIT|CRITICAL)([^A-Z0-9_]|$)")
    paragraph = (F.size(tokens(text)) >= 12) & ~text.contains("\t") & ~has_units(text) & ~has_range(text)
    return F.coalesce((role != "SECTION_PANEL") & (F.trim(text) != "") & ~paragraph & ((digit & has_units(text)) | has_range(text) | (digit & flag)), F.lit(False))


def role_ladder(text: Column, is_bold: Column, y: Column) -> Column:
    """struct(role, confidence) by the first rule that holds."""
    return ladder_of(F.trim(text), F.lower(F.trim(text)), is_bold, y)


def ladder_of(text: Column, low: Column, is_bold: Column, y: Column) -> Column:
    """role_ladder of a trimmed text and the same in small letters, for callers that have both as columns; cheap tests stand before patterns."""
    rung = lambda role, conf: F.struct(F.lit(role).alias("role"), F.lit(conf).alias("confidence"))
    upper = (text != low) & (text == F.upper(text))
    digit = text.rlike("[0-9]")
    panel = (is_bold | upper) & F.upper(text).rlike("(^|[^A-Z0-9_])(" + L.PANEL_WORDS + ")([^A-Z0-9_]|$)")
    # a number with a unit, or a known analyte with a number somewhere
    rule_row = digit & (any_of(low, L.ANALYTES) | text.rlike(L.VALUE_UNIT))
    out = F.when(panel, rung("SECTION_PANEL", 0.9)).when(rule_row, rung("TEST_ROW", 0.8))
    out = out.when(low.contains("page") & (y > 900), rung("PAGE_HEADER", 0.8)).when(low.contains("page"), rung("PAGE_FOOTER", 0.8))
    for role, words in L.ROLE_RULES:
        out = out.when(any_of(low, words), rung(role, 0.7))
    return out.when((text != "") & ~digit, rung("COMMENT", 0.5)).when(upper & (F.length(text) > 5), rung("SECTION_MISC", 0.6)).otherwise(rung("JUNK", 0.1))


def served_role(role: Column) -> Column:
    """Roles outside the served set become JUNK, or SECTION_MISC if they name a section."""
    return F.when(role.isin(L.SERVED_ROLES), role).when(F.upper(role).contains("SECTION"), "SECTION_MISC").otherwise("JUNK")


def header_score(text: Column, is_bold: Column, y: Column) -> Column:
    """How much a line is a panel's header: lexicon .7, bold .15, top fifth .15."""
    known = F.upper(F.trim(text)).isin(L.PANEL_LEXICON)
    part = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), part(known, 0.7) + part(is_bold, 0.15) + part(y <= 200, 0.15))


def _ladder(rungs: list[tuple[Column, str]], other: str) -> Column:
    out = F.lit(other)
    for test, role in reversed(rungs):
        out = F.when(test, role).otherwise(out)
    return out


def assigned_role(text: Column, is_bold: Column) -> Column:
    """The ladder for poor models: a panel in bold or capitals, a number with a unit, and words of pages, patients and specimens."""
    text, low = F.trim(text), F.lower(F.trim(text))
    return _ladder(
        [
            (text == "", "EMPTY"),
            ((is_bold | is_upper(text)) & text.rlike(L.ASSIGNED_PANELS), "SECTION_PANEL"),
            (text.rlike(L.ASSIGNED_UNITS), "TEST_ROW"),
            (low.contains("page"), "PAGE_HEADER"),
            (any_of(low, ["patient", "name", "dob", "date of birth"]), "HEADER_PATIENT"),
            (any_of(low, ["specimen", "collected", "accession"]), "HEADER_SPECIMEN"),
        ],
        "OTHER",
    )


def simple_role(text: Column) -> Column:
    """The shortest ladder: capitals, and words of results, patients and pages."""
    text, low = F.trim(text), F.lower(F.trim(text))
    words = [(["test", "result", "normal", "high", "low"], "TEST_ROW"), (["patient", "name", "dob", "id"], "PATIENT_INFO"), (["page"], "PAGE_HEADER")]
    return _ladder([(text == "", "EMPTY"), (is_upper(text) & (F.length(text) > 10), "SECTION_PANEL"), *((any_of(low, w), role) for w, role in words)], "OTHER")


def hinted_role(text: Column, hint: Column, tertile: Column) -> Column:
    """The ladder where no model loads: by the third of the page and a hint that a line is a header."""
    low = F.lower(F.trim(text))
    head = hint | (tertile == 2)
    return _ladder(
        [
            (head & any_of(low, ["patient", "name", "dob", "id"]), "HEADER_PATIENT"),
            (head, "SECTION_PANEL"),
            (tertile == 0, "PAGE_FOOTER"),
            (any_of(low, ["test", "result", "value"]), "TEST_ROW"),
            (low.startswith("#") | low.contains("comment"), "COMMENT"),
        ],
        "SECTION_MISC",
    )


def header_hint(text: Column) -> Column:
    return any_of(F.lower(text), L.HEADER_HINTS)


def third_of_page(y: Column) -> Column:
    """0, 1 or 2 by y as a share of the page."""
    return F.when(y <= 0.33, 0).when(y <= 0.67, 1).otherwise(2)
