"""Predicates of single tokens, and tokenisers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L

# Forms of tokens.
DATE_FORMS = "^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})$|(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
TIME_FORM = "(?i)^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?([ ]*(am|pm))?$"
ID_FORMS = "^([A-Z]?[0-9]{6,}[A-Z]?|[0-9]{2}[A-Z][0-9]{7})$"
PHONE_FORMS = "^([(][0-9]{3}[)][ ]*[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}[.][0-9]{3}[.][0-9]{4}|[0-9]{10})$"

_SPACE = "[ \\t\\n\\r\\f\\x0B]+"
_EDGE = "[ \\t.,;:()\\[\\]{}<>+-]+"


def token_kinds(token: Column) -> Column:
    """struct of booleans: what a token looks like."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(token), ":+$", ""), ",+$", "")
    return F.struct(
        token.rlike(DATE_FORMS).alias("is_date"),
        token.rlike(TIME_FORM).alias("is_time"),
        token.rlike(ID_FORMS).alias("is_id"),
        token.rlike(PHONE_FORMS).alias("is_phone"),
        F.lower(token).isin(L.MEDICAL_WORDS).alias("is_medical"),
        bare.isin(L.LABEL_WORDS).alias("is_label"),
    )


def unit_token(token: Column) -> Column:
    """Lower case, without punctuation at the edges; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(token, F.lit("")), f"^{_EDGE}|{_EDGE}$", ""))


def is_unit_like(token: Column) -> Column:
    return unit_token(token).isin(L.KNOWN_UNITS)


def document_tokens(text: Column) -> Column:
    """Tokens between white space, with , : ; ( ) { } as tokens of their own."""
    return F.filter(F.split(F.regexp_replace(text, "([,:;(){}])", " $1 "), _SPACE), lambda t: t != "")


def row_tokens(text: Column) -> Column:
    """Tokens between white space, cut again wherever other characters than letters, digits and _ are."""
    return F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda t: t != "")
