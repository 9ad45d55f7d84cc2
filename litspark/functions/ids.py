"""Identifier and date spellings brought to one form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nct_id(c: Column | str) -> Column:
    """NCT and eight digits, whatever the case and spacing; null where there is no such id."""
    digits = F.regexp_extract(F.upper(_c(c)), r"NCT[^0-9A-Z]*([0-9]{8})(?![0-9])", 1)
    return F.when(digits != "", F.concat(F.lit("NCT"), digits))


def hex_digest(c: Column | str) -> Column:
    """A digest without its algorithm prefix, in lower case, without blanks."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), r"^[a-z0-9-]+:|\s+", "")


def date_digits(c: Column | str) -> Column:
    """The digits of an ISO-like date or timestamp, padded to 14, so that text order is time order."""
    return F.rpad(F.regexp_replace(_c(c), r"[^0-9]", ""), 14, "0")


def iso_date(digits: Column | str) -> Column:
    d = _c(digits)
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))


def doi(c: Column | str) -> Column:
    """The bare DOI in lower case: resolver, scheme, escapes, invisible characters and closing punctuation aside; null where there is none."""
    plain = F.regexp_replace(F.lower(_c(c)), "[\\u200b-\\u200f\\u2060\\ufeff\\u00ad\\s]+", "")
    bare = F.regexp_extract(F.regexp_replace(plain, "%2f", "/"), r"(10\.[0-9]{4,9}/.+)$", 1)
    return F.nullif(F.regexp_replace(bare, r"[.,;:)\]}>\"']+$", ""), F.lit(""))


def year(c: Column | str) -> Column:
    """The year in a date however written (2020-01-02, 01/02/2020, 2 Jan 2020, 2020); null where there is none."""
    return F.regexp_extract(_c(c), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int")
