"""Term search, source filters, fair paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TERMS = 8
# What the names of source groups stand for.
GROUPS = {"papers": ["epmc", "openalex", "core", "scopus"], "grants": ["nih", "nsf"], "preprints": ["preprint", "biorxiv", "medrxiv"], "trials": ["clinicaltrials", "ctgov"]}


def terms(query: str) -> list[str]:
    """Quoted phrases and words of a query, without operators and outer punctuation, the first eight."""
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]+"', " ", query)
    edge = "][(){}\"',;:"
    words = [w.strip(edge) for w in rest.split()]
    found = [t.strip() for t in [*phrases, *(w for w in words if w and w.upper() not in ("AND", "OR", "NOT"))]]
    return list(dict.fromkeys(t for t in found if t))[:MAX_TERMS]


def starts_word(c: Column, term: str) -> Column:
    """Whether a word (or phrase) that begins with term stands in the text, whatever the case."""
    return F.coalesce(c.rlike("(?i)(^|[^A-Za-z0-9])" + re.sub(r"([^\w\s])", r"\\\1", term)), F.lit(False))


def matching(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which every term stands in one of the columns."""
    conditions = [reduce(lambda a, b: a | b, [starts_word(F.col(c), t) for c in columns]) for t in terms(query)]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df.limit(0)


def from_sources(df: DataFrame, wanted: list[str], column: str = "source") -> DataFrame:
    """Rows of the named source groups, or whose source holds the given text."""
    parts = [p for w in wanted for p in GROUPS.get(w.lower(), [w.lower()])]
    return df.where(reduce(lambda a, b: a | b, [F.lower(column).contains(p) for p in parts])) if parts else df


def round_robin(df: DataFrame, source: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of the first of each source, then the second of each, and so on.

    No turn beyond the page's end can lie on it, so each task keeps that many rows of a source before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= offset + limit).orderBy("turn", *order).offset(offset).limit(limit)


def newest(df: DataFrame, date: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(date), tie).limit(limit)
