"""Deeply nested records turned into related flat tables that keep parent and place.

Each record is parsed as a stream into (path, ordinals, value) triples, one for every scalar it holds; no tree is built.
The triples of a record are grouped by their repeated ancestor (the path up to the last list, and the places in the lists
on the way), and each group is pivoted into one row with all its members (``tables``); a row's parent is the row of the
same record whose places are the first ones of its own.  ``shred`` selects one member per element of named lists.

A record lies in one row of the input, so the whole work is a narrow map over Arrow batches: no shuffle, no skew, memory
bounded by a batch.

Defined results: unreadable or null records give nothing; null and empty elements give no row but keep their place; an
element that stands alone at the place of a named list is a list of one; a bare value stands for the named member; an
element with other members but not the named one gives an empty value; a record that is itself a JSON string, begins
with a byte order mark or is wrapped, however deep, is read like the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Path = tuple[str, ...]
Places = tuple[int, ...]
SCALAR, NULL, HOLDER = "scalar", "null", "holder"  # a holder is a list or an object, reported where it begins
_LITERALS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_SPACE = re.compile(r"[ \t\n\r]*")


@dataclass(frozen=True)
class Child:
    """One table: elements of the list at one of ``paths``, each with member ``member`` (None: the element itself).

    A path's steps are member names; ``*`` ends a repeated ancestor.  With two of them the inner list is meant.
    """

    name: str
    paths: tuple[Path, ...]
    member: str | None = None


@dataclass(frozen=True)
class Shape:
    """root: the member whose presence marks the record proper; wrappers: members it may be wrapped in."""

    root: str
    wrappers: tuple[str, ...]
    children: tuple[Child, ...]


def _p(path: str) -> Path:
    return tuple(path.split("."))


_S = "protocolSection."
TRIAL = Shape(
    "protocolSection",
    ("study", "studies", "record", "data"),
    (
        Child("intervention", (_p(_S + "armsInterventionsModule.interventions.*"), _p(_S + "armsInterventionsModule.interventionsList.intervention.*")), "name"),
        Child(
            "other_name",
            (_p(_S + "armsInterventionsModule.interventions.*.otherNames.*"), _p(_S + "armsInterventionsModule.interventionsList.intervention.*.otherNames.*"),
             _p(_S + "armsInterventionsModule.interventionsList.intervention.*.otherNamesList.otherName.*"), _p(_S + "armsInterventionsModule.interventions.*.otherNamesList.otherName.*")),
        ),
        Child("condition", (_p(_S + "conditionsModule.conditions.*"), _p(_S + "conditionsModule.conditionsList.condition.*"))),
        Child("collaborator", (_p(_S + "sponsorCollaboratorsModule.collaborators.*"), _p(_S + "sponsorCollaboratorsModule.collaboratorsList.collaborator.*")), "name"),
        Child("location", (_p(_S + "contactsLocationsModule.locations.*"), _p(_S + "contactsLocationsModule.locationsList.location.*")), "facility"),
        Child("outcome", (_p(_S + "outcomesModule.primaryOutcomes.*"), _p(_S + "outcomesModule.primaryOutcomesList.primaryOutcome.*")), "measure"),
        Child("reference", (_p(_S + "referencesModule.references.*"), _p(_S + "referencesModule.referencesList.reference.*")), "pmid"),
    ),
)
MANIFEST = Shape(
    "queries",
    ("run", "manifest", "snapshot", "data"),
    (
        Child("query", (_p("queries.*"), _p("queriesList.query.*")), "query_id"),
        Child("retry", (_p("queries.*.retries.*"), _p("queriesList.query.*.retries.*"), _p("queries.*.retriesList.retry.*")), "status"),
    ),
)


def scalar(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def events(text: str, lists: frozenset[Path] = frozenset(), root: str | None = None, wrappers: tuple[str, ...] = ()) -> Iterator[tuple[Path, Places, object, str]]:
    """(path, ordinals, value, kind) of everything in a JSON text, in its order; ValueError where it can't be read.

    A list adds the step ``*`` and a place (from 1).  What stands at one of the paths ``lists`` without being a list is a
    list of one.  A member ``root`` below wrappers only begins the record proper: paths and places start anew there.
    """
    at, end = _SPACE.match(text).end(), len(text)
    path: Path = ()
    places: Places = ()
    holders: list[tuple[bool, Path, Places]] = []  # of the open ones: whether a list, its path and places
    counts: list[int] = []
    expects = True  # a value
    while True:
        if expects:
            if at >= end:
                raise ValueError("a value is missing")
            c = text[at]
            if path in lists and c != "[":
                path, places = (*path, "*"), (*places, 1)
            if c in "{[":
                yield path, places, None, HOLDER
                holders.append((c == "[", path, places))
                counts.append(0)
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] != ("]" if c == "[" else "}"):
                    if c == "[":
                        counts[-1] = 1
                        path, places = (*path, "*"), (*places, 1)
                        continue
                    at, path, places = _member(text, at, path, places, root, wrappers)
                    continue
                expects = False
            else:
                if c == '"':
                    value, at = scanstring(text, at + 1, False)
                else:
                    m = _ATOM.match(text, at)
                    if not m:
                        raise ValueError("no value")
                    at, word = m.end(), m.group()
                    value = _LITERALS[word] if word in _LITERALS else float(word) if m.group(1) or m.group(2) else int(word)
                yield path, places, value, NULL if value is None else SCALAR
                at = _SPACE.match(text, at).end()
                expects = False
                if not holders:
                    break
        is_list, path, places = holders[-1]
        c = text[at : at + 1]
        if c == ",":
            at = _SPACE.match(text, at + 1).end()
            if is_list:
                counts[-1] += 1
                path, places = (*path, "*"), (*places, counts[-1])
            else:
                at, path, places = _member(text, at, path, places, root, wrappers)
            expects = True
        elif c == ("]" if is_list else "}"):
            holders.pop()
            counts.pop()
            at = _SPACE.match(text, at + 1).end()
            if not holders:
                break
        else:
            raise ValueError("no end of an element")
    if at != end:
        raise ValueError("more than one value")


def _member(text: str, at: int, path: Path, places: Places, root: str | None, wrappers: tuple[str, ...]) -> tuple[int, Path, Places]:
    """Behind the name of a member: place in the text, path and places."""
    if text[at : at + 1] != '"':
        raise ValueError("no name of a member")
    name, at = scanstring(text, at + 1, False)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    at = _SPACE.match(text, at + 1).end()
    if name == root and path and path != (root,) and all(s in wrappers or s == "*" for s in path):
        return at, (name,), ()
    return at, (*path, name), places


def text_of(raw: bytes | bytearray | memoryview | str | None) -> str | None:
    """The JSON text of a stored record, however often it was packed into a string; None where it can't be read."""
    try:
        text = raw if isinstance(raw, str) or raw is None else bytes(raw).decode("utf-8")
        while text is not None:
            text = text.lstrip("﻿ \t\n\r")
            if text[:1] != '"':
                return text
            inner, at = scanstring(text, 1, False)
            if text[at:].strip(" \t\n\r"):
                return None
            text = inner
    except ValueError:
        pass
    return None


def rows_of_record(raw: object, lists: frozenset[Path] = frozenset(), root: str | None = None, wrappers: tuple[str, ...] = ()) -> dict[tuple[Path, Places], dict[str, str]]:
    """The rows of all tables of a record: (path, ordinals) of the repeated ancestor to its members.

    A member's name is its path below the ancestor; "" is the element itself where it is a bare value.  An element that
    holds lists or objects only is a row too; null members and null or empty elements are none.
    """
    text = text_of(raw)
    if text is None or text[:1] not in ("{", "["):
        return {}
    rows: dict[tuple[Path, Places], dict[str, str]] = {}
    try:
        for path, places, value, kind in events(text, lists, root, wrappers):
            if kind == NULL:
                continue
            if kind == HOLDER:
                # a list or an object is a member of what holds it, so that exists
                if path and path[-1] != "*":
                    n = _repeated(path)
                    rows.setdefault((path[:n], places), {})
                continue
            n = _repeated(path)
            if n == len(path) and value == "":
                continue
            rows.setdefault((path[:n], places), {})[".".join(path[n:])] = scalar(value)
    except (ValueError, RecursionError):
        return {}
    return rows


def _repeated(path: Path) -> int:
    """Length of a path's repeated ancestor."""
    for i in range(len(path), 0, -1):
        if path[i - 1] == "*":
            return i
    return 0


def _named(shape: Shape) -> tuple[frozenset[Path], dict[Path, list[Child]]]:
    """The paths of the shape's lists, and its tables by the path of their elements."""
    lists, tables = set(), {}
    for child in shape.children:
        for path in child.paths:
            tables.setdefault(path, []).append(child)
            lists |= {path[:i] for i, step in enumerate(path) if step == "*"}
    return frozenset(lists), tables


def rows_of(raw: object, shape: Shape, named: tuple[frozenset[Path], dict[Path, list[Child]]] | None = None) -> list[tuple[str, int, int, str]]:
    """(child, pos, sub_pos, val) of one record: the named member of each row of the shape's tables."""
    lists, tables = named or _named(shape)
    out: dict[tuple[str, int, int], str] = {}
    for (path, places), members in rows_of_record(raw, lists, shape.root, shape.wrappers).items():
        for child in tables.get(path, ()):
            val = members.get("", members.get(child.member, "") if child.member else "")
            key = (child.name, places[0], places[1] if len(places) > 1 else 0)
            out[key] = out.get(key) or val
    return [(*k, v) for k, v in out.items()]


def tables(df: DataFrame, key: str, column: str, shape: Shape | None = None) -> DataFrame:
    """parent_key, tbl, place, parent_place, members of every row of every table found in the records.

    tbl is the path of the repeated ancestor ("" for the record itself), place the ordinals of the row, parent_place
    those of its parent row, members a map of all scalar members.  key is a SQL expression, taken as a string.
    """
    lists, root, wrappers = (_named(shape)[0], shape.root, shape.wrappers) if shape else (frozenset(), None, ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (k, ".".join(path), list(places), list(places[:-1]), members)
                for k, raw in zip(batch["k"], batch["raw"], strict=True)
                for (path, places), members in rows_of_record(raw, lists, root, wrappers).items()
            ]
            yield pd.DataFrame(out, columns=["parent_key", "tbl", "place", "parent_place", "members"])

    narrow = df.selectExpr(f"cast({key} as string) as k", f"`{column}` as raw").where("raw is not null")
    return narrow.mapInPandas(run, "parent_key string, tbl string, place array<int>, parent_place array<int>, members map<string,string>")


def table_of(rows: DataFrame, tbl: str, members: list[str]) -> DataFrame:
    """One flat table out of ``tables``: parent_key, parent_place, place and a column for each member (null where absent)."""
    return rows.where(F.col("tbl") == tbl).select("parent_key", "parent_place", "place", *[F.try_element_at("members", F.lit(m)).alias(m.replace(".", "_")) for m in members])


def shred(df: DataFrame, key: str, column: str, shape: Shape, parent_tbl: str) -> DataFrame:
    """parent_tbl, parent_key, child, pos, sub_pos, val of every wanted list element of ``column``.

    key is a SQL expression for the parent's key, taken as a string.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = _named(shape)
        for batch in batches:
            out = [(parent_tbl, k, *r) for k, raw in zip(batch["k"], batch["raw"], strict=True) if raw is not None for r in rows_of(raw, shape, named)]
            yield pd.DataFrame(out, columns=["parent_tbl", "parent_key", "child", "pos", "sub_pos", "val"])

    narrow = df.selectExpr(f"cast({key} as string) as k", f"`{column}` as raw").where("raw is not null")
    return narrow.mapInPandas(run, "parent_tbl string, parent_key string, child string, pos long, sub_pos long, val string")
