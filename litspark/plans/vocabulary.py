"""Vocabularies: ordered categories with their names, read from tables and compiled to patterns, masks and guards.

A name is taken apart once into atoms: runs of letters and digits, other symbols, and gaps (blanks and hyphens, which are
interchangeable).  Everything else is made from the atoms: the pattern of a category, which categories' names lie inside
those of others (and so mask them), and the literals without which a pattern can't match.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame

SHORT = 5
MOST_NAMES = 20_000  # a vocabulary is compiled on the driver and sent to the tasks; larger lists are joined instead
_GAP = " "
_ATOM = re.compile(r"[A-Za-z0-9]+|[\s\-]+|.", re.DOTALL)
_BEFORE, _AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Name:
    """One name of a category."""

    text: str

    @property
    def exact(self) -> bool:
        """Short names with a capital are matched in their own case only."""
        return len(self.text) <= SHORT and any("A" <= c <= "Z" for c in self.text) and not any(c.isspace() for c in self.text)

    @property
    def atoms(self) -> list[str]:
        found = [_GAP if a.strip(" \t\r\n\f\v-") == "" else a for a in _ATOM.findall(self.text)]
        while found and found[0] == _GAP:
            found.pop(0)
        while found and found[-1] == _GAP:
            found.pop()
        return found

    @property
    def pattern(self) -> str:
        return "".join(r"[\s\p{Z}\-]+" if a == _GAP else a if a.isalnum() else re.escape(a) for a in self.atoms)

    @property
    def rarest(self) -> str:
        """The longest run of letters and digits, in lower case: what every match holds."""
        return max((a.lower() for a in self.atoms), key=len, default="")

    def inside(self, other: Name) -> bool:
        """Whether this name, as it is matched, stands as whole words in another one."""
        mine, theirs = (n.atoms if self.exact else [a.lower() for a in n.atoms] for n in (self, other))
        return any(theirs[i : i + len(mine)] == mine for i in range(len(theirs) - len(mine) + 1)) if mine else False


def names_pattern(names: Iterable[str]) -> str:
    """One pattern for whole words of any of the names, the longest first."""
    ordered = sorted({n.strip(): None for n in names}, key=lambda n: -len(n))
    parts = [f"(?{'-i' if exact else 'iu'}:{'|'.join(n.pattern for n in same)})" for exact, same in groupby(map(Name, ordered), key=lambda n: n.exact)]
    return f"{_BEFORE}(?:{'|'.join(parts)}){_AFTER}"


@dataclass(frozen=True)
class Compiled:
    """A category: its pattern, the mask of more specific names, and literals of which one must occur."""

    name: str
    pattern: str
    mask: str | None
    needed: tuple[str, ...]


@dataclass(frozen=True)
class Vocabulary:
    """An ordered list of categories and their names."""

    name: str
    categories: dict[str, list[str]] = field(hash=False)

    @property
    def version(self) -> str:
        """A fingerprint of the vocabulary, for keys of stored results."""
        return hashlib.sha256(json.dumps([self.name, list(self.categories.items())]).encode()).hexdigest()[:12]

    def masks(self) -> dict[str, list[str]]:
        """For each category the names of other categories that hold one of its own."""
        every = [(category, Name(n.strip())) for category, names in self.categories.items() for n in names]
        # only names that share an atom can hold each other
        holders: dict[str, list[int]] = {}
        for i, (_, n) in enumerate(every):
            for a in {a.lower() for a in n.atoms}:
                holders.setdefault(a, []).append(i)
        found: dict[str, dict[str, None]] = {c: {} for c in self.categories}
        for category, n in every:
            for i in holders.get(n.rarest, ()):
                if every[i][0] != category and n.inside(every[i][1]):
                    found[category][every[i][1].text] = None
        return {c: list(f) for c, f in found.items()}

    def compiled(self) -> list[Compiled]:
        masks = self.masks()
        return [
            Compiled(c, names_pattern(names), names_pattern(masks[c]) if masks[c] else None, tuple(sorted({Name(n).rarest for n in names} - {""})))
            for c, names in self.categories.items()
        ]


def from_rows(name: str, rows: Iterable[tuple[str, str]]) -> Vocabulary:
    """A vocabulary from (category, name) pairs; their order is kept."""
    cats: dict[str, list[str]] = {}
    for category, alias in rows:
        cats.setdefault(category, []).append(alias)
    return Vocabulary(name, cats)


def from_table(name: str, df: DataFrame, category: str, alias: str, most: int = MOST_NAMES) -> Vocabulary:
    """A vocabulary from a table, in the order of categories and names; more than ``most`` names are refused, as they belong into a join."""
    rows = df.selectExpr(f"trim(`{category}`) as c", f"trim(`{alias}`) as a").where("c <> '' and a <> ''").distinct().orderBy("c", "a").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"vocabulary {name}: more than {most} names")
    return from_rows(name, [(r.c, r.a) for r in rows])
