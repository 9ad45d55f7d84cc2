"""Best representative of each group of duplicates, field by field.

``survivors`` chooses, per group, the surviving record by an order of trust and, per field, the record that supplies
it.  All choices are single aggregates with map-side combine (``min_by``/``max_by`` over small structs), so a group
with a third of all rows sends one partial row per task and no group is ever gathered.

``consensus`` builds a text field from all copies: the distinct values of a group are aligned token by token with
progressive alignment, weighted tokens vote per column, and the existing value nearest to the consensus is emitted.
Groups are aligned in blocks of at most ``fan_in`` values, and the blocks' consensus profiles are aligned again, level
by level, so the work of one task is bounded whatever the size of a group.

Values of any length are aligned: where their differing middles exceed ``MOST_CELLS`` pairs of words, they are halved
(Hirschberg's method), which needs memory in proportion to their length only and gives as good an alignment.

Defined results: rows without a group key belong to no group; groups of one row are left out by ``survivors`` and keep
their only value in ``consensus``; ties go to the smallest id; blank values never win over values; empty tables give
empty results.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.session import cut

MOST_CELLS = 4_000_000
# What stands for a missing text.
NO_TEXT = (
    "", "-", "--", "–", "—", "?", ".", "na", "n/a", "n.a.", "n.a", "nan", "null", "none", "nil", "no abstract", "no abstract available",
    "no abstract available.", "abstract not available", "abstract not available.", "not available", "not available.", "unavailable", "[no abstract available]",
    "[abstract not available]", "no abstract provided", "abstract unavailable",
)


def stripped(c: Column) -> Column:
    """Outer white space of any kind aside."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def real_text(c: Column) -> Column:
    """The text without outer blanks, or null where it stands for nothing."""
    t = stripped(c)
    return F.when((F.length(t) > 32) | ~F.lower(t).isin(*NO_TEXT), t)


def survivors(df: DataFrame, group: Column, row_id: Column, order: list[Column], longest: dict[str, Column]) -> DataFrame:
    """One row per group of two or more: group, first_id, survivor_id, n, and per entry of ``longest`` the id of the supplier.

    order: ascending sort keys of the surviving record, nulls last.  longest: text columns (null: no value) whose
    longest value counts; the supplier is 0 where no copy has a value.  Ties go to the smallest id.
    """
    keys = [f"o{i}" for i in range(len(order))]
    ranked = [F.struct(c.isNull().cast("int").alias("n"), c.alias("v")).alias(k) for k, c in zip(keys, order, strict=True)]
    texts = [F.length(c).alias(f"len_{n}") for n, c in longest.items()]
    narrow = df.select(group.alias("grp"), row_id.cast("long").alias("id"), *ranked, *texts).where("grp is not null")
    best = [
        F.coalesce(F.when(F.max(f"len_{n}").isNotNull(), F.max(F.when(F.col(f"len_{n}").isNotNull(), F.struct(F.col(f"len_{n}"), -F.col("id")))).getField("col2") * -1), F.lit(0)).cast("long").alias(f"{n}_id")
        for n in longest
    ]
    out = narrow.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min(F.struct(*keys, "id")).getField("id").alias("survivor_id"), *best)
    return out.where("n > 1")


Profile = list[dict[str, float]]  # per column of the alignment, the weight of each token ("" is a gap)


def _leader(column: dict[str, float]) -> str:
    return min(column, key=lambda t: (-column[t], t))


class _Scorer:
    """Scores of the columns of one profile against all columns of another."""

    def __init__(self, b: Profile) -> None:
        self.size = len(b)
        self.voters: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            for t in c:
                self.voters.setdefault(t, []).append(j)
        self.first: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            self.first.setdefault(_leader(c), []).append(j)

    def against(self, column: dict[str, float], lo: int, hi: int) -> np.ndarray:
        """2 where both sides' leading tokens are equal, 0.5 where one side's is among the other's votes, else -1."""
        out = np.full(self.size, -1.0)
        x = _leader(column)
        for t in column:
            out[self.first.get(t, ())] = 0.5
        out[self.voters.get(x, ())] = 0.5
        out[self.first.get(x, ())] = 2.0
        return out[lo:hi]


def _rows(a: Profile, b: _Scorer, lo: int, hi: int, back: bool) -> Iterator[np.ndarray]:
    """Rows of the score table of a against b[lo:hi], from the begin or from the end."""
    along = np.arange(hi - lo + 1, dtype=float)
    row = -along
    yield row
    for column in reversed(a) if back else a:
        same = b.against(column, lo, hi)
        best = row - 1.0
        best[1:] = np.maximum(best[1:], row[:-1] + (same[::-1] if back else same))
        row = np.maximum.accumulate(best + along) - along
        yield row


def _steps(a: Profile, b: _Scorer, lo: int, hi: int) -> list[tuple[bool, bool]]:
    """(takes a column of a, takes one of b) along the best path."""
    n, m = len(a), hi - lo
    if n * m > MOST_CELLS and n > 1:
        half = n // 2
        fore, aft = deque(_rows(a[:half], b, lo, hi, False), 1)[0], deque(_rows(a[half:], b, lo, hi, True), 1)[0]
        at = lo + int((fore + aft[::-1]).argmax())
        return _steps(a[:half], b, lo, at) + _steps(a[half:], b, at, hi)
    table = np.stack(list(_rows(a, b, lo, hi, False)))
    out, i, j = [], n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + b.against(a[i - 1], lo, hi)[j - 1]:
            i, j = i - 1, j - 1
            out.append((True, True))
        elif i and table[i, j] == table[i - 1, j] - 1.0:
            i -= 1
            out.append((True, False))
        else:
            j -= 1
            out.append((False, True))
    return out[::-1]


def align(a: Profile, b: Profile) -> Profile:
    """Global alignment of two profiles; columns meet where their votes agree."""
    la, lb = [_leader(c) for c in a], [_leader(c) for c in b]
    head = 0
    while head < min(len(a), len(b)) and la[head] == lb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and la[-1 - tail] == lb[-1 - tail]:
        tail += 1
    ma, mb = a[head : len(a) - tail], b[head : len(b) - tail]
    wa, wb = sum(a[0].values()) if a else 0.0, sum(b[0].values()) if b else 0.0
    middle: Profile = []
    left, right = iter(ma), iter(mb)
    for of_a, of_b in _steps(ma, _Scorer(mb), 0, len(mb)):
        middle.append(_joined(next(left) if of_a else {"": wa}, next(right) if of_b else {"": wb}))
    front = [_joined(x, y) for x, y in zip(a[:head], b[:head], strict=True)]
    back = [_joined(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return front + middle + back


def _joined(x: dict[str, float], y: dict[str, float]) -> dict[str, float]:
    out = dict(x)
    for t, w in y.items():
        out[t] = out.get(t, 0.0) + w
    return out


def consensus_profile(profiles: list[tuple[float, Profile]]) -> Profile:
    """Progressive alignment, the heaviest profile first."""
    ordered = [p for _, p in sorted(profiles, key=lambda x: (-x[0], json.dumps(x[1], sort_keys=True)))]
    whole = ordered[0]
    for p in ordered[1:]:
        whole = align(whole, p)
    return whole


def consensus(df: DataFrame, group: Column, value: Column, weight: Column, fan_in: int = 32) -> DataFrame:
    """group, value, n: per group the existing value that lies nearest to the token-level consensus of all its values."""
    counted = df.select(group.alias("grp"), value.alias("value"), weight.cast("double").alias("w")).where("grp is not null and value is not null and value <> ''")
    values = cut(counted.groupBy("grp", "value").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
    sizes = values.groupBy("grp").agg(F.count("*").alias("k"))
    largest = sizes.agg(F.max("k")).head()[0] or 0
    # the alignment is for groups with two or more spellings; a block never holds more than a few times fan_in of them
    level = values.join(sizes.where("k > 1"), "grp").select("grp", "w", F.to_json(F.struct("value")).alias("v"), "k")

    @F.pandas_udf("string")
    def aligned(ws: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for weights, texts in zip(ws, vs, strict=True):
            items = []
            for w, v in zip(weights, map(json.loads, texts), strict=True):
                items.append((w, [{t: w} for t in v.get("value", "").split()] if isinstance(v, dict) else v))
            out.append(json.dumps(consensus_profile(items)))
        return pd.Series(out)

    @F.pandas_udf("string")
    def voted(v: pd.Series) -> pd.Series:
        return v.map(lambda s: " ".join(t for t in (_leader(c) for c in json.loads(s)) if t))

    while largest > 1:
        last = largest <= fan_in
        parts = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("k") / fan_in)).cast("long")
        blocks = level.withColumn("parts", parts).groupBy("grp", "parts", F.pmod(F.xxhash64("v"), "parts").alias("block"))
        members = F.sort_array(F.collect_list(F.struct("v", "w")))
        level = blocks.agg(members.alias("m")).select("grp", F.aggregate("m", F.lit(0.0), lambda a, x: a + x.w).alias("w"), aligned("m.w", "m.v").alias("v"), F.col("parts").alias("k"))
        largest = 1 if last else -(-largest // fan_in)
    agreed = level.select("grp", voted("v").alias("agreed"))
    distance = F.levenshtein(F.lower("value"), F.lower(F.coalesce("agreed", "value")))
    nearest = values.join(agreed, "grp", "left").select("grp", "value", "w", "n", distance.alias("d"))
    chosen = nearest.groupBy("grp").agg(F.min(F.struct("d", (-F.col("w")).alias("nw"), "value")).getField("value").alias("value"), F.sum("n").alias("n"))
    return chosen
