"""History of changing attributes, kept as a checkpoint-delta store and read back as validity periods.

``delta_store`` turns the versions of each entity into full versions (checkpoints) every ``every`` versions and, in
between, patches that hold only the attributes that changed (none for an unchanged version, which still tells a late one
where to end).  ``validity`` folds the
patches forward from the nearest checkpoint and gives one row per longest run of one value; ``state_at`` gives the values
at one time from the checkpoint before it; ``appended`` takes further versions into a stored history, late ones too.
The store is a plain table: write it, read it back, and fold it again.

Scale: versions are range-partitioned by entity *and* time, so an entity with a third of all versions spans many
tasks; each task starts with a checkpoint, and only the runs at the edges of tasks (two per attribute and task) are
stitched together afterwards.

Defined results: versions are ordered by time, then by version id; null (or absent) is a value of its own; repeated
versions change nothing; versions without an entity or time are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.session import cut, shuffle_partitions

OPEN_END = "9999-12-31"
_NULL = "\ue000"  # stands for null inside the folds; a private-use character


def loose(value: Column) -> Column:
    """One form of values that differ only in case, punctuation, spacing, or in being number or string; null if nothing is left."""
    v = F.regexp_replace(F.lower(value), r"^\s*(-?[0-9]+)\.0+\s*$", "$1")
    return F.nullif(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""), F.lit(""))


def delta_store(versions: DataFrame, attrs: list[str], every: int = 16) -> DataFrame:
    """entity, seen, vid, kind (full or patch), mask (a bit for each attribute held), and the attributes.

    versions: columns entity, seen (text in time order), vid (long) and the attributes, all strings.
    """
    part = versions.select("entity", "seen", "vid", *attrs).where("entity is not null and seen is not null").repartitionByRange(shuffle_partitions(versions.sparkSession), "entity", "seen", "vid")
    ordered = part.sortWithinPartitions("entity", "seen", "vid")
    everything = (1 << len(attrs)) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # entity, values, versions since the task's first of this entity
        for b in batches:
            if not len(b):
                continue
            entity = b["entity"].to_numpy()
            values = [b[a].fillna(_NULL).to_numpy() for a in attrs]
            new = np.ones(len(b), dtype=bool)
            new[1:] = entity[1:] != entity[:-1]
            new[0] = last is None or last[0] != entity[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
            nth = np.where(start >= 0, np.arange(len(b)) - start, np.arange(len(b)) + 1 + (last[2] if last else 0))
            mask = np.zeros(len(b), dtype=np.int64)
            for i, v in enumerate(values):
                differs = np.ones(len(b), dtype=bool)
                differs[1:] = v[1:] != v[:-1]
                differs[0] = last is None or last[1][i] != v[0]
                mask |= np.where(differs & ~new, 1 << i, 0)
            full = new | (nth % every == 0)
            mask[full] = everything
            last = (entity[-1], [v[-1] for v in values], int(nth[-1]))
            out = b[["entity", "seen", "vid"]].copy()
            out["kind"] = np.where(full, "full", "patch")
            out["mask"] = mask
            for i, a in enumerate(attrs):
                out[a] = b[a].where((mask >> i & 1) == 1, None)
            yield out

    return ordered.mapInPandas(run, "entity string, seen string, vid long, kind string, mask long, " + ", ".join(f"{a} string" for a in attrs))


def state_at(store: DataFrame, attrs: list[str], time: str) -> DataFrame:
    """entity, seen, vid and the attributes of each entity as of ``time`` (in the form of ``seen``, that time included).

    Only the nearest checkpoint and the patches behind it are read into the fold, an aggregate with map-side combine.
    """
    known = store.where(F.col("seen") <= time).withColumn("at", F.struct("seen", "vid"))
    nearest = known.where("kind = 'full'").groupBy("entity").agg(F.max("at").alias("checkpoint"))
    rest = known.join(nearest, "entity").where(F.col("at") >= F.col("checkpoint"))
    values = [F.max(F.when(F.expr(f"(mask >> {i}) & 1 = 1"), F.struct("at", F.col(a).alias("v"))))["v"].alias(a) for i, a in enumerate(attrs)]
    return rest.groupBy("entity").agg(F.max("at").alias("at"), *values).select("entity", "at.seen", "at.vid", *attrs)


def unfolded(store: DataFrame, attrs: list[str]) -> DataFrame:
    """entity, seen, vid and all attributes of every stored version: patches folded forward from their checkpoint.

    The store is read in ranges by entity and time; a range that does not begin with a checkpoint gets the state before
    it from the range before (one row for each range).
    """
    part = store.repartitionByRange(shuffle_partitions(store.sparkSession), "entity", "seen", "vid").sortWithinPartitions("entity", "seen", "vid")
    schema = "entity string, seen string, vid long, part int, have long, " + ", ".join(f"{a} string" for a in attrs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, values, have = TaskContext.get().partitionId(), None, [None] * len(attrs), 0
        for b in batches:
            out = []
            for entity, seen, vid, mask, *new in b[["entity", "seen", "vid", "mask", *attrs]].itertuples(index=False):
                if entity != last:
                    last, values, have = entity, [None] * len(attrs), 0
                values = [n if mask >> i & 1 else v for i, (v, n) in enumerate(zip(values, new, strict=True))]
                have |= mask
                out.append((entity, seen, vid, part, have, *values))
            yield pd.DataFrame(out, columns=["entity", "seen", "vid", "part", "have", *attrs])

    rows = cut(part.mapInPandas(run, schema))
    everything = (1 << len(attrs)) - 1
    # what a range knows of its last entity at its end, for the ranges behind it
    ends = rows.groupBy("part").agg(F.max(F.struct("entity", "seen", "vid", "have", *attrs)).alias("e")).select("part", "e.*")
    missing = rows.where(F.col("have") != everything).select("entity", "part").distinct()
    before = missing.join(ends.select(F.col("part").alias("earlier"), "entity", F.col("have").alias("had"), *[F.col(a).alias(f"b_{a}") for a in attrs]), "entity").where("earlier < part")
    carried = before.groupBy("entity", "part").agg(*[F.max_by(F.struct(F.col(f"b_{a}").alias("v")), F.when(F.expr(f"(had >> {i}) & 1 = 1"), F.col("earlier"))).alias(f"c_{a}") for i, a in enumerate(attrs)])
    whole = rows.join(carried, ["entity", "part"], "left")
    return whole.select("entity", "seen", "vid", *[F.when(F.expr(f"(have >> {i}) & 1 = 1"), F.col(a)).otherwise(F.col(f"c_{a}")["v"]).alias(a) for i, a in enumerate(attrs)])


def appended(store: DataFrame, versions: DataFrame, attrs: list[str], every: int = 16) -> DataFrame:
    """The store with further versions: histories of the entities they belong to are made anew, all others stay as they are.

    Versions may be late, and repeated ones (same entity, time and id) count once, the stored one first.
    """
    new = versions.select("entity", "seen", "vid", *attrs).where("entity is not null and seen is not null")
    touched = cut(new.select("entity").distinct())
    old = unfolded(store.join(touched, "entity", "left_semi"), attrs)
    every_column = [F.min_by(F.struct(*attrs), "late").alias("a")]
    both = old.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1))).groupBy("entity", "seen", "vid").agg(*every_column)
    made = delta_store(both.select("entity", "seen", "vid", "a.*"), attrs, every)
    return store.join(touched, "entity", "left_anti").select(made.columns).unionByName(made)


def validity(store: DataFrame, attrs: list[str], ordered: bool = False) -> DataFrame:
    """entity, attr, val, valid_from, valid_to (both in the form of ``seen``; null: still valid).

    ordered: the store comes straight from ``delta_store``, so its partitions are already ranges in order.
    """
    if not ordered:
        store = store.repartitionByRange(shuffle_partitions(store.sparkSession), "entity", "seen", "vid").sortWithinPartitions("entity", "seen", "vid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: list[tuple | None] = [None] * len(attrs)  # the open run of each attribute: entity, val, seen, vid, is first of the task
        for b in batches:
            mask = b["mask"].to_numpy()
            for i, a in enumerate(attrs):
                held = (mask >> i & 1) == 1
                entity, val, seen, vid = (b.loc[held, c].to_numpy() for c in ("entity", a, "seen", "vid"))
                val = pd.Series(val, dtype=object).fillna(_NULL).to_numpy()
                first = np.zeros(len(entity), dtype=bool)
                if carry[i] is None:
                    first[:1] = True
                else:
                    entity, val, seen, vid, first = (np.concatenate([np.array([c], dtype=x.dtype), x]) for c, x in zip(carry[i], (entity, val, seen, vid, first), strict=True))
                if not len(entity):
                    continue
                starts = np.ones(len(entity), dtype=bool)
                starts[1:] = (entity[1:] != entity[:-1]) | (val[1:] != val[:-1])
                entity, val, seen, vid, first = entity[starts], val[starts], seen[starts], vid[starts], first[starts]
                carry[i] = (entity[-1], val[-1], seen[-1], vid[-1], first[-1])
                same = entity[1:] == entity[:-1]
                yield pd.DataFrame({"entity": entity[:-1], "attr": a, "val": val[:-1], "valid_from": seen[:-1], "vid": vid[:-1], "valid_to": np.where(same, seen[1:], ""), "edge": first[:-1]})
        tails = [(c[0], a, c[1], c[2], c[3], None, True) for c, a in zip(carry, attrs, strict=True) if c is not None]
        yield pd.DataFrame(tails, columns=["entity", "attr", "val", "valid_from", "vid", "valid_to", "edge"])

    runs = store.mapInPandas(run, "entity string, attr string, val string, valid_from string, vid long, valid_to string, edge boolean")
    # the edges of tasks: an open run goes on in the next task if the value is the same there, else it ends there
    w = Window.partitionBy("entity", "attr").orderBy("valid_from", "vid")
    goes_on = F.coalesce(F.lag("valid_to").over(w).isNull() & (F.lag("val").over(w) == F.col("val")), F.lit(False))
    edges = runs.where("edge").withColumn("new", (~goes_on).cast("int")).withColumn("run", F.sum("new").over(w))
    merged = edges.groupBy("entity", "attr", "run").agg(
        F.min("val").alias("val"), F.min("valid_from").alias("valid_from"), F.max_by(F.coalesce("valid_to", F.lit("?")), F.struct("valid_from", "vid")).alias("to")
    )
    following = F.lead("valid_from").over(Window.partitionBy("entity", "attr").orderBy("run"))
    stitched = merged.select("entity", "attr", "val", "valid_from", F.when(F.col("to") == "?", following).otherwise(F.col("to")).alias("valid_to"))
    out = runs.where("not edge").select("entity", "attr", "val", "valid_from", "valid_to").unionByName(stitched)
    return out.select("entity", "attr", F.nullif("val", F.lit(_NULL)).alias("val"), "valid_from", F.nullif("valid_to", F.lit("")).alias("valid_to"))
