"""What changed between consecutive full snapshots.

Keys and rows are reduced to 64-bit hashes and hashed into buckets; each bucket is sorted in numpy, set differences
of consecutive snapshots are found with ``searchsorted``, and full key values are fetched for differing keys only.

Scale: the deliveries are read once.  Those of one key for one snapshot are reduced to the last one with a map-side
combine before any shuffle, so a key that holds a third of all rows sends one row per snapshot and task.  A bucket holds
about ``bucket_rows`` compact rows of 20 bytes, whatever the input's size.  Different keys with one hash (to be expected
from some 10^9 keys on) are noticed and compared by themselves, key by key.

Defined results: of several deliveries the last loaded counts (on a tie the larger row hash); null keys are left
out; a null row value is a value; the first snapshot gives no cases; a snapshot without any delivery removes all;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.session import cut


def _differences(pdf: pd.DataFrame, last: int) -> pd.DataFrame:
    """(seq, k, kind) of one bucket; kind 0 added, 1 removed, 2 changed."""
    seq, key, row = (pdf[c].to_numpy() for c in ("seq", "k", "r"))
    order = np.lexsort((key, seq))
    seq, key, row = seq[order], key[order], row[order]
    ends = np.searchsorted(seq, np.arange(1, last + 2))
    found: list[pd.DataFrame] = []
    for s in range(2, last + 1):
        a, b = slice(ends[s - 2], ends[s - 1]), slice(ends[s - 1], ends[s])
        old, new = key[a], key[b]
        at = np.searchsorted(old, new)
        both = np.zeros(len(new), dtype=bool)
        inside = at < len(old)
        both[inside] = old[at[inside]] == new[inside]
        changed = both.copy()
        changed[both] = row[a][at[both]] != row[b][both]
        gone = np.ones(len(old), dtype=bool)
        gone[at[both]] = False
        for kind, keys in ((0, new[~both]), (1, old[gone]), (2, new[changed])):
            if len(keys):
                found.append(pd.DataFrame({"seq": np.int32(s), "k": keys, "kind": np.int32(kind)}))
    return pd.concat(found) if found else pd.DataFrame({"seq": np.array([], "int32"), "k": np.array([], "int64"), "kind": np.array([], "int32")})


def _plain_differences(last: DataFrame) -> DataFrame:
    """seq, key, kind by a join on the keys themselves.  last: seq, key, r."""
    old = last.select((F.col("seq") + 1).alias("seq"), "key", F.col("r").alias("was"), F.lit(1).alias("here"))
    both = last.withColumn("there", F.lit(1)).join(old, ["seq", "key"], "full")
    kind = F.when(F.col("here").isNull(), 0).when(F.col("there").isNull(), 1).when(F.col("r") != F.col("was"), 2)
    return both.select("seq", "key", kind.alias("kind")).where("kind is not null and seq > 1")


def snapshot_changes(deliveries: DataFrame, snapshots: DataFrame, key: Column, date: Column, row: Column, loaded: Column, bucket_rows: int = 400_000, key_hash: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """snapshot_date, key and change_kind between each snapshot and the one before it.

    deliveries: the rows, with Columns for their key, snapshot date, row value and load time.  snapshots: one column
    ``snapshot_date``, one row per snapshot to compare (a small dimension); dates that are not in it are passed over.
    """
    numbered = snapshots.select("snapshot_date").distinct().withColumn("seq", F.row_number().over(Window.orderBy("snapshot_date")).cast("int"))
    dates = [r.snapshot_date for r in numbered.orderBy("seq").collect()]
    rows = deliveries.select(key.alias("key"), date.alias("snapshot_date"), F.xxhash64(row).alias("r"), loaded.alias("t")).where("key is not null")
    hashed = rows.join(numbered, "snapshot_date").select("seq", key_hash("key").alias("k"), "key", "r", "t")
    last = hashed.groupBy("seq", "k").agg(F.max(F.struct("t", "r")).alias("m"), F.min("key").alias("key"), F.max("key").alias("other"))
    final = cut(last.select("seq", "k", F.col("m.r").alias("r"), "key", "other"))
    names = final.groupBy("k").agg(F.min("key").alias("key"), F.max("other").alias("other"))
    clashing = cut(names.where("key <> other").select("k"))
    buckets = max(1, -(-final.count() // bucket_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _differences(pdf, len(dates))

    found = final.groupBy(F.pmod("k", F.lit(buckets)).alias("bucket")).applyInPandas(lambda _, p: run(p), "seq int, k long, kind int")
    named = found.join(names.where("key = other"), "k").select("seq", "key", "kind")
    if clashing.count():
        alone = hashed.join(clashing, "k", "left_semi").groupBy("seq", "key").agg(F.max(F.struct("t", "r")).alias("m"))
        # a snapshot that has none of these keys is one all the same
        named = named.unionByName(_plain_differences(alone.select("seq", "key", F.col("m.r").alias("r"))).where(F.col("seq") <= len(dates)))
    kinds = F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("changed")), F.col("kind") + 1)
    return named.join(F.broadcast(numbered), "seq").select("snapshot_date", "key", kinds.alias("change_kind"))
