"""Queries of the general training-data operators (problems 1, 2, 3 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import ids
from litspark.operators import history, multivalue, nested, snapshot_diff
from litspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the three packed columns."""
    parts = [
        ("virus", "axp_id", "transgenes", multivalue.TRANSGENES),
        ("program", "axp_id", "targets", multivalue.TARGETS),
        ("articles", "cast(article_id as string)", "authors", multivalue.AUTHORS),
    ]
    out = None
    for tbl, key, column, packing in parts:
        part = multivalue.unpack(table(spark, d, tbl), column, packing, [f"'{tbl}' as tbl", f"{key} as row_key"])
        out = part if out is None else out.unionByName(part)
    # keys are unique and places differ within a cell, so the rows are distinct as they are
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per list element of the trials' API records and the snapshots' manifests."""
    trials = nested.shred(table(spark, d, "trial_version"), "version_id", "raw", nested.TRIAL, "trial_version")
    manifests = nested.shred(table(spark, d, "snapshot"), "snapshot_date", "manifest", nested.MANIFEST, "snapshot")
    # version_id and snapshot_date are unique and places differ within a record, so the rows are distinct as they are
    return trials.unionByName(manifests)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Trials added, removed or changed between each complete snapshot and the complete one before it."""
    complete = table(spark, d, "snapshot").where("complete = 1").select("snapshot_date")
    found = snapshot_diff.snapshot_changes(
        table(spark, d, "observation"), complete, ids.nct_id("nct_id"), F.col("snapshot_date"), ids.hex_digest("content_hash"), F.col("loaded_at")
    )
    return found.select("snapshot_date", F.col("key").alias("nct_id"), "change_kind")


TRACKED = ["overall_status", "enrollment_count", "lead_sponsor", "completion_date"]


def p6_store(spark: SparkSession, d: str) -> DataFrame:
    """The tracked fields of all trial versions as checkpoints and patches."""
    rec = F.from_json("record", ", ".join(f"{a} string" for a in TRACKED))
    versions = table(spark, d, "trial_version").select(ids.nct_id("nct_id").alias("entity"), ids.date_digits("first_seen").alias("seen"), F.col("version_id").alias("vid"), rec.alias("rec"))
    return history.delta_store(versions.select("entity", "seen", "vid", *[history.loose(F.col(f"rec.{a}")).alias(a) for a in TRACKED]), TRACKED)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods during which a tracked field of a trial held one value."""
    runs = history.validity(p6_store(spark, d), TRACKED, ordered=True)
    to = F.coalesce(ids.iso_date("valid_to"), F.lit(history.OPEN_END))
    return runs.select(F.col("entity").alias("nct_id"), "attr", ids.iso_date("valid_from").alias("valid_from"), F.when(F.col("valid_to").isNull(), history.OPEN_END).otherwise(to).alias("valid_to"))


def p6_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The tracked fields of each trial as of the latest complete snapshot, from the nearest checkpoints."""
    latest = table(spark, d, "snapshot").where("complete = 1").agg(F.max("snapshot_date")).head()[0] or ""
    state = history.state_at(p6_store(spark, d), TRACKED, latest.replace("-", "") + "999999")
    return state.select(F.col("entity").alias("nct_id"), ids.iso_date("seen").alias("seen"), *TRACKED)


_SQL_NCT = "'NCT' || regexp_extract(upper({c}), 'NCT[^0-9A-Z]*([0-9]{{8}})', 1)"
_P3_SQL = f"""
with c as (select snapshot_date, row_number() over (order by snapshot_date) n from snapshot where complete = 1),
o as (select n, {_SQL_NCT.format(c="nct_id")} k, arg_max(regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+:', ''), loaded_at) h
      from observation join c using (snapshot_date) group by all),
j as (select coalesce(b.n, a.n + 1) n, coalesce(a.k, b.k) k, a.h ah, b.h bh, a.k ak, b.k bk from o a full join o b on a.n + 1 = b.n and a.k = b.k)
select c.snapshot_date, k as nct_id, case when ak is null then 'added' when bk is null then 'removed' else 'changed' end as change_kind
from j join c using (n) where n > 1 and (ak is null or bk is null or ah <> bh)
"""
_P6_SQL = f"""
with v as (select {_SQL_NCT.format(c="nct_id")} k, regexp_replace(first_seen, '[^0-9]', '', 'g') s, version_id, record from trial_version),
u as ({" union all ".join(f"select k, s, version_id, '{a}' attr, nullif(regexp_replace(lower(record->>'{a}'), '[^[:alnum:]]', '', 'g'), '') val from v" for a in TRACKED)}),
l as (select *, lag(val) over w pv, row_number() over w rn from u window w as (partition by k, attr order by rpad(s, 14, '0'), version_id)),
r as (select *, lead(s) over (partition by k, attr order by rn) nx from l where rn = 1 or val is distinct from pv)
select k as nct_id, attr, s[1:4] || '-' || s[5:6] || '-' || s[7:8] as valid_from, coalesce(nx[1:4] || '-' || nx[5:6] || '-' || nx[7:8], '9999-12-31') as valid_to from r
"""

_P6_STATE_SQL = f"""
with v as (select {_SQL_NCT.format(c="nct_id")} k, rpad(regexp_replace(first_seen, '[^0-9]', '', 'g'), 14, '0') s, version_id i, {", ".join(f"nullif(regexp_replace(lower(record->>'{a}'), '[^[:alnum:]]', '', 'g'), '') {a}" for a in TRACKED)} from trial_version),
w as (select * from v where s <= (select replace(max(snapshot_date), '-', '') || '999999' from snapshot where complete = 1)),
l as (select k, s, row_number() over (partition by k order by s desc, i desc) r, {", ".join(TRACKED)} from w)
select k as nct_id, s[1:4] || '-' || s[5:6] || '-' || s[7:8] as seen, {", ".join(TRACKED)} from l where r = 1
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_store": p6_store, "p6_as_of": p6_as_of}
SQL = {"p3_found": _P3_SQL, "p6_found": _P6_SQL, "p6_as_of": _P6_STATE_SQL}
