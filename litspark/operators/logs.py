"""Summaries of an event log: daily pivots, clients, quality, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_pivot(df: DataFrame, ts: str, by: str, values: list[str]) -> DataFrame:
    """Events per day, one column per value, 0 where none; the latest day first."""
    counts = [F.count_if(F.col(by) == v).alias(v) for v in values]
    return df.groupBy(F.to_date(ts).alias("day")).agg(*counts).orderBy(F.desc("day"))


def within_days(df: DataFrame, ts: str, days: int) -> DataFrame:
    """The last ``days`` days before the latest event."""
    last = df.agg(F.max(ts).alias("last"))
    return df.join(F.broadcast(last), F.col(ts) >= F.col("last") - F.make_dt_interval(F.lit(days))).drop("last")


def normal_client(client: Column, same: dict[str, str]) -> Column:
    """One label for a client that shows several: by table, else without its prefix."""
    stripped = F.regexp_replace(client, "^ua:", "")
    if not same:
        return stripped
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in same.items() for x in kv]), client), stripped)


def clients(df: DataFrame, client: Column, channel: str, search: Column, session: str, ts: str) -> DataFrame:
    """Per client and channel: events, searches, sessions, first and last event."""
    base = df.withColumn("client", client).where("client is not null")
    return base.groupBy("client", F.col(channel).alias("channel")).agg(F.count("*").alias("events"), F.count_if(search).alias("searches"), F.countDistinct(session).alias("sessions"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def quality(df: DataFrame, empty: Column, duration: str, accuracy: int | None = None) -> DataFrame:
    """One row: searches, empty ones and their share, median and 90th percentile of the duration.

    The exact percentiles hold every different value in one task; with ``accuracy`` they are sketches, for long logs.
    """
    if accuracy is not None:
        return df.agg(
            F.count("*").alias("searches"), F.count_if(empty).alias("empty"), F.round(100 * F.avg(empty.cast("int")), 1).alias("empty_pct"),
            F.percentile_approx(duration, 0.5, accuracy).alias("median_seconds"), F.percentile_approx(duration, 0.9, accuracy).alias("p90_seconds"),
        )
    return df.agg(
        F.count("*").alias("searches"), F.count_if(empty).alias("empty"), F.round(100 * F.avg(empty.cast("int")), 1).alias("empty_pct"),
        F.round(F.median(duration), 2).alias("median_seconds"), F.round(F.percentile(duration, F.lit(0.9)), 2).alias("p90_seconds"),
    )


def packed_counts(pairs: Column) -> Column:
    """A map of counts as ``A:1;B:2``, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")


def source_counts(df: DataFrame, packed: str) -> DataFrame:
    """Unpacked ``A:1;B:2`` cells: per source how often it is there, empty, its median and sum."""
    part = df.where(F.col(packed).isNotNull()).select(F.explode(F.split(packed, ";")).alias("p"))
    rows = part.select(F.split("p", ":").alias("kv")).select(F.get("kv", F.lit(0)).alias("source"), F.get("kv", F.lit(1)).try_cast("double").alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("searches_present"), F.count_if(F.col("n") == 0).alias("zero_results"), F.round(F.median("n"), 4).alias("median_records"), F.round(F.sum("n"), 4).alias("total_records"))
