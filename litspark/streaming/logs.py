"""Streams: daily counts and sliding rates of an event log with a watermark, sessions, change events of trial versions.

Each function turns a streaming (or batch) DataFrame into a result; ``drain`` runs what is there now into a table.
Counts and rates are drained in update mode: windows older than the watermark leave the state, and rows that come later
than that are dropped.  Sessions have no update mode, so they are drained in complete mode, for bounded logs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from litspark.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A file stream over the table ``name`` in folder (one file or a folder of them), with its stored schema."""
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    one = len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time in UTC (zone-less time stamps are cast) and a watermark."""
    return df.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def daily_counts(events: DataFrame, by: str, delay: str = "1 hour") -> DataFrame:
    return with_event_time(events, "ts", delay).groupBy(F.window("event_time", "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: events with no pause longer than gap."""
    w = F.session_window("event_time", gap)
    return with_event_time(events, "ts", delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def sliding_rate(events: DataFrame, by: str, window: str = "60 seconds", slide: str = "15 seconds", delay: str = "1 hour") -> DataFrame:
    return with_event_time(events, "ts", delay).groupBy(F.window("event_time", window, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), by, "n")


def version_pairs(versions: DataFrame) -> DataFrame:
    """nct_id, seen, vid, old, new: each version of a trial with the one before it, where they differ.

    versions: nct_id, seen, vid, rec (JSON of the canonical record).  The state of a trial is its last version; a version
    that comes after a later one is passed over.
    """

    def pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["seen", "vid"], kind="stable")
        out = []
        for seen, vid, rec in rows[["seen", "vid", "rec"]].itertuples(index=False):
            if last is not None:
                if (seen, vid) <= (last[0], last[1]):
                    continue
                if rec != last[2]:
                    out.append((key[0], seen, vid, last[2], rec))
            last = (seen, int(vid), rec)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["nct_id", "seen", "vid", "old", "new"])

    keyed = versions.where("nct_id is not null and seen is not null").groupBy("nct_id")
    return keyed.applyInPandasWithState(pairs, "nct_id string, seen string, vid long, old string, new string", "seen string, vid long, rec string", "append", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """The stream run over what is there now (available-now trigger), as a table in the checkpoint folder.

    mode: complete; append; or update, where the last row of each combination of keys counts.
    """
    spark = result.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if mode != "update" else batch.withColumn("__batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(result.schema).parquet(out)
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("__batch", LongType())])).parquet(out)
    others = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("__batch", *others)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])
