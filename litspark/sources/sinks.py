"""Sinks: partition rewrite with deduplication, write-once snapshots, upsert, cached results, exports, event append."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rewrite_partitions(new: DataFrame, path: str, partition: str, keys: list[str], sort: list[Column]) -> None:
    """New rows after the stored ones, the stored row of a key kept; only the partitions of the new rows are rewritten.

    The merged rows are written beside the table first, so a failed write leaves the table as it was.
    """
    spark = new.sparkSession
    old = _existing(spark, path)
    touched = new.select(partition).distinct()
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = old.join(touched, partition, "left_semi").withColumn("__new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    merged = first_of(rows, keys, [F.col("__new"), *sort]).drop("__new")
    staging = path.rstrip("/") + "__staging"
    merged.repartition(partition).sortWithinPartitions(partition, *sort).write.mode("overwrite").partitionBy(partition).parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_once(df: DataFrame, path: str, key: str) -> int:
    """Rows whose key value is not stored yet, appended; how many key values that were (a snapshot date is written once)."""
    old = _existing(df.sparkSession, path)
    fresh = df if old is None else df.join(old.select(key).distinct(), key, "left_anti")
    n = fresh.select(key).distinct().count()
    if n:
        fresh.write.mode("append").partitionBy(key).parquet(path)
    return n


def upsert(new: DataFrame, path: str, key: Column, order: list[Column]) -> None:
    """The latest row per key over stored and new rows, written whole."""
    spark = new.sparkSession
    old = _existing(spark, path)
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    latest = first_of(rows.withColumn("__k", key), ["__k"], order).drop("__k")
    staging = path.rstrip("/") + "__staging"
    latest.write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").parquet(path)


def signature(**parts: object) -> str:
    """Key of a stored result: a digest of what it was asked for."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], complete: bool = True, max_age_days: float | None = None) -> DataFrame:
    """The stored result of a key unless it is too old, else the result made now, stored only if every source answered."""
    path = f"{folder.rstrip('/')}/{key}"
    stored = _existing(spark, path)
    if stored is not None and (max_age_days is None or (_age_days(stored) or 0.0) <= max_age_days):
        return stored
    made = make()
    if not complete:
        return made
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _age_days(df: DataFrame) -> float | None:
    """Days since the newest file of a stored table was written; None for a table without rows."""
    seconds = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.max("_metadata.file_modification_time"))
    return df.agg((seconds / 86400.0).alias("d")).head().d


def publish_build(spark: SparkSession, tables: dict[str, DataFrame], path: str, build: str) -> str:
    """All tables of a build below its own folder, and only then the pointer to it; a failed build changes nothing that is read.

    Returns the folder.  The pointer is one small table, so readers see either the old or the new build.
    """
    folder = f"{path.rstrip('/')}/builds/{build}"
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{name}")
    spark.createDataFrame([(build,)], "build string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/current")
    return folder


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current build."""
    build = spark.read.parquet(f"{path.rstrip('/')}/current").head().build
    return spark.read.parquet(f"{path.rstrip('/')}/builds/{build}/{name}")


def take_snapshot(fetched: dict[str, DataFrame | None], path: str, date: str, key: str) -> DataFrame:
    """One snapshot: the rows of all queries with the queries that matched each, written once per date; returns its manifest.

    fetched: by query id its rows, or None where it failed, which makes the snapshot incomplete.
    """
    parts = [df.withColumn("__q", F.lit(q)) for q, df in fetched.items() if df is not None]
    if not parts:
        raise ValueError("no query was answered")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    others = [c for c in union.columns if c not in (key, "__q")]
    merged = union.groupBy(key).agg(*[F.min_by(c, "__q").alias(c) for c in others], F.sort_array(F.collect_set("__q")).alias("matched_queries")).withColumn("snapshot_date", F.lit(date))
    append_once(merged, path, "snapshot_date")
    counts = union.groupBy(F.col("__q").alias("query_id")).agg(F.count("*").alias("n"))
    manifest = union.sparkSession.createDataFrame([(q, df is not None) for q, df in fetched.items()], "query_id string, complete boolean")
    return manifest.join(counts, "query_id", "left").select(F.lit(date).alias("snapshot_date"), "query_id", F.coalesce("n", F.lit(0)).alias("n"), "complete")


def append_events(df: DataFrame, path: str, ts: str) -> None:
    """Events appended as JSON, one folder per day."""
    df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def export_tsv(parts: list[DataFrame], path: str, order: list[str]) -> None:
    """A review file over several queries, sorted; an existing one is not overwritten."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.orderBy(*order).coalesce(1).write.mode("error").option("sep", "\t").option("header", "true").csv(path)


def endnote(df: DataFrame) -> DataFrame:
    """One EndNote block per item: a line for each author and field that is there."""
    authors = F.transform(F.filter(F.split(F.coalesce("authors", F.lit("")), r";\s*"), lambda a: a != ""), lambda a: F.concat(F.lit("%A "), a))
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"%{tag} "), c))
    lines = F.concat(F.array(F.lit("%0 Journal Article"), line("T", F.col("title"))), authors, F.array(line("J", F.col("journal")), line("D", F.substring("publication_date", 1, 4)), line("R", F.col("doi"))))
    return df.select(F.array_join(F.array_compact(lines), "\n").alias("value"))


def export_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A reading list as CSV with a header; list columns are joined; an existing file is not overwritten."""
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.orderBy(*order).coalesce(1).write.mode("error").option("header", "true").option("escape", '"').csv(path)


def markdown_header(exported: str, versions: dict[str, str], n: int) -> str:
    """The lines above a reading list: when and with which versions it was made, and how many items it has."""
    return "\n".join(["# Reading list", "", f"{n} items, exported {exported}", *(f"- {k}: {v}" for k, v in sorted(versions.items())), ""])


def reading_list_markdown(df: DataFrame) -> DataFrame:
    """One Markdown block per item: title linked to its DOI, authors, journal and date."""
    from litspark.functions import text

    link = F.when(F.col("doi").isNotNull(), F.concat(F.lit("## ["), text.md_escape("title"), F.lit("](https://doi.example/"), text.md_link_target("doi"), F.lit(")"))).otherwise(F.concat(F.lit("## "), text.md_escape("title")))
    about = F.concat_ws(", ", text.md_escape("authors"), text.md_escape("journal"), "publication_date")
    return df.select(F.concat_ws("\n", link, F.nullif(about, F.lit(""))).alias("value"))
