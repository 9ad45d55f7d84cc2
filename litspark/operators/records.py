"""One schema for records of many sources: ragged union, normalisation, per-source status."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litspark.functions import text
from litspark.session import cut, shuffle_partitions


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df in the columns and types of schema: absent columns are null, extra columns go, lists are joined by semicolons."""
    have = dict(df.dtypes)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name not in have:
            c = F.lit(None)
        elif have[f.name].startswith("array") and not f.dataType.typeName() == "array":
            c = F.array_join(F.col(f.name).cast("array<string>"), "; ")
        else:
            c = F.col(f.name)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def union_sources(sources: dict[str, DataFrame], order_by: str) -> DataFrame:
    """Ragged union with source, source_ord and row_id (place by source, then by order_by, which is unique, within the source).

    What is broadcast is one row for each source and task.
    """
    parts = [df.withColumn("source", F.lit(n)).withColumn("source_ord", F.lit(i)) for i, (n, df) in enumerate(sources.items())]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # ranges split a large source over many tasks; a range's places begin where those of the ranges before it end
    spark = union.sparkSession
    ranged = cut(union.repartitionByRange(shuffle_partitions(spark), "source_ord", order_by).sortWithinPartitions("source_ord", order_by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy("source_ord", part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("source_ord").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("source_ord", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(starts), ["source_ord", "__part"])
    row_id = F.col("source_ord").cast("long") * (1 << 40) + F.col("__at") - F.col("__first") + F.col("__before") + 1
    return placed.withColumn("row_id", row_id).drop("__at", "__part", "__first", "__before")


def normalised(df: DataFrame) -> DataFrame:
    """title, doi, date and authors in one form, and is_retracted from the flag or the title."""
    flag = F.coalesce(F.col("is_retracted"), F.lit(False)) if "is_retracted" in df.columns else F.lit(False)
    title = text.decode_entities("title")
    return (
        df.withColumn("title", title).withColumn("doi", text.normal_doi("doi")).withColumn("publication_date", text.normal_date("publication_date"))
        .withColumn("authors", text.normal_authors("authors")).withColumn("is_retracted", flag | F.coalesce(F.col("title").rlike(r"(?i)^\W*(retracted|withdrawn)\b"), F.lit(False)))
    )


def status_rows(counts: DataFrame) -> DataFrame:
    """source, retrieved, total, status of each source: failed sources that returned something are partial."""
    status = F.when(~F.col("failed"), "ok").when(F.col("retrieved") > 0, "partial").otherwise("failed")
    return counts.select("source", "retrieved", "total", status.alias("status"))


def with_fallback_id(df: DataFrame, id_column: str, order: list[str], prefix: str = "unknown_id_") -> DataFrame:
    """Rows without an id get one from their place among them; the order must be total."""
    missing = F.col(id_column).isNull() | (F.trim(id_column) == "")
    place = F.row_number().over(Window.orderBy(*order))
    named = df.where(missing).withColumn(id_column, F.concat(F.lit(prefix), place.cast("string")))
    return df.where(~missing).unionByName(named)


def grown_vocabulary(known: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    """The union of known and newly seen values, each once."""
    return known.select(column).unionByName(seen.select(column)).where(F.trim(column) != "").distinct()


def release_name(date: str, inputs: dict[str, bytes]) -> str:
    """A release: its date and twelve digits of a digest of all inputs, whatever their order."""
    digest = hashlib.sha256()
    for name in sorted(inputs):
        digest.update(name.encode() + b"\0" + hashlib.sha256(inputs[name]).digest())
    return f"{date}-{digest.hexdigest()[:12]}"
