"""Agreement of tags with an external annotator, deepest ancestors, consensus edges, gaps, vocabulary proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of hits out of n; null for n = 0."""
    p = F.try_divide(hits, n)
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = F.lit(z) * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / den
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def agreement(df: DataFrame, ours: Column, theirs: Column, by: list[str]) -> DataFrame:
    """Counts of tags that the annotator supports, contradicts or lacks, of misses and of records neither tags."""
    have, want = ours.isNotNull(), F.size(theirs) > 0
    supported = have & F.array_contains(theirs, ours)
    counts = df.groupBy(*by).agg(
        F.count_if(have).alias("tagged"), F.count_if(F.coalesce(supported, F.lit(False))).alias("supported"),
        F.count_if(have & want & ~F.coalesce(supported, F.lit(False))).alias("conflict"), F.count_if(have & ~want).alias("unsupported"),
        F.count_if(~have & want).alias("missed"), F.count_if(~have & ~want).alias("both_none"),
    )
    lo, hi = wilson(F.col("supported"), F.col("tagged"))
    return counts.withColumn("rate", F.round(F.try_divide(F.col("supported"), F.col("tagged")), 6)).withColumn("low", F.round(lo, 6)).withColumn("high", F.round(hi, 6))


def deepest(lineage: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, category of the anchor that lies deepest in the id's lineage.  lineage: id, path (root first); anchors: taxon, category."""
    steps = lineage.select("id", F.posexplode("path").alias("depth", "taxon"))
    return steps.join(anchors, "taxon").groupBy("id").agg(F.max_by("category", F.struct("depth", "category")).alias("category"))


def consensus_edges(df: DataFrame, a: str, b: str, source: str, ref: str, min_sources: int) -> DataFrame:
    """Pairs of values with their number, distinct sources and references, from ``min_sources`` sources on."""
    edges = df.groupBy(a, b).agg(F.count("*").alias("n"), F.countDistinct(source).alias("n_sources"), F.array_join(F.sort_array(F.collect_set(F.col(ref).cast("string"))), ";").alias("refs"))
    return edges.where(F.col("n_sources") >= min_sources)


def gaps(df: DataFrame, topic: str, source: str, enough: int, min_sources: int = 3) -> DataFrame:
    """Per topic its records and sources, and whether they suffice."""
    out = df.groupBy(topic).agg(F.count("*").alias("total"), F.countDistinct(source).alias("n_sources"))
    return out.withColumn("verdict", F.when((F.col("total") >= enough) & (F.col("n_sources") >= min_sources), "SUFFICIENT").otherwise("GAP"))


def proposals(descriptors: DataFrame, covered: DataFrame, least: int) -> DataFrame:
    """Descriptors named by at least ``least`` records that the vocabulary does not cover.  descriptors: id, terms; covered: term."""
    counts = descriptors.select("id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).join(covered, "term", "left_anti")


def rollup_latest(rows: DataFrame, key: str, version: list[str], year: str, carry: list[str]) -> DataFrame:
    """Per key the first and last year and the attributes of the latest row."""
    order = F.struct(*version)
    return rows.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), *[F.max_by(c, order).alias(c) for c in carry])
