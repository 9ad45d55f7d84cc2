"""Therapy landscape, trial lists, phase counts, and the search report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text
from litspark.operators.tagging import NONE

# The stages in their order, and the statuses of trials that take participants.
STAGES = ["Paper", "Preprint", "Patent", "Grant", "Trial: no phase", "Trial: phase 1", "Trial: phase 2", "Trial: phase 3+"]
RECRUITING = ["RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION"]


def stage(source: Column, phase: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    top = text.phase_number(phase)
    trial = F.when(top.isNull(), STAGES[4]).when(top <= 1, STAGES[5]).when(top == 2, STAGES[6]).otherwise(STAGES[7])
    return F.when(s == "clinicaltrials.gov", trial).when(s == "Patent", "Patent").when(s.rlike("(?i)^(preprint|biorxiv|medrxiv)"), "Preprint").when(s.isin("NIH", "NSF"), "Grant").otherwise("Paper")


def landscape(df: DataFrame, name: str, stage_col: str, status: Column) -> DataFrame:
    """One row per therapy: records per stage (0 where none), recruiting trials, total; the largest first."""
    recruiting = F.count_if(F.upper(status).isin(*RECRUITING) & F.col(stage_col).startswith("Trial"))
    # conditional counts instead of pivot: one aggregation, no pass to find the values
    counts = [F.count_if(F.col(stage_col) == s).alias(s.lower().replace(": ", "_").replace(" ", "_").replace("+", "_up")) for s in STAGES]
    out = df.groupBy(F.col(name).alias("therapy")).agg(*counts, recruiting.alias("recruiting"), F.count("*").alias("total"), F.max(name).alias("__name"))
    # a test of the aggregate, not of the key: pushed below the aggregation it would compute the tag twice
    return out.where(F.col("__name") != NONE).drop("__name").orderBy(F.desc("total"), F.lower("therapy"))


def trials_tried(df: DataFrame, modality: str | None = None) -> DataFrame:
    """Trials, the most advanced first, then the latest start (blank last)."""
    rows = df if modality is None else df.where((F.col("primary_modality") == modality) | F.array_contains("modality_hits", modality))
    rank = F.coalesce(text.phase_number(F.col("phase")), F.lit(0))
    return rows.withColumn("phase_rank", rank).orderBy(F.desc("phase_rank"), F.desc(F.coalesce("start_date", F.lit(""))), "nct_id")


def phase_histogram(df: DataFrame, phase: str) -> DataFrame:
    """Trials per phase label, early phases before their digit, ``Not applicable`` last."""
    label = F.regexp_replace(F.when(F.trim(phase) == "", None).otherwise(F.col(phase)), r"Phase (\d)/Phase (\d)", "Phase $1/$2")
    counts = df.groupBy(F.coalesce(label, F.lit("Not applicable")).alias("phase_label")).agg(F.count("*").alias("n"))
    digit = F.nullif(F.regexp_extract("phase_label", r"^\D*(\d)", 1), F.lit("")).cast("double")
    return counts.withColumn("ord", digit - F.when(F.col("phase_label").startswith("Early"), 0.5).otherwise(0.0)).orderBy(F.col("phase_label") == "Not applicable", F.col("ord").asc_nulls_last(), "phase_label").drop("ord")


def source_key(source: Column) -> Column:
    """Preprint sources under one key."""
    return F.when(source.rlike("(?i)^(preprint|biorxiv|medrxiv)"), F.lit("bioRxiv")).otherwise(source)


def source_report(status: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source: matched, retrieved, unique, merged and a status label.  status: source, retrieved, total, status; kept: source."""
    unique = kept.groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("u"))
    label = F.when(F.col("status") == "ok", "OK").when(F.col("status") == "partial", "Stopped early").when(F.col("status") == "failed", "No response").otherwise(F.col("status"))
    u = F.coalesce("u", F.lit(0))
    rows = status.join(unique, "source", "left").select("source", F.col("total").alias("matched"), "retrieved", u.alias("unique_n"), F.greatest(F.lit(0), F.col("retrieved") - u).alias("merged"), label.alias("status"))
    return rows.orderBy(F.desc("retrieved"), F.lower("source"))


def flow(report: DataFrame, n_unique: DataFrame) -> DataFrame:
    """One row: matched over the sources that answered, whether it is complete, retrieved, merged, unique.  n_unique: one row, n."""
    answered = F.col("status") != "No response"
    sums = report.agg(
        F.sum(F.when(answered, F.col("matched"))).alias("matched"), F.coalesce(F.bool_and(answered & F.col("matched").isNotNull()), F.lit(False)).alias("matched_complete"),
        F.coalesce(F.sum("retrieved"), F.lit(0)).alias("retrieved"),
    )
    return sums.crossJoin(F.broadcast(n_unique)).select("matched", "matched_complete", "retrieved", F.greatest(F.lit(0), F.col("retrieved") - F.col("n")).alias("merged"), F.col("n").alias("unique_n"))
