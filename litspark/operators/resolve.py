"""Cross-source entity resolution with a merge trail.

Rows are grouped by DOI, then grants by source and grant id, then DOI-less rows join a group of the same title in row
order if the years agree within one.  Groups get their gaps filled by the longest values and keep one row by trust.

The title rule is greedy and depends on row order, but never on rows with another title key: a DOI-less row heads only
its own group before its turn, and joins happen inside one title key.  So each title key is replayed by itself, and
only keys with a DOI-less row and a second row take that path at all.  Before, the rows with a DOI are reduced to the
smallest group of each year (no other one can be joined), with a map-side combine; the replay itself takes the DOI-less
rows in order, in time linear in their number.  Their order is the rule, so those of one title key stay in one task.

Defined results: null, blank and placeholder values are no values; titles shorter than ``MIN_TITLE`` and grants never
join by title; rows alone in their group have no trail; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text

MIN_TITLE = 20
GRANTS = ("NIH", "NSF")
# Which source's copy survives, best first; unknown sources come after all of them.
PRIORITY = {"EPMC": 1, "Scopus": 2, "OpenAlex": 3, "Preprint (biorxiv)": 4, "Preprint (medrxiv)": 5, "bioRxiv": 6, "CORE": 7, "clinicaltrials.gov": 8, "NIH": 9, "NSF": 10, "Patent": 11}


def priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(100))


def clean_doi(doi: Column, published: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(F.nullif(F.trim(published), F.lit("")), doi)))
    return F.nullif(F.regexp_replace(d, r"^(?:https?://(?:dx\.)?doi\.[a-z]+/|doi:\s*)", ""), F.lit(""))


def replay(anchors: dict[int | None, int], rows: list[int], years: list[int | None]) -> list[int]:
    """The title rule inside one title key: the group of each DOI-less row.

    anchors: for each year the smallest group of rows with a DOI; rows: the DOI-less rows in order, each of which heads
    its own group before its turn; years: their years, or None.
    """
    label = dict(zip(rows, rows, strict=True))  # of each group that was ever headed
    members: dict[int, list[int]] = {r: [r] for r in rows}  # heads that share a label
    waiting: dict[int | None, list[int]] = {}  # rows before their turn, the next one last
    for r, y in zip(reversed(rows), reversed(years), strict=True):
        waiting.setdefault(y, []).append(r)
    placed: dict[int | None, set[int]] = {y: set() for y in waiting}  # heads of rows after their turn
    for r, y in zip(rows, years, strict=True):
        waiting[y].pop()
        near = {None, *(waiting if y is None else (y - 1, y, y + 1))}
        fixed = [g for k, g in anchors.items() if y is None or k is None or abs(k - y) <= 1]
        if fixed:
            target = min(fixed)
        else:
            others = [label[w] for k in near if k in waiting for w in waiting[k][-1:]]
            others += [label[h] for k in near if k in placed for h in placed[k]]
            target = min(others, default=label[r])
        old = label[r]
        if target != old:
            # all that share its label move along
            for h in members.pop(old):
                label[h] = target
                members.setdefault(target, []).append(h)
        placed[y].add(r)
        # of rows with one label one is enough
        placed[y] = set({label[h]: h for h in placed[y]}.values())
    return [label[r] for r in rows]


def _attached(anchors: pd.Series, rows: pd.Series) -> pd.Series:
    whole = lambda y: None if y is None or pd.isna(y) else int(y)
    return pd.Series([replay({whole(x["yr"]): x["grp"] for x in a}, [x["row_id"] for x in rs], [whole(x["yr"]) for x in rs]) for a, rs in zip(anchors, rows, strict=True)])


def grouped(df: DataFrame) -> DataFrame:
    """df with grp, the smallest row_id of its group.  df: row_id, source, doi, published_doi, title, publication_date, grant_id."""
    base = df.withColumn("doi_c", clean_doi(F.col("doi"), F.col("published_doi"))).withColumn("tkey", text.title_key("title"))
    base = base.withColumn("yr", F.substring("publication_date", 1, 4).try_cast("int")).withColumn("grant", F.col("source").isin(*GRANTS))
    # rule 1 and 2 by aggregation (combined map-side), not by a window over a possibly hot DOI
    by_doi = base.where("doi_c is not null").groupBy("doi_c").agg(F.min("row_id").alias("g1"))
    base = base.join(by_doi, "doi_c", "left").withColumn("grp", F.coalesce("g1", "row_id"))
    by_grant = base.where("grant and grant_id <> ''").groupBy("source", "grant_id").agg(F.min("grp").alias("g2"))
    base = base.join(by_grant, ["source", "grant_id"], "left").withColumn("grp", F.coalesce("g2", "grp"))
    eligible = base.where(~F.col("grant") & (F.length("tkey") >= MIN_TITLE)).select("row_id", "tkey", "yr", "grp", F.col("doi_c").isNull().alias("orphan"))
    # of the rows with a DOI only the smallest group of each year can be joined
    anchors = eligible.where("not orphan").groupBy("tkey", "yr").agg(F.min("grp").alias("grp")).groupBy("tkey").agg(F.collect_list(F.struct("yr", "grp")).alias("anchors"))
    orphans = eligible.where("orphan").groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("row_id", "yr"))).alias("rs"))
    nothing = F.array().cast("array<struct<yr:int,grp:bigint>>")
    lists = orphans.join(anchors, "tkey", "left").select("rs", F.coalesce("anchors", nothing).alias("anchors")).where("size(rs) + size(anchors) > 1")
    moved = lists.select("rs", F.pandas_udf(_attached, "array<long>")("anchors", "rs").alias("gs")).select(F.explode(F.arrays_zip("rs", "gs")).alias("z"))
    attached = moved.select(F.col("z.rs.row_id").alias("row_id"), F.col("z.gs").alias("grp"))
    out = base.join(attached.withColumnRenamed("grp", "g3"), "row_id", "left").withColumn("grp", F.coalesce("g3", "grp"))
    return out.drop("g1", "g2", "g3", "tkey", "yr", "grant", "doi_c")


NO_VALUE = ("", "NA", "NULL", "No abstract available")


def real(c: str) -> Column:
    """The value without outer blanks, or null where it stands for nothing."""
    t = F.trim(F.col(c))
    return F.when(~t.isin(*NO_VALUE), t)


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps of each column filled within the group by its longest value (the first row's on a tie)."""
    longest = [F.max(F.when(real(c).isNotNull(), F.struct(F.length(real(c)).alias("n"), (-F.col("row_id")).alias("r"), real(c).alias("v"))))["v"].alias(f"fill_{c}") for c in columns]
    best = df.groupBy("grp").agg(*longest)
    joined = df.join(best, "grp")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(real(c), F.col(f"fill_{c}"))).drop(f"fill_{c}")
    return joined


def record_ref(source: Column, ids: list[Column], title: Column) -> Column:
    """``Source: id``, with the first id there is, else the begin of the title."""
    return F.concat_ws(": ", source, F.coalesce(*[F.nullif(F.trim(i.cast("string")), F.lit("")) for i in ids], F.substring(title, 1, 60)))


def kept(df: DataFrame, reference: Column) -> DataFrame:
    """One row per group, by priority, abstract, latest date and row; merged_from lists the others in that order.

    The survivor is a minimum over small structs (combined map-side) and is fetched by its row id; only rank and
    reference of the others travel.
    """
    # dates are compared as texts, the latest first: characters upside down
    later = F.transform(F.split(F.coalesce("publication_date", F.lit("")), ""), lambda ch: -F.ascii(ch))
    rank = F.struct(priority(F.col("source")).alias("p"), F.col("abstract").isNull().alias("na"), F.col("publication_date").isNull().alias("nd"), F.concat(later, F.array(F.lit(1))).alias("d"), F.col("row_id").alias("r"))
    ranked = df.select("grp", rank.alias("o"), reference.alias("ref"))
    best = ranked.groupBy("grp").agg(F.min("o")["r"].alias("row_id"), F.count("*").alias("n"))
    several = ranked.join(best.where("n > 1").select("grp", F.col("row_id").alias("first_id")), "grp").where("o.r <> first_id")
    trail = several.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "ref"))), lambda x: x["ref"]), "; ").alias("merged_from"))
    return df.join(best.select("row_id"), "row_id", "left_semi").join(trail, "grp", "left")


def verification(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, total_records, unique_records, removed per source, the largest first, and a TOTAL row."""
    counts = before.groupBy("source").agg(F.count("*").alias("total_records")).join(after.groupBy("source").agg(F.count("*").alias("u")), "source", "left")
    rows = counts.select("source", "total_records", F.coalesce("u", F.lit(0)).alias("unique_records"))
    total = rows.agg(F.lit("TOTAL").alias("source"), F.sum("total_records").alias("total_records"), F.sum("unique_records").alias("unique_records"))
    every = rows.withColumn("last", F.lit(0)).unionByName(total.withColumn("last", F.lit(1)))
    return every.withColumn("removed", F.col("total_records") - F.col("unique_records")).orderBy("last", F.desc("total_records"), "source").drop("last")


def distinct_first(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """The first row of each combination of keys, nulls being equal; order_by is unique."""
    first = df.groupBy(*keys).agg(F.min(order_by).alias(order_by)).select(order_by)
    return df.join(first, order_by, "left_semi")
