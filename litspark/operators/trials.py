"""Trial records: canonical form, content hash, typed change events, new and dropped trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the change events.
MAJOR_STATUS = ("TERMINATED", "WITHDRAWN", "SUSPENDED", "COMPLETED", "ACTIVE_NOT_RECRUITING")
EXPLAINED = ("TERMINATED", "WITHDRAWN", "SUSPENDED")
ENROLMENT_SHARE, SLIP_DAYS, NEW_DAYS = 0.2, 90, 30
RECORD = (
    "brief_title string, overall_status string, why_stopped string, phases array<string>, has_results boolean, enrollment_count string, enrollment_type string, completion_date string, "
    "lead_sponsor string, collaborators array<string>, conditions array<string>, countries array<string>, first_post_date string, start_date string, study_type string, n_locations int, "
    "interventions array<struct<name:string,other_names:array<string>,type:string>>, `references` array<struct<pmid:string,type:string>>"
)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(rec: Column) -> Column:
    """The tracked fields with squeezed blanks and sorted, distinct lists."""
    tidy = lambda a: F.array_sort(F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), squeezed)))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(rec["interventions"], F.array().cast("array<struct<name:string,other_names:array<string>,type:string>>")), lambda i: i["name"].isNotNull()), lambda i: squeezed(i["name"]))))
    return F.struct(
        squeezed(rec["brief_title"]).alias("brief_title"), F.upper(F.regexp_replace(F.trim(rec["overall_status"]), r"[\s,-]+", "_")).alias("overall_status"), rec["why_stopped"].alias("why_stopped"), tidy(rec["phases"]).alias("phases"),
        rec["has_results"].alias("has_results"), rec["enrollment_count"].try_cast("int").alias("enrollment_count"), rec["enrollment_type"].alias("enrollment_type"), F.trim(rec["completion_date"]).alias("completion_date"),
        squeezed(rec["lead_sponsor"]).alias("lead_sponsor"), tidy(rec["collaborators"]).alias("collaborators"), tidy(rec["conditions"]).alias("conditions"), names.alias("interventions"), rec["first_post_date"].alias("first_post_date"),
    )


def content_hash(canon: Column) -> Column:
    """sha256 of the canonical record's JSON, nulls included."""
    return F.sha2(F.to_json(canon, {"ignoreNullFields": "false"}), 256)


def day(c: Column) -> Column:
    """A date; a bare month is its 15th."""
    return F.when(F.length(c) == 7, F.concat(c, F.lit("-15"))).otherwise(F.substring(c, 1, 10)).try_cast("date")


def events(old: Column, new: Column) -> Column:
    """The change events between two canonical records: array of (change_type, significance, before, after)."""

    def event(kind: str, significance: Column, when: Column, before: Column, after: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("change_type"), significance.alias("significance"), before.cast("string").alias("before"), after.cast("string").alias("after")))

    so, sn = old["overall_status"], new["overall_status"]
    reason = F.when(sn.isin(*EXPLAINED) & new["why_stopped"].isNotNull(), F.concat(F.lit(" ("), new["why_stopped"], F.lit(")"))).otherwise("")
    eo, en = old["enrollment_count"], new["enrollment_count"]
    typed = (old["enrollment_type"] == "ESTIMATED") & (new["enrollment_type"] == "ACTUAL") & ~eo.eqNullSafe(en)
    moved = ((eo > 0) & en.isNotNull() & (F.abs(en - eo) / eo >= ENROLMENT_SHARE)) | typed
    text = lambda r: F.concat(F.coalesce(r["enrollment_count"].cast("string"), F.lit("?")), F.lit(" ("), F.coalesce(r["enrollment_type"], F.lit("?")), F.lit(")"))
    added = F.array_except(new["interventions"], old["interventions"])
    minor, major = F.lit("minor"), F.lit("major")
    found = F.array(
        event("status_changed", F.when(sn.isin(*MAJOR_STATUS), "major").otherwise("minor"), ~so.eqNullSafe(sn), so, F.concat(F.coalesce(sn, F.lit("")), reason)),
        event("phase_changed", major, old["phases"] != new["phases"], F.to_json(old["phases"]), F.to_json(new["phases"])),
        event("results_posted", major, ~F.coalesce(old["has_results"], F.lit(False)) & F.coalesce(new["has_results"], F.lit(False)), F.lit("false"), F.lit("true")),
        event("enrollment_changed", minor, F.coalesce(moved, F.lit(False)), text(old), text(new)),
        event("completion_slipped", minor, F.coalesce(F.datediff(day(new["completion_date"]), day(old["completion_date"])) > SLIP_DAYS, F.lit(False)), old["completion_date"], new["completion_date"]),
        event("sponsor_changed", minor, F.coalesce((old["lead_sponsor"] != "") & (new["lead_sponsor"] != "") & (old["lead_sponsor"] != new["lead_sponsor"]), F.lit(False)), old["lead_sponsor"], new["lead_sponsor"]),
        event("intervention_added", minor, F.size(added) > 0, F.lit(None), F.to_json(F.array_sort(added))),
    )
    return F.array_compact(found)


def changes(versions: DataFrame) -> DataFrame:
    """Events between consecutive versions of each trial whose content differs.  versions: nct_id, seen, vid, rec (canonical).

    Hashes of the records go through the window; whole records are fetched for the pairs that differ.
    """
    w = Window.partitionBy("nct_id").orderBy("seen", "vid")
    hashed = versions.select("nct_id", "seen", "vid", F.xxhash64(F.to_json("rec")).alias("h"))
    pairs = hashed.withColumn("prev", F.lag(F.struct("seen", "vid", "h")).over(w)).where("prev is not null and prev.h <> h")
    pairs = pairs.select("nct_id", "seen", "vid", F.col("prev.seen").alias("p_seen"), F.col("prev.vid").alias("p_vid"))
    old = versions.select("nct_id", F.col("seen").alias("p_seen"), F.col("vid").alias("p_vid"), F.col("rec").alias("old"))
    differing = pairs.join(versions.select("nct_id", "seen", "vid", "rec"), ["nct_id", "seen", "vid"]).join(old, ["nct_id", "p_seen", "p_vid"])
    rows = differing.select("nct_id", "seen", "vid", F.explode(events(F.col("old"), F.col("rec"))).alias("e"))
    return rows.select(F.concat_ws("-", "nct_id", "vid", "e.change_type").alias("event_id"), "nct_id", "seen", "e.*")


def new_and_dropped(present: DataFrame, snapshots: DataFrame, posted: DataFrame) -> DataFrame:
    """nct_id, snapshot_date, change_type: new where the previous snapshot is complete and the trial was first posted at
    most 30 days before it; dropped where both are complete.  present: snapshot_date, nct_id (distinct); snapshots:
    snapshot_date, complete; posted: nct_id, first_post_date."""
    order = Window.orderBy("snapshot_date")
    pairs = snapshots.withColumn("prev", F.lag("snapshot_date").over(order)).withColumn("prev_ok", F.lag("complete").over(order)).withColumn("next", F.lead("snapshot_date").over(order)).withColumn("next_ok", F.lead("complete").over(order))
    now = present.join(pairs, "snapshot_date")
    keys = present.select(F.col("snapshot_date").alias("d"), F.col("nct_id").alias("n"))
    fresh = now.where("prev is not null and prev_ok = 1").join(keys, (F.col("prev") == F.col("d")) & (F.col("nct_id") == F.col("n")), "left_anti").join(posted, "nct_id")
    fresh = fresh.where(day(F.col("first_post_date")) >= F.date_sub(F.col("prev").cast("date"), NEW_DAYS)).select("nct_id", "snapshot_date", F.lit("new").alias("change_type"))
    gone = now.where("next is not null and complete = 1 and next_ok = 1").join(keys, (F.col("next") == F.col("d")) & (F.col("nct_id") == F.col("n")), "left_anti")
    return fresh.unionByName(gone.select("nct_id", F.col("next").alias("snapshot_date"), F.lit("dropped").alias("change_type")))


def without_contacts(study: Column) -> Column:
    """A nested study record without its contacts, the central ones and those of each place."""
    m = "protocolSection.contactsLocationsModule"
    places = F.transform(study[m.split(".")[0]][m.split(".")[1]]["locations"], lambda x: x.dropFields("contacts"))
    return study.dropFields(f"{m}.centralContacts").withField(f"{m}.locations", places)
