"""Queries of trials, snapshots, the program registry, the event log and streams, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.functions import ids, text
from litspark.operators import evaluate, landscape, logs, registry, tagging, trials
from litspark.plans import vocabulary
from litspark.queries.literature import _CONDITION_VOC, condition_names
from litspark.session import table
from litspark.streaming import logs as streams

KINDS = ["click", "error", "purchase", "signup", "view"]


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trial_version").select(ids.nct_id("nct_id").alias("nct_id"), ids.date_digits("first_seen").alias("seen"), F.col("version_id").alias("vid"), F.from_json("record", trials.RECORD).alias("rec"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).groupBy("nct_id").agg(F.max_by("rec", F.struct("seen", "vid")).alias("rec"))


def change_events(spark: SparkSession, d: str) -> DataFrame:
    """Typed change events between consecutive versions of each trial."""
    v = _versions(spark, d).select("nct_id", "seen", "vid", trials.canonical(F.col("rec")).alias("rec"))
    return trials.changes(v).select("event_id", "nct_id", ids.iso_date("seen").alias("event_date"), "change_type", "significance", "before", "after")


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Status changes with their significance."""
    return change_events(spark, d).where("change_type = 'status_changed'").select("nct_id", "event_date", "significance", "before")


def event_programs(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the programs that the latest version of its trial is linked to for certain."""
    linked = trial_links(spark, d).where("status = 'auto'").groupBy("nct_id").agg(F.sort_array(F.collect_set("axp_id")).alias("axp_ids"))
    return change_events(spark, d).join(linked, "nct_id", "left").select("event_id", "nct_id", F.array_join(F.coalesce("axp_ids", F.array().cast("array<string>")), ";").alias("axp_ids"))


def change_feed(spark: SparkSession, d: str, since: str = "2026-01-01", program: str | None = None, modality: str | None = None, least: str = "minor", limit: int = 200) -> DataFrame:
    """Events since a day, of a program or modality, of a least significance, with the trial's title; the newest first."""
    registry.checked(since=since, least=least, limit=limit, program=program)
    names = {"major": ["major"], "minor": ["major", "minor"], "info": ["major", "minor", "info"]}
    rank = F.when(F.col("significance") == "major", 0).when(F.col("significance") == "minor", 1).otherwise(2)
    found = change_events(spark, d).where(F.col("significance").isin(names[least]) & (F.col("event_date") >= since))
    if program or modality:
        linked = trial_links(spark, d).where("status = 'auto'").select("nct_id", "axp_id")
        wanted = table(spark, d, "program").where(F.lit(True) if program is None else F.col("axp_id") == program).where(F.lit(True) if modality is None else F.lower("modality") == modality.lower())
        found = found.join(linked.join(wanted.select("axp_id"), "axp_id", "left_semi").select("nct_id").distinct(), "nct_id", "left_semi")
    titles = _latest(spark, d).select("nct_id", F.col("rec.brief_title").alias("brief_title"))
    return found.orderBy(F.desc("event_date"), rank, "event_id").limit(limit).join(titles, "nct_id", "left")


def change_feed_vaccines(spark: SparkSession, d: str) -> DataFrame:
    """The latest major events of trials of vaccine programs."""
    return change_feed(spark, d, modality="vaccine", least="major").select("event_id", "nct_id", "brief_title")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Trials by the number of their different canonical records."""
    v = _versions(spark, d).select("nct_id", trials.content_hash(trials.canonical(F.col("rec"))).alias("h"))
    return v.groupBy("nct_id").agg(F.countDistinct("h").alias("n_contents"), F.count("*").alias("n_versions"))


def unseen_versions(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot the versions (trial and hash) that no snapshot before it delivered."""
    o = table(spark, d, "observation").select("snapshot_date", ids.nct_id("nct_id").alias("nct_id"), ids.hex_digest("content_hash").alias("h"))
    return o.groupBy("nct_id", "h").agg(F.min("snapshot_date").alias("snapshot_date")).groupBy("snapshot_date").agg(F.count("*").alias("n"))


def observed_versions(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries per snapshot whose version is stored."""
    o = table(spark, d, "observation").select("snapshot_date", ids.nct_id("nct_id").alias("nct_id"), ids.hex_digest("content_hash").alias("h")).distinct()
    v = table(spark, d, "trial_version").select(ids.nct_id("nct_id").alias("nct_id"), ids.hex_digest("content_hash").alias("h")).distinct()
    return o.join(v, ["nct_id", "h"], "left_semi").groupBy("snapshot_date").agg(F.count("*").alias("n"))


def matched_queries(spark: SparkSession, d: str) -> DataFrame:
    """C4: one row per trial and snapshot with all queries that matched it."""
    q = F.from_json("matched_queries", "array<string>")
    o = table(spark, d, "observation").select("snapshot_date", ids.nct_id("nct_id").alias("nct_id"), F.explode(q).alias("q"))
    # distinct first: a trial delivered very often sends each query once per task
    lists = o.distinct().groupBy("snapshot_date", "nct_id").agg(F.array_join(F.sort_array(F.collect_list("q")), ",").alias("queries"))
    return lists


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first snapshot of each trial."""
    return table(spark, d, "observation").groupBy(ids.nct_id("nct_id").alias("nct_id")).agg(F.min("snapshot_date").alias("first_seen"))


def new_dropped(spark: SparkSession, d: str) -> DataFrame:
    """New and dropped trials per snapshot."""
    present = table(spark, d, "observation").select("snapshot_date", ids.nct_id("nct_id").alias("nct_id")).distinct()
    posted = _versions(spark, d).groupBy("nct_id").agg(F.min("rec.first_post_date").alias("first_post_date"))
    return trials.new_and_dropped(present, table(spark, d, "snapshot").select("snapshot_date", "complete"), posted)


def snapshot_status(spark: SparkSession, d: str) -> DataFrame:
    """Age of each snapshot at the latest one's end, and whether it may stand as current."""
    s = table(spark, d, "snapshot")
    last = s.agg(F.max("finished_at").alias("last"))
    age = F.datediff(F.to_date("last"), F.col("snapshot_date").cast("date"))
    return s.crossJoin(F.broadcast(last)).select("snapshot_date", age.alias("age_days"), F.when((age <= 8) & (F.col("complete") == 1), "current").otherwise("stale").alias("status"))


def trials_tried(spark: SparkSession, d: str) -> DataFrame:
    """Trials with their phase, the most advanced first."""
    t = _latest(spark, d).select("nct_id", text.phase_label(F.col("rec.phases")).alias("phase"), F.col("rec.start_date").alias("start_date"), text.human(F.col("rec.overall_status")).alias("status"))
    return landscape.trials_tried(t).select("nct_id", "phase", "phase_rank", "start_date")


def phase_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Trials per phase label."""
    return landscape.phase_histogram(_latest(spark, d).select(text.phase_label(F.col("rec.phases")).alias("phase")), "phase")


def interventions(spark: SparkSession, d: str) -> DataFrame:
    """Interventions and references of a trial as one text each."""
    iv = F.array_distinct(F.transform("rec.interventions", lambda i: F.concat(F.trim(i["name"]), F.concat(F.lit(" ("), text.human(i["type"]), F.lit(")")))))
    rf = F.array_distinct(F.transform("rec.references", lambda r: F.concat(F.lit("PMID "), F.trim(r["pmid"]), F.lit(" ("), text.human(r["type"]), F.lit(")"))))
    return _latest(spark, d).select("nct_id", F.array_join(iv, "; ").alias("interventions"), F.array_join(rf, "; ").alias("citations"))


def date_labels(spark: SparkSession, d: str) -> DataFrame:
    """start, end and status of each trial in one label."""
    r = lambda n: F.col(f"rec.{n}")
    return _latest(spark, d).select("nct_id", text.join_date_label(r("start_date"), r("completion_date"), r("overall_status")).alias("label"))


def cited_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers that report a trial, with their titles where known."""
    ref = F.explode("rec.references")
    refs = _latest(spark, d).select("nct_id", ref.alias("r")).where("r.type in ('RESULT', 'DERIVED')").select("nct_id", F.col("r.pmid").alias("pmid")).distinct()
    return refs.join(table(spark, d, "paper").select("pmid", "kind"), "pmid", "left")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return registry.alias_rows(table(spark, d, "alias"))


def alias_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names in ASCII."""
    return table(spark, d, "alias").where(F.col("alias").rlike(r"^[\x00-\x7F]*$")).select("alias", text.alias_key("alias").alias("key")).distinct()


def alias_keys_wide(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names beyond ASCII."""
    return table(spark, d, "alias").where(~F.col("alias").rlike(r"^[\x00-\x7F]*$")).select("alias", text.alias_key("alias").alias("key")).distinct()


def _named_texts(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.transform("rec.interventions", lambda i: i["name"]), "; ")
    return _latest(spark, d).select(F.col("nct_id").alias("id"), names.alias("text"))


def window_hits(spark: SparkSession, d: str) -> DataFrame:
    """Programs named inside the interventions of trials."""
    return registry.text_hits(_named_texts(spark, d), _aliases(spark, d)).select("id", "axp_id", "key").distinct()


def evidence_links(spark: SparkSession, d: str) -> DataFrame:
    """Papers that a linked trial cites, and papers that name a program; the best link of each."""
    hits = registry.field_hits(table(spark, d, "paper").select(F.col("pmid").alias("id"), "title"), _aliases(spark, d), ["title"])
    linked = trial_links(spark, d).where("status = 'auto'").select("nct_id", "axp_id")
    cited = cited_papers(spark, d).join(linked, "nct_id").groupBy("axp_id", F.col("pmid").alias("ident")).agg(F.max("nct_id").alias("nct_id"))
    return registry.evidence_links(hits, cited)


def grant_links(spark: SparkSession, d: str) -> DataFrame:
    """Grants that name a program in title or abstract."""
    grants = table(spark, d, "articles").where(F.lower(F.trim("source")).isin("nih", "nsf")).select(F.col("article_id").alias("id"), "title", "abstract")
    return registry.field_hits(grants, _aliases(spark, d), ["title", "abstract"]).where("status is not null").select("id", "axp_id", "key", "field", "status")


def paper_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Papers by the kind that their publication type makes them."""
    return table(spark, d, "paper").groupBy(registry.paper_kind(F.array("kind")).alias("kind")).agg(F.count("*").alias("n"))


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """What the typed names and the ids of the registry stand for."""
    typed = table(spark, d, "intake_name").where("trim(typed_name) <> ''").select(F.col("typed_name").alias("query"))
    return registry.resolve_names(typed.unionByName(table(spark, d, "program").select(F.col("axp_id").alias("query"))), table(spark, d, "program"), _aliases(spark, d))


def _chip_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Unambiguous names of active programs."""
    active = table(spark, d, "program").where("status = 'active'").select("axp_id")
    return _aliases(spark, d).where("ambiguous = 0").where(F.length("key") >= registry.MIN_KEY).join(active, "axp_id", "left_semi")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """id, title, abstract, kind of articles and of trials, whose interventions stand for an abstract."""
    src = F.lower(F.coalesce("source", F.lit("")))
    kind = F.when(src.contains("clinicaltrials"), "trial").when(src.rlike("nih|nsf|reporter"), "grant").when(src.rlike("biorxiv|medrxiv|preprint"), "preprint").otherwise("paper")
    a = table(spark, d, "articles").select(F.col("article_id").cast("string").alias("id"), "title", "abstract", kind.alias("kind"))
    names = F.array_join(F.transform("rec.interventions", lambda i: i["name"]), "; ")
    return a.unionByName(_latest(spark, d).select(F.col("nct_id").alias("id"), F.col("rec.brief_title").alias("title"), names.alias("abstract"), F.lit("trial").alias("kind")))


def result_chips(spark: SparkSession, d: str) -> DataFrame:
    """Up to three programs that each article or trial names."""
    return registry.chips(_records(spark, d), _chip_aliases(spark, d)).select("id", "axp_id", "place")


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """axp_id, stage, n_trials: what the certain trials of a program say."""
    linked = trial_links(spark, d).where("status = 'auto'").select("nct_id", "axp_id")
    phases = _latest(spark, d).select("nct_id", F.col("rec.phases").alias("phases"))
    found = linked.join(phases, "nct_id").groupBy("axp_id").agg(F.countDistinct("nct_id").alias("n_trials"), F.array_distinct(F.flatten(F.collect_set("phases"))).alias("phases"))
    return found.select("axp_id", "n_trials", registry.stage_label(F.col("phases"), F.lit(False)).alias("stage"))


def trial_links(spark: SparkSession, d: str) -> DataFrame:
    """The best link of each trial and program."""
    names = F.flatten(F.transform("rec.interventions", lambda i: F.concat(F.array(i["name"]), F.coalesce(i["other_names"], F.array().cast("array<string>")))))
    t = _latest(spark, d).select("nct_id", F.col("rec.brief_title").alias("brief_title"), F.col("rec.lead_sponsor").alias("lead_sponsor"), F.col("rec.collaborators").alias("collaborators"), names.alias("names"))
    return registry.trial_links(t, _aliases(spark, d), table(spark, d, "program"))


_ASCII_KEY = "^[A-Z0-9]+$"


def _name_links(spark: SparkSession, d: str) -> DataFrame:
    """Interventions whose whole name is an alias, whatever its letters."""
    t = _latest(spark, d).select("nct_id", F.explode("rec.interventions").alias("i")).select("nct_id", text.alias_key("i.name").alias("key"))
    return t.join(_aliases(spark, d), "key").select("nct_id", "axp_id", "key")


def intervention_links(spark: SparkSession, d: str) -> DataFrame:
    """Interventions whose whole name is an alias in ASCII."""
    return _name_links(spark, d).where(F.col("key").rlike(_ASCII_KEY)).select("nct_id", "axp_id").distinct()


def intervention_links_wide(spark: SparkSession, d: str) -> DataFrame:
    """Interventions whose whole name is an alias beyond ASCII."""
    return _name_links(spark, d).where(~F.col("key").rlike(_ASCII_KEY)).select("nct_id", "axp_id").distinct()


def program_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Replaced programs followed to the one that stands."""
    return registry.survivors(table(spark, d, "program"))


def registry_totals(spark: SparkSession, d: str) -> DataFrame:
    """Programs, active ones, viruses, names and trials that are linked for certain, in one row."""
    p = table(spark, d, "program").agg(F.count("*").alias("programs"), F.count_if(F.col("status") == "active").alias("active"))
    v = table(spark, d, "virus").agg(F.count("*").alias("viruses"))
    a = table(spark, d, "alias").agg(F.countDistinct("alias").alias("names"))
    t = trial_links(spark, d).where("status = 'auto'").agg(F.countDistinct("nct_id").alias("linked_trials"))
    return p.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(t))


def program_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each active program with its stage and the trials linked to it for certain."""
    p = table(spark, d, "program").where("status = 'active'").select("axp_id", "preferred_name")
    return p.join(_stages(spark, d), "axp_id", "left").select("axp_id", "preferred_name", F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("n_trials", F.lit(0)).alias("n_trials"))


def program_names(spark: SparkSession, d: str) -> DataFrame:
    """Up to three names of each program, by type."""
    rank = F.when(F.col("alias_type") == "inn", 0).when(F.col("alias_type") == "brand", 1).when(F.col("alias_type") == "code", 2).otherwise(3)
    a = table(spark, d, "alias").where("ambiguous = 0").groupBy("axp_id", "alias").agg(F.min(rank).alias("rk"))
    top = F.slice(F.array_sort(F.collect_list(F.struct("rk", "alias"))), 1, 3)
    return a.groupBy("axp_id").agg(F.array_join(F.transform(top, lambda x: x["alias"]), "; ").alias("names"))


# Roles in the order in which a family lists them.
ROLES = ["oncolytic", "in_vivo_gene_transfer", "ex_vivo_gene_transfer", "vaccine_vector"]


def grouped_listing(spark: SparkSession, d: str) -> DataFrame:
    """Active programs by virus family and role, in order, and those without a virus by modality."""
    p = table(spark, d, "program").where("status = 'active'").select("axp_id", "modality")
    v = table(spark, d, "virus").select("axp_id", "virus_family", "vector_role")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("vector_role")), F.lit(0))
    grp = F.coalesce("virus_family", F.concat(F.lit("by modality: "), F.coalesce("modality", F.lit("none"))))
    rows = p.join(v, "axp_id", "left").select("axp_id", grp.alias("grp"), F.coalesce("vector_role", F.lit("")).alias("vector_role"), F.when(place > 0, place).otherwise(99).cast("int").alias("place"))
    return rows.groupBy("grp", "place", "vector_role").agg(F.countDistinct("axp_id").alias("n")).orderBy("grp", "place")


DISEASES = {"Glioma": ["glioma", "glioblastoma"], "Carcinoma": ["carcinoma"], "Haemophilia": ["haemophilia", "hemophilia"]}


def disease_view(spark: SparkSession, d: str, views: dict[str, list[str]] | None = None) -> DataFrame:
    """Per view the active programs with a certain trial whose conditions or title name it, and these trials."""
    views = DISEASES if views is None else views
    linked = trial_links(spark, d).where("status = 'auto'").select("nct_id", "axp_id").join(table(spark, d, "program").where("status = 'active'").select("axp_id"), "axp_id", "left_semi")
    named = lambda terms: lambda c: reduce(lambda x, y: x | y, [F.lower(c).contains(t) for t in terms])
    of = F.array_compact(F.array(*[F.when(F.exists(F.coalesce("rec.conditions", F.array().cast("array<string>")), named(t)) | F.coalesce(named(t)(F.col("rec.brief_title")), F.lit(False)), F.lit(v)) for v, t in views.items()]))
    t = _latest(spark, d).select("nct_id", F.explode(of).alias("disease"))
    return t.join(linked, "nct_id").groupBy("disease").agg(F.countDistinct("axp_id").alias("n_programs"), F.countDistinct("nct_id").alias("n_trials"))


# Cancers that conditions or titles name, with fragments; the first label that fits counts.
INDICATIONS = [
    ("Melanoma", ["melanom"]),
    ("Glioma and brain", ["gliom", "glioblastom", "astrocytom", "brain tumo", "brain cancer", "ependymom",
                          "medulloblastom", "dipg", "central nervous system"]),
    ("Neuroblastoma", ["neuroblastom"]),
    ("Bladder", ["bladder", "urothel"]),
    ("Liver", ["hepatocell", "liver", "hepatic", "hcc"]),
    ("Pancreatic", ["pancrea"]),
    ("Head and neck", ["head and neck", "oral cavity", "oropharyn", "nasopharyn", "laryn", "hypopharyn",
                       "squamous cell carcinoma of the head"]),
    ("Lung", ["lung", "nsclc", "sclc"]),
    ("Mesothelioma", ["mesotheliom"]),
    ("Breast", ["breast"]),
    ("Colorectal", ["colorect", "colon", "rectal"]),
    ("Gastric and oesophageal", ["gastric", "stomach", "esophag", "oesophag", "gastroesophag"]),
    ("Prostate", ["prostat"]),
    ("Ovarian", ["ovar", "fallopian"]),
    ("Kidney", ["renal cell", "kidney"]),
    ("Sarcoma", ["sarcom"]),
    ("Peritoneal", ["periton"]),
    ("Blood cancers", ["myeloma", "lymphoma", "leukemi", "leukaemi"]),
    ("Solid tumours (any)", ["solid tumor", "solid tumour", "advanced cancer", "metastatic cancer",
                             "advanced malignan", "solid malignan", "neoplasms"]),
]


def indication_groups(spark: SparkSession, d: str) -> DataFrame:
    """Trials by the indications of their conditions and title, sorted, each the first that fits a text."""
    def label(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, fragments in reversed(INDICATIONS):
            out = F.when(F.lower(c).rlike("|".join(fragments)), name).otherwise(out)
        return out

    texts = F.concat(F.coalesce("rec.conditions", F.array().cast("array<string>")), F.array("rec.brief_title"))
    labels = F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.transform(texts, label)))), "; ")
    return _latest(spark, d).groupBy(labels.alias("labels")).agg(F.count("*").alias("n"))


def program_graph(spark: SparkSession, d: str) -> DataFrame:
    """Hubs of the program graph with their degree."""
    return registry.graph(table(spark, d, "program"), table(spark, d, "virus"))[0]


def program_graph_links(spark: SparkSession, d: str) -> DataFrame:
    """G1: links of the program graph."""
    return registry.graph(table(spark, d, "program"), table(spark, d, "virus"))[1]


def link_review(spark: SparkSession, d: str) -> DataFrame:
    """Links that wait for a review, with program and trial or paper, in one list."""
    p = table(spark, d, "program").select("axp_id", "preferred_name")
    t = trial_links(spark, d).where("status = 'candidate'").join(_latest(spark, d).select("nct_id", F.col("rec.brief_title").alias("title")), "nct_id", "left").select(F.lit("trial").alias("kind"), "axp_id", F.col("nct_id").alias("ref"), "title")
    e = evidence_links(spark, d).where("status = 'candidate'").join(table(spark, d, "paper").select(F.col("pmid").alias("ident"), "title"), "ident", "left").select(F.lit("paper").alias("kind"), "axp_id", F.col("ident").alias("ref"), "title")
    return t.unionByName(e).join(p, "axp_id").orderBy("kind", "axp_id", "ref")


def program_cards(spark: SparkSession, d: str) -> DataFrame:
    """Programs by the articles, grants, preprints and trials that name them, the most named first."""
    records = _records(spark, d)
    named = registry.chips(records, _chip_aliases(spark, d)).join(records.select("id", "kind"), "id")
    programs = table(spark, d, "program").where("status = 'active'").select("axp_id", "preferred_name").join(_stages(spark, d), "axp_id", "left").withColumn("stage", F.coalesce("stage", F.lit("")))
    return registry.cards(named, programs)


def dq_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the registry that break a rule."""
    p, a, v = table(spark, d, "program"), table(spark, d, "alias"), table(spark, d, "virus")
    keys = p.select("axp_id")
    return registry.violations({
        "program_id_format": p.where(~F.col("axp_id").rlike("^AXP[0-9]{6}$")).select("axp_id"),
        "merged_without_target": p.where("status = 'merged' and replaced_by is null").select("axp_id"),
        "bad_created": p.where(~F.coalesce(F.col("created").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))).select("axp_id"),
        "alias_without_program": a.join(keys, "axp_id", "left_anti").select("axp_id"),
        "virus_without_program": v.join(keys, "axp_id", "left_anti").select("axp_id"),
        "alias_key_missing": a.where("alias_key is null").select("alias"),
        "alias_repeated": a.groupBy("axp_id", "alias").count().where("count > 1").select("alias"),
    })


def taxon_deepest(spark: SparkSession, d: str) -> DataFrame:
    """The deepest anchor in each supplier's path."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = s.select(F.col("s_suppkey").alias("id"), F.array("r_name", "n_name", "s_name").alias("path"))
    anchors = table(spark, d, "region").select(F.col("r_name").alias("taxon"), F.col("r_name").alias("category")).unionAll(table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_name", "n_name"))
    return evaluate.deepest(paths, anchors)


def grant_rollup(spark: SparkSession, d: str) -> DataFrame:
    """First and last year per order and the attributes of its latest line."""
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return evaluate.rollup_latest(li, "l_orderkey", ["year", "l_linenumber", "l_partkey", "l_suppkey"], "year", ["l_returnflag"])


def log_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type."""
    return logs.daily_pivot(table(spark, d, "events"), "ts", "event_type", KINDS)


def log_clients(spark: SparkSession, d: str) -> DataFrame:
    """Events, searches, sessions, first and last event per client and channel."""
    e = table(spark, d, "events")
    client = logs.normal_client(F.concat(F.lit("ua:client-"), (F.col("user_id") % 7).cast("string")), {"ua:client-0": "connector"})
    return logs.clients(e, client, "event_type", F.col("event_type") == "view", "user_id", "ts")


def log_quality(spark: SparkSession, d: str) -> DataFrame:
    """Number, empty share, median and 90th percentile."""
    return logs.quality(table(spark, d, "events").where("event_type = 'view'"), F.col("value") < 5, "value")


def log_sources(spark: SparkSession, d: str) -> DataFrame:
    """Packed source counts packed and unpacked again."""
    e = table(spark, d, "events")
    packed = logs.packed_counts(F.create_map(F.lit("EPMC"), F.col("user_id") % 5, F.lit("CORE"), F.get_json_object("props", "$.k").cast("long")))
    return logs.source_counts(e.select(packed.alias("sources")), "sources")


def log_recent(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last thirty days by type."""
    return logs.within_days(table(spark, d, "events"), "ts", 30).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: events per day and type."""
    return streams.drain(streams.daily_counts(streams.read_stream(spark, d, "events"), "event_type"), "update", ["day", "event_type"])


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: sessions of each user."""
    return streams.drain(streams.sessions(streams.read_stream(spark, d, "events"), "user_id")).select("user_id", "started", "n")


def stream_rate(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: events per sliding minute and type, the busiest windows."""
    return streams.drain(streams.sliding_rate(streams.read_stream(spark, d, "events"), "event_type"), "update", ["started", "event_type"]).groupBy("event_type").agg(F.max("n").alias("peak"))


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: change events of trial versions, the last version of each trial being the state."""
    v = streams.read_stream(spark, d, "trial_version").select(ids.nct_id("nct_id").alias("nct_id"), ids.date_digits("first_seen").alias("seen"), F.col("version_id").alias("vid"), trials.canonical(F.from_json("record", trials.RECORD)).alias("rec"))
    kind = v.schema["rec"].dataType
    pairs = streams.version_pairs(v.withColumn("rec", F.to_json("rec", {"ignoreNullFields": "false"})))
    typed = streams.drain(pairs, "append").withColumn("old", F.from_json("old", kind)).withColumn("new", F.from_json("new", kind))
    rows = typed.select("nct_id", "seen", "vid", F.explode(trials.events(F.col("old"), F.col("new"))).alias("e"))
    return rows.select(F.concat_ws("-", "nct_id", "vid", "e.change_type").alias("event_id"), "nct_id", "e.change_type", "e.significance", "e.before", "e.after")


def condition_categories(spark: SparkSession, d: str) -> DataFrame:
    """The last words that several conditions share as categories, and each condition mapped to the longest that fits."""
    stated = condition_names(spark, d)
    generic = vocabulary.from_table("condition", stated.where("not contains(name, ' ') and name = lower(name)"), "category", "name")
    return tagging.longest_category(stated.select(F.col("name").alias("label")), "label", generic, "category")


def text_references(spark: SparkSession, d: str) -> DataFrame:
    """Trials, papers and addresses that documents name."""
    return registry.references_in(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "ref")


def clean_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Press names that no other source has and only one program claims."""
    a = table(spark, d, "alias").select("axp_id", F.lower("alias").alias("k"), "source").distinct()
    return registry.accept_clean(a.where("source = 'press'").select("axp_id", "k"), a.where("source <> 'press'"), "k")


def query_members(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries per snapshot that one query matched."""
    o = table(spark, d, "observation").where(F.array_contains(F.from_json("matched_queries", "array<string>"), "cart"))
    return o.groupBy("snapshot_date").agg(F.count("*").alias("n"))


def _of_vaccines(spark: SparkSession, d: str, links: DataFrame) -> DataFrame:
    vaccine = table(spark, d, "program").where("modality = 'vaccine'").select("axp_id")
    return links.join(vaccine, "axp_id", "left_semi").select("nct_id").distinct()


def modality_trials(spark: SparkSession, d: str) -> DataFrame:
    """Trials with an intervention of a vaccine program, named in ASCII."""
    return _of_vaccines(spark, d, intervention_links(spark, d))


def modality_trials_wide(spark: SparkSession, d: str) -> DataFrame:
    """Trials with an intervention of a vaccine program, named beyond ASCII."""
    return _of_vaccines(spark, d, intervention_links_wide(spark, d))


def snapshot_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive snapshots, their distance in days, and the day from which the next one would be fetched."""
    w = Window.orderBy("snapshot_date")
    s = table(spark, d, "snapshot").select("snapshot_date", F.lag("snapshot_date").over(w).alias("prev"))
    day = F.col("snapshot_date").cast("date")
    return s.select("snapshot_date", "prev", F.datediff(day, F.col("prev").cast("date")).alias("days"), F.date_add(day, 1).cast("string").alias("next_from"))


def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    """Major events of each week by program (those of no program under an empty id, last), minor ones by type."""
    week = F.date_trunc("week", F.col("event_date").cast("timestamp")).cast("date").cast("string")
    e = change_events(spark, d).select("event_id", "nct_id", week.alias("week"), "change_type", "significance")
    linked = trial_links(spark, d).where("status = 'auto'").select("nct_id", "axp_id")
    major = e.where("significance = 'major'").join(linked, "nct_id", "left").select("week", F.coalesce("axp_id", F.lit("")).alias("grp"), "significance", "event_id")
    minor = e.where("significance = 'minor'").select("week", F.col("change_type").alias("grp"), "significance", "event_id")
    counts = major.unionByName(minor).groupBy("week", "significance", "grp").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("week"), "significance", F.col("grp") == "", F.desc("n"), "grp")


def searchable_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs with a fragment in any of their names or fields."""
    names = table(spark, d, "alias").groupBy("axp_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), " ").alias("names"))
    p = table(spark, d, "program").join(names, "axp_id", "left")
    return p.where(F.lower(F.concat_ws(" ", "preferred_name", "modality", "platform", "sponsor", "names")).contains("gene")).select("axp_id")


# ---- SQL ----------------------------------------------------------------------------------------------------------

_N = "'NCT' || regexp_extract(upper(nct_id), 'NCT[^0-9A-Z]*([0-9]{8})', 1)"
_H = "regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+:', '')"
_S = "rpad(regexp_replace(first_seen, '[^0-9]', '', 'g'), 14, '0')"
_LATEST = f"with l as (select {_N} k, arg_max(record, ({_S}, version_id)) r from trial_version group by 1)"
_PHASES = "nullif(array_to_string(list_transform(list_filter(from_json(r->'phases', '[\"VARCHAR\"]'), lambda p: upper(trim(p)) not in ('', 'NA')), lambda p: case when p = 'EARLY_PHASE1' then 'Early Phase 1' else 'Phase ' || p[6:6] end), '/'), '')"
_KEY = "regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _sql_plain(c: str) -> str:
    """Marks dropped, full width and the increment sign in plain form."""
    return f"translate(replace(regexp_replace({c}, '[®™©]', '', 'g'), '∆', 'Δ'), '{_WIDE}', '{_NARROW}')"


def _sql_key(c: str) -> str:
    return f"regexp_replace(upper({_sql_plain(c)}), '[^\\pL\\pN]', '', 'g')"


def _sql_windows(rows: str) -> str:
    """SQL of (id, key): the windows of four characters or more of rows with id and text."""
    return f"""select distinct id, array_to_string(w[i:i + n - 1], '') key from (select id, w, unnest(range(1, len(w) + 1)) i from (select id, regexp_extract_all(upper({_sql_plain('text')}), '[\\pL\\pN]+') w from ({rows}) where text is not null)), range(1, 9) r(n)
 where i + n - 1 <= len(w) and length(array_to_string(w[i:i + n - 1], '')) >= 4"""


_AL = f"al as (select distinct axp_id, {_sql_key('alias')} key, alias, alias_type ty, ambiguous amb from alias where {_sql_key('alias')} <> '')"
_NAMED_SQL = "ty in ('preferred', 'inn', 'usan', 'brand') and length(key) >= 5"
_ORG_SQL = "list_filter(list_transform(string_split_regex(upper(coalesce({c}, '')), '[;/(),]'), lambda p: list_filter(string_split(trim(regexp_replace(p, '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' and w not in (" + ", ".join(f"'{w}'" for w in registry.ORG_WORDS) + "))), lambda w: length(array_to_string(w, '')) >= 5)"
_ORGS_SQL = "list_transform(" + _ORG_SQL + ", lambda w: ' ' || array_to_string(w, ' ') || ' ')"
_LINKS = f"""{_LATEST}, {_AL},
tn as (select k, unnest(from_json(r->'interventions', '[{{"name":"VARCHAR","other_names":["VARCHAR"]}}]')) i from l), nm as (select k id, i.name as text from tn union all select k, unnest(i.other_names) from tn),
off as (select distinct id k, axp_id, key, ty, amb, 'intervention_name' m from (select id, {_sql_key('text')} key from nm where text is not null) join al using (key)
 union select id, axp_id, key, ty, amb, 'intervention_text' from ({_sql_windows('select * from nm')}) join al using (key)
 union select id, axp_id, key, ty, amb, 'title' from ({_sql_windows("select k id, r->>'brief_title' as text from l")}) join al using (key)),
og as (select axp_id, list_concat({_ORGS_SQL.format(c='sponsor')}, {_ORGS_SQL.format(c='originator')}) mine from program),
th as (select k, flatten(list_transform(list_prepend(r->>'lead_sponsor', coalesce(from_json(r->'collaborators', '["VARCHAR"]'), [])), lambda c: {_ORGS_SQL.format(c='c')})) theirs from l),
ag as (select distinct a.k, a.axp_id from (select k, axp_id, unnest(mine) o from (select distinct k, axp_id from off) join og using (axp_id)) a join (select k, unnest(theirs) t from th) b on a.k = b.k and (contains(t, o) or (contains(o, t) and length(replace(t, ' ', '')) >= 8))),
ti as (select distinct k tk, key tkey from off where m = 'title'),
sc as (select off.k, off.axp_id, m, case m when 'intervention_name' then 0.95 when 'intervention_text' then 0.8 else 0.6 end conf,
 case when amb = 1 then m <> 'title' and ag.k is not null when m = 'intervention_name' then true when m = 'intervention_text' then ({_NAMED_SQL}) or tk is not null or ag.k is not null else {_NAMED_SQL} end auto
 from off left join ag on ag.k = off.k and ag.axp_id = off.axp_id left join ti on tk = off.k and tkey = off.key),
links as (select k as nct_id, axp_id, arg_max(m, (auto::int, conf, m)) as method, max((auto::int, conf))[2] as confidence, case when bool_or(auto) then 'auto' else 'candidate' end as status from sc group by k, axp_id)"""
_WRITTEN = "(length(key) > 5 or regexp_matches({t}, '(?i)(^|[^\\pL\\pN])' || array_to_string(regexp_extract_all({a}, '[\\pL\\pN]'), '[\\-‐-―_./]*') || '($|[^\\pL\\pN])') or regexp_matches({t}, '(^|[^\\pL\\pN])' || array_to_string(regexp_extract_all({a}, '[\\pL\\pN]'), '[\\s\\-‐-―_./]*') || '($|[^\\pL\\pN])'))".format(t=_sql_plain("text"), a=_sql_plain("alias"))
_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_CITED = """cp as (select distinct k, e.pmid pmid from (select k, unnest(from_json(r->'references', '[{"pmid":"VARCHAR","type":"VARCHAR"}]')) e from l) where e.type in ('RESULT', 'DERIVED'))"""


def _sql_hits(rows: str) -> str:
    """SQL of (id, axp_id, key, alias, ty, amb): names found in rows of id and text, as they are written."""
    return f"select h.* from (select w.id, al.* from ({_sql_windows(rows)}) w join al using (key)) h join ({rows}) t using (id) where {_WRITTEN}"


_STAGE_SQL = "case when regexp_matches(ph, '(^|[^A-Z_])PHASE4') then 'phase 4' when regexp_matches(ph, '(^|[^A-Z_])PHASE3') then 'phase 3' when regexp_matches(ph, '(^|[^A-Z_])PHASE2') then 'phase 2' when regexp_matches(ph, '(^|[^A-Z_])PHASE1') then 'phase 1' when contains(ph, 'EARLY_PHASE1') then 'early phase 1' else '' end"
_STAGES_SQL = f"stg as (select axp_id, n_trials, {_STAGE_SQL} stage from (select axp_id, count(distinct k) n_trials, upper(string_agg(array_to_string(from_json(r->'phases', '[\"VARCHAR\"]'), ' '), ' ')) ph from links join l on l.k = nct_id where status = 'auto' group by 1))"
_CHIP_AL = f"ca as (select al.* from al join program using (axp_id) where status = 'active' and amb = 0 and length(key) >= 4)"
_REC = """rec as (select article_id::varchar id, title, abstract, case when contains(lower(source), 'clinicaltrials') then 'trial' when regexp_matches(lower(source), 'nih|nsf|reporter') then 'grant' when regexp_matches(lower(source), 'biorxiv|medrxiv|preprint') then 'preprint' else 'paper' end kind from articles
 union all select k, r->>'brief_title', array_to_string(list_transform(from_json(r->'interventions', '[{"name":"VARCHAR"}]'), lambda i: i.name), '; '), 'trial' from l)"""


def _sql_chips(field: str, least: int, bonus: int) -> str:
    hits = _sql_hits(f"select id, {field} as text from rec").replace(" al.*", " ca.*").replace("join al using", "join ca using")
    return f"select id, axp_id, length(key) + {bonus} rk from ({hits}) where ({_NAMED_SQL}) or length(key) >= {least}"


_CHIPS = f"""ch as (select id, axp_id, max(rk) rk from ({_sql_chips('title', 4, 1000)} union all {_sql_chips('abstract', 6, 0)}) group by 1, 2),
cp3 as (select *, row_number() over (partition by id order by rk desc, axp_id desc) place from ch)"""
_SPLIT_SQL = "select axp_id, trim(replace(unnest(string_split_regex(coalesce({c}, ''), '\\s*[;,/|]\\s*')), '\"', '')) h from {t}"
_GRAPH_SQL = f"""with tg as (select * from ({_SPLIT_SQL.format(c='targets', t='program')}) where h <> ''), gn as (select distinct * from ({_SPLIT_SQL.format(c='transgenes', t='virus')}) where h <> ''),
lone as (select h from gn group by h having count(*) = 1 and h in (select h from tg)),
lk as (select distinct * from (select axp_id, 'modality' as kind, modality as hub from program union all select axp_id, 'platform', platform from program union all select axp_id, 'family', virus_family from virus union all select axp_id, 'target', h from tg
 union all select axp_id, case when h in (select h from lone) then 'target' else 'transgene' end, h from gn) where trim(hub) <> ''),
deg as (select kind, hub, count(*) as degree from lk group by 1, 2 having count(*) >= 2 or kind = 'family')"""
_LIST_SQL = "list_sort(list_distinct(list_transform(coalesce(from_json(r->'{f}', '[\"VARCHAR\"]'), []), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))))"
_EVENTS = f"""ver as (select {_N} k, {_S} s, version_id i, record r from trial_version),
can as (select k, s, i, upper(regexp_replace(trim(r->>'overall_status'), '[\\s,-]+', '_', 'g')) st, r->>'why_stopped' why, {_LIST_SQL.format(f='phases')} ph, coalesce((r->>'has_results')::boolean, false) res, try_cast(r->>'enrollment_count' as int) en, r->>'enrollment_type' ty,
 trim(r->>'completion_date') cd, trim(regexp_replace(r->>'lead_sponsor', '\\s+', ' ', 'g')) sp, list_sort(list_distinct(list_transform(list_filter(coalesce(from_json(r->'interventions', '[{{"name":"VARCHAR"}}]'), []), lambda x: x.name is not null), lambda x: trim(regexp_replace(x.name, '\\s+', ' ', 'g'))))) iv,
 trim(regexp_replace(r->>'brief_title', '\\s+', ' ', 'g')) bt, {_LIST_SQL.format(f='collaborators')} co, {_LIST_SQL.format(f='conditions')} cn, r->>'first_post_date' fp from ver),
prv as (select *, lag((st, why, ph, res, en, ty, cd, sp, iv)) over w q, lag(st) over w ost, lag(ph) over w oph, lag(res) over w ores, lag(en) over w oen, lag(ty) over w oty, lag(cd) over w ocd, lag(sp) over w osp, lag(iv) over w oiv, row_number() over w n from can window w as (partition by k order by s, i)),
ev as (select k, s, i, 'status_changed' t, case when st in ('TERMINATED','WITHDRAWN','SUSPENDED','COMPLETED','ACTIVE_NOT_RECRUITING') then 'major' else 'minor' end g, ost b, coalesce(st, '') || case when st in ('TERMINATED','WITHDRAWN','SUSPENDED') and why is not null then ' (' || why || ')' else '' end a from prv where n > 1 and st is distinct from ost
 union all select k, s, i, 'phase_changed', 'major', to_json(oph)::varchar, to_json(ph)::varchar from prv where n > 1 and ph <> oph
 union all select k, s, i, 'results_posted', 'major', 'false', 'true' from prv where n > 1 and res and not ores
 union all select k, s, i, 'enrollment_changed', 'minor', coalesce(oen::varchar, '?') || ' (' || coalesce(oty, '?') || ')', coalesce(en::varchar, '?') || ' (' || coalesce(ty, '?') || ')' from prv where n > 1 and coalesce((oen > 0 and en is not null and abs(en - oen) / oen >= 0.2) or (oty = 'ESTIMATED' and ty = 'ACTUAL' and en is distinct from oen), false)
 union all select k, s, i, 'completion_slipped', 'minor', ocd, cd from prv where n > 1 and try_cast(case when length(cd) = 7 then cd || '-15' else cd[1:10] end as date) - try_cast(case when length(ocd) = 7 then ocd || '-15' else ocd[1:10] end as date) > 90
 union all select k, s, i, 'sponsor_changed', 'minor', osp, sp from prv where n > 1 and osp <> '' and sp <> '' and osp <> sp
 union all select k, s, i, 'intervention_added', 'minor', null, to_json(list_sort(list_filter(iv, lambda x: not list_contains(oiv, x))))::varchar from prv where n > 1 and len(list_filter(iv, lambda x: not list_contains(oiv, x))) > 0),
evs as (select k || '-' || i || '-' || t as event_id, k as nct_id, s[1:4] || '-' || s[5:6] || '-' || s[7:8] as event_date, t as change_type, g as significance, b as before, a as after from ev)"""

SQL = {
    "status_changes": f"""with v as (select {_N} k, {_S} s, version_id, upper(regexp_replace(trim(record->>'overall_status'), '[\\s,-]+', '_', 'g')) st from trial_version),
p as (select *, lag(st) over w ps, row_number() over w rn from v window w as (partition by k order by s, version_id))
select k as nct_id, s[1:4] || '-' || s[5:6] || '-' || s[7:8] as event_date, case when st in ('TERMINATED','WITHDRAWN','SUSPENDED','COMPLETED','ACTIVE_NOT_RECRUITING') then 'major' else 'minor' end as significance, ps as before from p where rn > 1 and st is distinct from ps""",
    "unseen_versions": f"select snapshot_date, count(*) as n from (select {_N} k, {_H} h, min(snapshot_date) snapshot_date from observation group by 1, 2) group by 1",
    "alias_keys_wide": f"select distinct alias, {_sql_key('alias')} as key from alias where not regexp_full_match(alias, '[\\x00-\\x7F]*')",
    "intervention_links_wide": f"{_LATEST}, {_AL}, x as (select k, unnest(from_json(r->'interventions', '[{{\"name\":\"VARCHAR\"}}]')) e from l) select distinct k as nct_id, axp_id from x join al on al.key = {_sql_key('e.name')} where not regexp_full_match(al.key, '[A-Z0-9]+')",
    "modality_trials_wide": f"{_LATEST}, {_AL}, x as (select k, unnest(from_json(r->'interventions', '[{{\"name\":\"VARCHAR\"}}]')) e from l) select distinct k as nct_id from x join al on al.key = {_sql_key('e.name')} where not regexp_full_match(al.key, '[A-Z0-9]+') and axp_id in (select axp_id from program where modality = 'vaccine')",
    "change_events": f"with {_EVENTS} select * from evs",
    "change_feed": f"{_LATEST}, {_EVENTS} select evs.*, r->>'brief_title' as brief_title from (select * from evs where significance in ('major', 'minor') and event_date >= '2026-01-01' order by event_date desc, case significance when 'major' then 0 when 'minor' then 1 else 2 end, event_id limit 200) evs left join l on l.k = nct_id",
    "change_feed_vaccines": f"{_LINKS}, {_EVENTS} select event_id, nct_id, r->>'brief_title' as brief_title from (select * from evs where significance = 'major' and event_date >= '2026-01-01' and nct_id in (select nct_id from links join program using (axp_id) where links.status = 'auto' and lower(modality) = 'vaccine') order by event_date desc, event_id limit 200) join l on l.k = nct_id",
    "event_programs": f"{_LINKS}, {_EVENTS} select event_id, evs.nct_id as nct_id, coalesce(ids, '') as axp_ids from evs left join (select nct_id, string_agg(distinct axp_id, ';' order by axp_id) ids from links where status = 'auto' group by 1) x using (nct_id)",
    "weekly_digest": f"{_LINKS}, {_EVENTS}, wk as (select *, date_trunc('week', event_date::date)::date::varchar w from evs) select w as week, significance, coalesce(axp_id, '') as grp, count(*) as n from wk left join (select nct_id, axp_id from links where status = 'auto') x using (nct_id) where significance = 'major' group by 1, 2, 3 union all select w, significance, change_type, count(*) from wk where significance = 'minor' group by 1, 2, 3",
    "content_hashes": f"with {_EVENTS} select k as nct_id, count(distinct (bt, st, coalesce(why, '~'), ph, coalesce(res, false), coalesce(en, -1), coalesce(ty, '~'), coalesce(cd, '~'), coalesce(sp, '~'), co, cn, iv, coalesce(fp, '~'))) as n_contents, count(*) as n_versions from can group by 1",
    "window_hits": f"{_LATEST}, {_AL} select distinct id, axp_id, key from ({_sql_windows("select k id, array_to_string(list_transform(from_json(r->'interventions', '[{\"name\":\"VARCHAR\"}]'), lambda i: i.name), '; ') as text from l")}) join al using (key)",
    "trial_links": f"{_LINKS} select * from links",
    "evidence_links": f"{_LINKS}, {_CITED}, hit as ({_sql_hits(f'select pmid id, {_CLEAN.format(c="title")} as text from paper')}), bh as (select id, axp_id, arg_max(alias, (case when amb = 0 then 1 else 0 end, -amb, length(key), alias)) alias, arg_max(amb, (case when amb = 0 then 1 else 0 end, -amb, length(key), alias)) amb from hit group by 1, 2),"
    " o as (select axp_id, id ident, 'title' m, alias mt, 0.85 c, case when amb = 1 then 'candidate' else 'auto' end st from bh union all select axp_id, pmid, 'trial_reference', max(k), 0.9, 'auto' from cp join links on nct_id = k where status = 'auto' group by 1, 2)"
    " select axp_id, ident, arg_max(m, ((st = 'auto')::int, c)) as method, arg_max(mt, ((st = 'auto')::int, c)) as matched, arg_max(c, ((st = 'auto')::int, c)) as confidence, arg_max(st, ((st = 'auto')::int, c)) as status from o group by 1, 2",
    "grant_links": f"with {_AL}, g as (select article_id, title, abstract from articles where lower(trim(source)) in ('nih', 'nsf')), hit as (select *, 'title' field, 0 o from ({_sql_hits(f'select article_id id, {_CLEAN.format(c="title")} as text from g')}) union all select *, 'abstract', -1 from ({_sql_hits(f'select article_id id, {_CLEAN.format(c="abstract")} as text from g')})),"
    f" sc as (select *, case when field = 'title' then case when amb = 1 then 'candidate' else 'auto' end when amb = 1 then null when ({_NAMED_SQL}) or length(key) >= 6 then 'auto' else 'candidate' end st from hit), r as (select *, row_number() over (partition by id, axp_id order by o desc, coalesce((st = 'auto')::int, 0) desc, amb, length(key) desc, alias desc) n from sc) select id, axp_id, key, field, st as status from r where n = 1 and st is not null",
    "paper_kinds": "select case when lower(trim(kind)) in ('review', 'systematic review', 'meta-analysis', 'scoping review') then 'review' when lower(trim(kind)) like 'case report%' then 'case_report' when lower(trim(kind)) = 'randomized controlled trial' or (lower(trim(kind)) like 'clinical trial%' and lower(kind) not like '%protocol%') then 'clinical_trial' when lower(trim(kind)) in ('clinical study', 'observational study', 'multicenter study') then 'clinical_other' else 'other' end as kind, count(*) as n from paper group by 1",
    "result_chips": f"{_LATEST}, {_AL}, {_CHIP_AL}, {_REC}, {_CHIPS} select id, axp_id, place from cp3 where place <= 3",
    "program_summary": f"{_LINKS}, {_STAGES_SQL} select axp_id, preferred_name, coalesce(stage, '') as stage, coalesce(n_trials, 0) as n_trials from program left join stg using (axp_id) where status = 'active'",
    "program_cards": f"{_LINKS}, {_STAGES_SQL}, {_CHIP_AL}, {_REC}, {_CHIPS} select axp_id, preferred_name, coalesce(stage, '') as stage, count(*) as n, count(*) filter (kind = 'paper') as n_papers, count(*) filter (kind = 'trial') as n_trials, count(*) filter (kind = 'grant') as n_grants, count(*) filter (kind = 'preprint') as n_preprints from cp3 join rec using (id) join program using (axp_id) left join stg using (axp_id) where place <= 3 and program.status = 'active' group by 1, 2, 3",
    "registry_totals": f"{_LINKS} select (select count(*) from program) as programs, (select count(*) from program where status = 'active') as active, (select count(*) from virus) as viruses, (select count(distinct alias) from alias) as names, (select count(distinct nct_id) from links where status = 'auto') as linked_trials",
    "resolved_names": f"with recursive {_AL}, c as (select axp_id a, axp_id f, [axp_id] path from program union all select a, replaced_by, list_append(path, replaced_by) from c join program p on p.axp_id = c.f where p.status = 'merged' and replaced_by in (select axp_id from program) and not list_contains(path, replaced_by)), fin as (select a, arg_max(f, len(path)) f from c group by 1),"
    " q as (select distinct typed_name query from intake_name where trim(typed_name) <> '' union select axp_id from program), byid as (select query, axp_id from q join program on upper(trim(query)) = axp_id where regexp_full_match(upper(trim(query)), 'AXP[0-9]+')),"
    f" h as (select query, axp_id from byid union select query, axp_id from q join (select distinct key, axp_id from al) al on al.key = {_sql_key('query')} where query not in (select query from byid)), r as (select query, count(distinct f) n, min(f) one, count(*) hits, min(axp_id) first from h join fin on a = axp_id group by 1)"
    " select query, case when n = 1 then one end as axp_id, coalesce(n, 0) as n_programs, case when n = 1 and hits = 1 and first <> one then first end as merged_from from q left join r using (query)",
    "program_survivors": "with recursive c as (select axp_id a, axp_id f, [axp_id] path from program union all select a, replaced_by, list_append(path, replaced_by) from c join program p on p.axp_id = c.f where p.status = 'merged' and replaced_by in (select axp_id from program) and not list_contains(path, replaced_by)) select a as axp_id, arg_max(f, len(path)) as final_id from c group by 1",
    "grouped_listing": "select coalesce(virus_family, 'by modality: ' || coalesce(modality, 'none')) as grp, coalesce(list_position(['oncolytic', 'in_vivo_gene_transfer', 'ex_vivo_gene_transfer', 'vaccine_vector'], vector_role), 99) as place, coalesce(vector_role, '') as vector_role, count(distinct axp_id) as n from program left join virus using (axp_id) where status = 'active' group by 1, 2, 3",
    "disease_view": f"{_LINKS}, v(disease, rx) as (values " + ", ".join(f"('{n}', '{'|'.join(t)}')" for n, t in DISEASES.items()) + "), m as (select distinct disease, k from l join v on regexp_matches(lower(coalesce(r->>'conditions', '')), rx) or regexp_matches(lower(coalesce(r->>'brief_title', '')), rx)) select disease, count(distinct axp_id) as n_programs, count(distinct k) as n_trials from m join links on nct_id = k and links.status = 'auto' join program using (axp_id) where program.status = 'active' group by 1",
    "indication_groups": f"{_LATEST}, x as (select k, unnest(list_append(coalesce(from_json(r->'conditions', '[\"VARCHAR\"]'), []), r->>'brief_title')) c from l), y as (select k, case " + " ".join(f"when regexp_matches(lower(c), '{'|'.join(f)}') then '{n}'" for n, f in INDICATIONS) + " end b from x) select labels, count(*) as n from (select k, coalesce(string_agg(distinct b, '; ' order by b), '') as labels from y group by k) group by 1",
    "link_review": f"{_LINKS}, {_CITED}, hit as ({_sql_hits(f'select pmid id, {_CLEAN.format(c="title")} as text from paper')}), bh as (select id, axp_id, min(amb) amb from hit group by 1, 2), cand as (select id, axp_id from bh where amb = 1 and not exists (select 1 from cp join links on nct_id = cp.k where links.status = 'auto' and links.axp_id = bh.axp_id and cp.pmid = bh.id))"
    " select kind, axp_id, ref, title, preferred_name from (select 'trial' as kind, axp_id, nct_id as ref, r->>'brief_title' as title from links join l on k = nct_id where status = 'candidate' union all select 'paper', axp_id, id, title from cand join paper on pmid = id) x join program using (axp_id)",
    "program_graph": f"{_GRAPH_SQL} select * from deg",
    "program_graph_links": f"{_GRAPH_SQL} select axp_id, kind, hub from lk join deg using (kind, hub)",
    "text_references": "select distinct doc_id, 'trial' as kind, unnest(regexp_extract_all(text, 'NCT[0-9]{8}')) as ref from documents union all select distinct doc_id, 'paper', unnest(regexp_extract_all(text, 'PMID:? ?([0-9]{1,8})', 1)) from documents union all select distinct doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^\\s<>\"'')\\]]*[^\\s<>\"'')\\].,;:]')) from documents",
    "observed_versions": f"with o as (select distinct snapshot_date, {_N} k, {_H} h from observation), v as (select distinct {_N} k, {_H} h from trial_version) select snapshot_date, count(*) as n from o join v using (k, h) group by 1",
    "matched_queries": f"with q as (select distinct snapshot_date, {_N} k, unnest(from_json(matched_queries, '[\"VARCHAR\"]')) q from observation) select snapshot_date, k as nct_id, string_agg(q, ',' order by q) as queries from q group by 1, 2",
    "first_seen": f"select {_N} as nct_id, min(snapshot_date) as first_seen from observation group by 1",
    "new_dropped": f"""with p as (select distinct snapshot_date d, {_N} k from observation), s as (select snapshot_date d, complete c, lag(snapshot_date) over w pd, lag(complete) over w pc, lead(snapshot_date) over w nd, lead(complete) over w nc from snapshot window w as (order by snapshot_date)),
f as (select {_N} k, min(record->>'first_post_date') fp from trial_version group by 1)
select p.k as nct_id, p.d as snapshot_date, 'new' as change_type from p join s using (d) join f using (k) where pc = 1 and not exists (select 1 from p q where q.d = s.pd and q.k = p.k) and try_cast(fp as date) >= pd::date - 30
union all select p.k, nd, 'dropped' from p join s using (d) where nd is not null and c = 1 and nc = 1 and not exists (select 1 from p q where q.d = s.nd and q.k = p.k)""",
    "snapshot_status": "select snapshot_date, date_diff('day', snapshot_date::date, (select max(finished_at)::date from snapshot)) as age_days, case when date_diff('day', snapshot_date::date, (select max(finished_at)::date from snapshot)) <= 8 and complete = 1 then 'current' else 'stale' end as status from snapshot",
    "trials_tried": f"{_LATEST} select k as nct_id, {_PHASES} as phase, coalesce(list_max(list_transform(regexp_extract_all({_PHASES}, '[0-9]'), lambda x: x::int)), 0) as phase_rank, r->>'start_date' as start_date from l",
    "phase_histogram": f"{_LATEST} select coalesce(regexp_replace({_PHASES}, 'Phase (\\d)/Phase (\\d)', 'Phase \\1/\\2'), 'Not applicable') as phase_label, count(*) as n from l group by 1",
    "cited_papers": f"{_LATEST}, x as (select k, unnest(from_json(r->'references', '[{{\"pmid\":\"VARCHAR\",\"type\":\"VARCHAR\"}}]')) e from l) select distinct x.k as nct_id, e.pmid as pmid, kind from x left join paper p on p.pmid = e.pmid where e.type in ('RESULT', 'DERIVED')",
    "date_labels": f"{_LATEST}, v as (select k, r->>'start_date' s, case when regexp_matches(r->>'overall_status', '(?i)active|recruiting|enrolling') then 'Ongoing' else r->>'completion_date' end e, r->>'overall_status' t from l) select k as nct_id, concat_ws(' | ', 'Start: ' || nullif(s, ''), 'End: ' || nullif(e, ''), 'Status: ' || nullif(t, '')) as label from v",
    "alias_keys": f"select distinct alias, {_KEY.format(c='alias')} as key from alias where regexp_full_match(alias, '[\\x00-\\x7F]*')",
    "intervention_links": f"{_LATEST}, x as (select k, unnest(from_json(r->'interventions', '[{{\"name\":\"VARCHAR\"}}]')) e from l), a as (select distinct axp_id, {_KEY.format(c='alias')} key from alias where regexp_full_match(alias, '[\\x00-\\x7F]*')) select distinct x.k as nct_id, axp_id from x join a on a.key = {_KEY.format(c='e.name')} where regexp_full_match(e.name, '[\\x00-\\x7F]*') and a.key <> ''",
    "modality_trials": f"{_LATEST}, x as (select k, unnest(from_json(r->'interventions', '[{{\"name\":\"VARCHAR\"}}]')) e from l), a as (select distinct axp_id, {_KEY.format(c='alias')} key from alias where regexp_full_match(alias, '[\\x00-\\x7F]*')) select distinct x.k as nct_id from x join a on a.key = {_KEY.format(c='e.name')} where regexp_full_match(e.name, '[\\x00-\\x7F]*') and a.key <> '' and axp_id in (select axp_id from program where modality = 'vaccine')",
    "program_names": "with a as (select axp_id, alias, min(case alias_type when 'inn' then 0 when 'brand' then 1 when 'code' then 2 else 3 end) rk from alias where ambiguous = 0 group by 1, 2), r as (select *, row_number() over (partition by axp_id order by rk, alias) n from a) select axp_id, string_agg(alias, '; ' order by n) as names from r where n <= 3 group by 1",
    "dq_violations": """select 'program_id_format' as rule, axp_id as key from program where not regexp_full_match(axp_id, 'AXP[0-9]{6}') union all select 'merged_without_target', axp_id from program where status = 'merged' and replaced_by is null
union all select 'bad_created', axp_id from program where not coalesce(regexp_full_match(created, '\\d{4}-\\d{2}-\\d{2}'), false) union all select 'alias_without_program', axp_id from alias where axp_id not in (select axp_id from program)
union all select 'virus_without_program', axp_id from virus where axp_id not in (select axp_id from program) union all select 'alias_key_missing', alias from alias where alias_key is null union all select 'alias_repeated', alias from alias group by axp_id, alias having count(*) > 1""",
    "taxon_deepest": "select s_suppkey as id, case when n_nationkey % 2 = 0 then n_name else r_name end as category from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "grant_rollup": "select l_orderkey, min(year(l_shipdate)) as first_year, max(year(l_shipdate)) as last_year, arg_max(l_returnflag, (year(l_shipdate), l_linenumber, l_partkey, l_suppkey)) as l_returnflag from lineitem group by 1",
    "condition_categories": f"with v as ({_CONDITION_VOC}), g as (select a from v where not contains(a, ' ') and a = lower(a)) select v.a as label, coalesce(arg_max(g.a, (length(g.a), g.a)) filter (g.a is not null), v.a) as category from v left join g on regexp_matches(v.a, '(?i)(^|[^A-Za-z0-9])' || g.a || '($|[^A-Za-z0-9])') group by v.a",
    "clean_proposals": "with a as (select distinct axp_id, lower(alias) k, source from alias) select distinct axp_id, k from a where source = 'press' and k not in (select k from a where source <> 'press') and k in (select k from a where source = 'press' group by 1 having count(distinct axp_id) = 1)",
    "query_members": "select snapshot_date, count(*) as n from observation where list_contains(from_json(matched_queries, '[\"VARCHAR\"]'), 'cart') group by 1",
    "snapshot_pairs": "select snapshot_date, lag(snapshot_date) over w as prev, date_diff('day', lag(snapshot_date) over w::date, snapshot_date::date) as days, (snapshot_date::date + 1)::varchar as next_from from snapshot window w as (order by snapshot_date)",
    "searchable_programs": "select axp_id from program left join (select axp_id, string_agg(distinct alias, ' ') names from alias group by 1) using (axp_id) where contains(lower(concat_ws(' ', preferred_name, modality, platform, sponsor, names)), 'gene')",
    "log_daily": "select ts::date as day, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS) + " from events group by 1",
    "log_clients": "select case when user_id % 7 = 0 then 'connector' else 'client-' || (user_id % 7) end as client, event_type as channel, count(*) as events, count(*) filter (event_type = 'view') as searches, count(distinct user_id) as sessions, min(ts) as first_seen, max(ts) as last_seen from events group by 1, 2",
    "log_quality": "select count(*) as searches, count(*) filter (value < 5) as empty, round(100 * avg((value < 5)::int), 1) as empty_pct, round(quantile_cont(value, 0.5), 2) as median_seconds, round(quantile_cont(value, 0.9), 2) as p90_seconds from events where event_type = 'view'",
    "log_sources": "with u as (select 'EPMC' source, (user_id % 5)::double n from events union all select 'CORE', (props->>'k')::double from events) select source, count(*) as searches_present, count(*) filter (n = 0) as zero_results, round(median(n), 4) as median_records, round(sum(n), 4) as total_records from u group by 1",
    "log_recent": "select event_type, count(*) as n from events where ts >= (select max(ts) from events) - interval 30 day group by 1",
    "stream_changes": f"with {_EVENTS} select event_id, nct_id, change_type, significance, before, after from evs",
    "stream_rate": "with e as (select event_type, epoch(ts)::bigint // 15 q from events), w as (select event_type, q - o as q0 from e, range(0, 4) r(o)) select event_type, max(n) as peak from (select event_type, q0, count(*) n from w group by 1, 2) group by 1",
    "stream_daily": "select ts::date as day, event_type, count(*) as n from events group by 1, 2",
    "stream_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) sid from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, sid""",
}

QUERIES = {
    f.__name__: f
    for f in (
        event_programs, change_feed_vaccines, grant_links, paper_kinds, resolved_names, result_chips, program_summary, program_graph_links, link_review,
        change_events, status_changes, change_feed, content_hashes, unseen_versions, observed_versions, matched_queries, first_seen, new_dropped, snapshot_status, trials_tried, phase_histogram, interventions, date_labels,
        cited_papers, alias_keys, alias_keys_wide, window_hits, evidence_links, trial_links, intervention_links, intervention_links_wide, program_survivors, registry_totals, program_names, grouped_listing, disease_view, indication_groups, program_graph,
        program_cards, dq_violations, taxon_deepest, grant_rollup, log_daily, log_clients, log_quality, log_sources, log_recent, stream_daily, stream_sessions, stream_rate, stream_changes, condition_categories, text_references, clean_proposals, query_members, modality_trials, modality_trials_wide, snapshot_pairs, weekly_digest, searchable_programs,
    )
}
