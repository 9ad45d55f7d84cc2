"""Queries of record handling, resolution, tagging, search, landscape and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import ids, text
from litspark.operators import evaluate, landscape, records, resolve, search, tagging, trials
from litspark.plans import vocabulary
from litspark.plans.vocabulary import Vocabulary
from litspark.session import table

QUERY = 'neuroblastoma AND "viral shedding"'


def term_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The newest documents that hold all terms."""
    docs = table(spark, d, "documents").where("text is not null")
    return search.newest(search.matching(docs, QUERY, ["text"]), "collected_at", "doc_id", 100).select("doc_id", "source", "section")


def term_search_sources(spark: SparkSession, d: str) -> DataFrame:
    """Records by source in which every term stands in title or abstract."""
    hits = search.matching(table(spark, d, "articles"), QUERY, ["title", "abstract"])
    return hits.groupBy("source").agg(F.count("*").alias("n"))


def source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records of the groups preprints and grants."""
    return search.from_sources(table(spark, d, "articles"), ["preprints", "grants"]).select("article_id", "source")


def round_robin_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a fair listing of sources."""
    return search.round_robin(table(spark, d, "articles"), "source", [F.col("article_id")], 100, 50).select("article_id", "source", "turn")


def like_search(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a fragment, abstracts cut to 80 characters."""
    return table(spark, d, "articles").where(F.col("title").ilike("%glioma%")).select("article_id", text.truncate("abstract", 80).alias("abstract"))


def normal_records(spark: SparkSession, d: str) -> DataFrame:
    """DOI, date and retraction flag of all records in one form."""
    a = table(spark, d, "articles").select("article_id", "title", "doi", "authors", "publication_date")
    return records.normalised(a).select("article_id", "doi", "publication_date", "is_retracted")


def normal_authors(spark: SparkSession, d: str) -> DataFrame:
    """One separator between authors."""
    return table(spark, d, "articles").select("article_id", text.normal_authors("authors").alias("authors"))


def decoded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their entities decoded in one pass."""
    return table(spark, d, "articles").where("title like '%&%'").select("article_id", text.decode_entities("title").alias("title"))


def title_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Title keys that several records share."""
    return table(spark, d, "articles").groupBy(text.title_key("title").alias("tkey")).agg(F.count("*").alias("n")).where("tkey is not null and n > 1")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """articles as records to resolve; PubMed ids come from the papers of the same DOI, grants have no id of their own here."""
    doi = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    p = table(spark, d, "paper").where("trim(doi) <> ''").groupBy(doi("doi").alias("d")).agg(F.min("pmid").alias("pmid"), F.min("pmcid").alias("pmcid"))
    a = table(spark, d, "articles").select(F.col("article_id").alias("row_id"), "source", "doi", "published_doi", "title", "abstract", "publication_date", F.lit(None).cast("string").alias("grant_id"), F.col("is_open_access").cast("string").alias("is_open_access"))
    return a.join(p, doi("doi") == F.col("d"), "left").drop("d")


FILLED = ["abstract", "pmcid", "pmid", "is_open_access"]


def _grouped_by_doi(spark: SparkSession, d: str) -> DataFrame:
    a = _rows(spark, d).withColumn("doi_c", resolve.clean_doi(F.col("doi"), F.col("published_doi"))).where("doi_c is not null")
    return a.join(a.groupBy("doi_c").agg(F.min("row_id").alias("grp")), "doi_c")


def resolve_doi_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one DOI."""
    a = _rows(spark, d).select("row_id", resolve.clean_doi(F.col("doi"), F.col("published_doi")).alias("doi_c")).where("doi_c is not null")
    return a.groupBy("doi_c").agg(F.min("row_id").alias("grp"), F.count("*").alias("n")).where("n > 1")


def resolve_fill(spark: SparkSession, d: str) -> DataFrame:
    """Four fields filled within DOI groups by the longest value."""
    return resolve.filled(_grouped_by_doi(spark, d), FILLED).select("row_id", "grp", F.length("abstract").alias("abstract_len"), "pmcid", "pmid", "is_open_access")


def resolve_kept(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each DOI group and what was merged into it."""
    return resolve.kept(_grouped_by_doi(spark, d), resolve.record_ref(F.col("source"), [F.col("row_id")], F.col("title"))).select("grp", "row_id", "merged_from")


def _works(spark: SparkSession, d: str) -> DataFrame:
    full = resolve.filled(resolve.grouped(_rows(spark, d)), FILLED)
    kept = resolve.kept(full, resolve.record_ref(F.col("source"), [F.col("doi"), F.col("pmid"), F.col("grant_id")], F.col("title")))
    return resolve.distinct_first(kept, ["doi", "title"], "row_id")


def resolve_works(spark: SparkSession, d: str) -> DataFrame:
    """All rules, the title rule included, then one record per DOI and title."""
    return _works(spark, d).select("row_id", "grp", "source", "doi", "title", "merged_from")


def resolve_verified(spark: SparkSession, d: str) -> DataFrame:
    """A3: per source the records before and after, and a total."""
    return resolve.verification(table(spark, d, "articles").select("source"), _works(spark, d).select("source"))


_TEXTS = "title", "abstract"


def virus_vocabulary(spark: SparkSession, d: str) -> Vocabulary:
    """Virus families with the names of their viruses, from the registry."""
    return vocabulary.from_table("virus", table(spark, d, "virus"), "virus_family", "virus")


def condition_names(spark: SparkSession, d: str) -> DataFrame:
    """category, name: the conditions that trials state, and the last words that several of them share, as generic ones."""
    rec = F.from_json("record", "conditions array<string>")
    stated = table(spark, d, "trial_version").select(F.explode(rec["conditions"]).alias("name")).where("trim(name) <> ''").select(F.trim("name").alias("name")).distinct()
    last = stated.select(F.lower(F.element_at(F.split("name", " "), -1)).alias("name"), F.col("name").alias("whole")).where("contains(whole, ' ')")
    shared = last.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return stated.unionByName(shared).select(F.col("name").alias("category"), "name")


def tag_virus(spark: SparkSession, d: str) -> DataFrame:
    """Primary virus family and hits of each record."""
    t = tagging.tagged(table(spark, d, "articles"), virus_vocabulary(spark, d), "virus", *_TEXTS)
    return t.select("article_id", "primary_virus", F.array_join("virus_hits", ";").alias("hits"))


def tag_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions, generic ones masked by specific ones, with the place of each hit; ties by name."""
    t = tagging.tagged(table(spark, d, "articles"), vocabulary.from_table("condition", condition_names(spark, d), "category", "name"), "condition", *_TEXTS, ties="name")
    return t.select("article_id", "primary_condition", F.array_join("condition_placed", "|").alias("placed"))


def _trial_texts(spark: SparkSession, d: str) -> DataFrame:
    """nct_id, title with interventions and other names, phase and status of the latest version of each trial."""
    rec = F.from_json("record", trials.RECORD)
    v = table(spark, d, "trial_version").select(ids.nct_id("nct_id").alias("nct_id"), ids.date_digits("first_seen").alias("seen"), "version_id", rec.alias("rec"))
    latest = v.groupBy("nct_id").agg(F.max_by("rec", F.struct("seen", "version_id")).alias("rec"))
    names = F.flatten(F.transform("rec.interventions", lambda i: F.concat(F.array(i["name"]), F.coalesce(i["other_names"], F.array().cast("array<string>")))))
    title = F.concat_ws(". ", "rec.brief_title", F.array_join(names, "; "))
    return latest.select("nct_id", title.alias("title"), F.lit(None).cast("string").alias("abstract"), text.phase_label(F.col("rec.phases")).alias("phase"), F.col("rec.overall_status").alias("status"))


def tag_modality(spark: SparkSession, d: str) -> DataFrame:
    """Trials by the virus family of their title, interventions and other names, in two tiers."""
    return tagging.two_tier(_trial_texts(spark, d), virus_vocabulary(spark, d), ["Parvoviridae", "Retroviridae"], "family", *_TEXTS).select("nct_id", "family")


def tag_override(spark: SparkSession, d: str) -> DataFrame:
    """Curated terms of a program over its modality."""
    p = table(spark, d, "program")
    tags = p.select(F.col("axp_id").alias("id"), F.coalesce(F.nullif(F.trim("modality"), F.lit("")), F.lit(tagging.NONE)).alias("tag"))
    terms = p.select(F.col("axp_id").alias("id"), F.posexplode(F.split("targets", r"\s*;\s*")).alias("pos", "term")).where("term <> ''")
    v = table(spark, d, "virus")
    lookup = v.where("transgenes is not null").groupBy(F.col("transgenes").alias("term")).agg(F.min("virus_family").alias("category")).withColumn("axis", F.lit("virus"))
    lookup = lookup.withColumn("category", F.when(F.col("category") != "Parvoviridae", F.col("category")))
    return tagging.overridden(tags, terms, lookup, "virus")


def bioinformatics_flag(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text names a computational method."""
    return table(spark, d, "articles").select("article_id", tagging.computational(F.col("title"), F.col("abstract")).alias("flag"))


def landscape_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Virus families by stage, over articles and trials, with the trials that take participants."""
    none = F.lit(None).cast("string")
    a = table(spark, d, "articles").select(F.trim("source").alias("source"), "title", "abstract", none.alias("phase"), none.alias("status"))
    t = _trial_texts(spark, d).select(F.lit("clinicaltrials.gov").alias("source"), "title", "abstract", "phase", F.upper(F.regexp_replace(F.trim("status"), r"[\s,-]+", "_")).alias("status"))
    tagged = tagging.tagged(a.unionByName(t), virus_vocabulary(spark, d), "virus", *_TEXTS)
    return landscape.landscape(tagged.withColumn("stage", landscape.stage(F.col("source"), F.col("phase"))), "primary_virus", "stage", F.col("status"))


def source_report(spark: SparkSession, d: str) -> DataFrame:
    """A2-A4: per source what was retrieved, kept and merged; a source without any DOI stands for one that broke off."""
    return landscape.source_report(*_report(spark, d))


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "articles").withColumn("source", landscape.source_key(F.trim("source")))
    counts = a.groupBy("source").agg(F.count("*").cast("int").alias("retrieved"), F.max("article_id").alias("total"), (F.count_if(F.trim("doi") != "") == 0).alias("failed"))
    doi = resolve.clean_doi(F.col("doi"), F.col("published_doi"))
    first = a.withColumn("doi_c", doi).where("doi_c is not null").groupBy("doi_c").agg(F.min_by("source", "article_id").alias("source"))
    kept = first.select("source").unionAll(a.where(doi.isNull()).select("source"))
    return records.status_rows(counts), kept


def flow_totals(spark: SparkSession, d: str) -> DataFrame:
    """A5: matched, retrieved, merged and unique in one row."""
    status, kept = _report(spark, d)
    return landscape.flow(landscape.source_report(status, kept), kept.agg(F.count("*").alias("n")))


def consensus_edges(spark: SparkSession, d: str) -> DataFrame:
    """Modality and virus family pairs named by several evidence sources."""
    pv = table(spark, d, "program").join(table(spark, d, "virus"), "axp_id").where("modality is not null")
    return evaluate.consensus_edges(pv, "modality", "virus_family", "vector_role", "axp_id", 2)


def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Journals with enough records from enough sources."""
    return evaluate.gaps(table(spark, d, "articles").where("journal is not null"), "journal", "source", 20)


def agreement_wilson(spark: SparkSession, d: str) -> DataFrame:
    """How often a record's year is supported by the papers of the same DOI, per source."""
    a = table(spark, d, "articles").select(F.trim("source").alias("source"), F.lower(F.trim("doi")).alias("k"), F.substring("publication_date", 1, 4).try_cast("int").alias("y"))
    p = table(spark, d, "paper").select(F.lower(F.trim("doi")).alias("k"), F.col("pub_year").alias("py")).groupBy("k").agg(F.collect_set("py").alias("years"))
    j = a.join(p, "k", "left").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    return evaluate.agreement(j, F.col("y"), F.col("years"), ["source"])


def descriptor_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of trials named often that no program note or alias covers."""
    rec = F.from_json("record", "conditions array<string>")
    t = table(spark, d, "trial_version").select(F.col("version_id").alias("id"), rec["conditions"].alias("terms"))
    covered = table(spark, d, "alias").select(F.col("alias").alias("term")).distinct()
    return evaluate.proposals(t, covered, 5)


def doi_sets(spark: SparkSession, d: str) -> DataFrame:
    """DOIs in both tables, and in one only."""
    a = table(spark, d, "articles").select(F.lower(F.trim("doi")).alias("k")).where("k is not null").distinct()
    p = table(spark, d, "paper").select(F.lower(F.trim("doi")).alias("k")).where("k is not null").distinct()
    both = a.join(p, "k", "left_semi").select("k", F.lit("both").alias("part"))
    return both.unionByName(a.join(p, "k", "left_anti").select("k", F.lit("articles").alias("part"))).unionByName(p.join(a, "k", "left_anti").select("k", F.lit("paper").alias("part")))


def ragged_union(spark: SparkSession, d: str) -> DataFrame:
    """Three tables of different shape in one, with a running row id."""
    u = records.union_sources({
        "articles": table(spark, d, "articles").select(F.col("article_id").cast("string").alias("ref"), "title", "journal"),
        "paper": table(spark, d, "paper").select(F.col("pmid").alias("ref"), "title", "pub_year"),
        "program": table(spark, d, "program").select(F.col("axp_id").alias("ref"), F.col("preferred_name").alias("title")),
    }, "ref")
    return u.select("row_id", "source", "ref", "journal", "pub_year")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest row per DOI, else per title."""
    a = table(spark, d, "articles").withColumn("k", F.coalesce(F.nullif(F.lower(F.trim("doi")), F.lit("")), F.md5("title")))
    return a.groupBy("k").agg(F.max_by("article_id", F.struct("retrieved_at", "article_id")).alias("article_id"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """plain text, item key and slug of each title."""
    return table(spark, d, "articles").select("article_id", text.html_to_text("title").alias("plain"), text.item_key("doi", F.lit(None), "title").alias("item_key"), text.slug("journal").alias("slug"))


def safe_html(spark: SparkSession, d: str) -> DataFrame:
    """documents with plain formatting tags only."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.sanitize_html(text.strip_invisible("text")).alias("safe"))


def markdown_titles(spark: SparkSession, d: str) -> DataFrame:
    """titles and DOIs made safe for Markdown."""
    return table(spark, d, "articles").select("article_id", text.md_escape("title").alias("title"), text.md_link_target("doi").alias("target"))


def publication_dates(spark: SparkSession, d: str) -> DataFrame:
    """dates from day, month and year spellings."""
    return table(spark, d, "articles").select("article_id", text.any_date("publication_date").cast("string").alias("day"))


def date_span(spark: SparkSession, d: str) -> DataFrame:
    """the first and the last date per source."""
    a = table(spark, d, "articles").select(F.trim("source").alias("source"), text.any_date("publication_date").alias("day"))
    return a.groupBy("source").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


def inverted_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """abstracts rebuilt from their inverted index."""
    a = table(spark, d, "articles").where("abstract is not null").select("article_id", F.trim(F.regexp_replace("abstract", r"\s+", " ")).alias("t"))
    words = F.split("t", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    return a.select("article_id", text.inverted_text(index).alias("rebuilt"))


def ris_export(spark: SparkSession, d: str) -> DataFrame:
    """K7: a citation record per article."""
    a = table(spark, d, "articles")
    au = F.transform(F.split(F.coalesce("authors", F.lit("")), r";\s*"), lambda x: F.concat(F.lit("AU  - "), x))
    lines = F.concat(F.array(F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), "title")), F.filter(au, lambda x: x != "AU  - "), F.array(F.concat(F.lit("DO  - "), "doi"), F.concat(F.lit("PY  - "), F.substring("publication_date", 1, 4)), F.lit("ER  - ")))
    return a.select("article_id", F.array_join(F.array_compact(lines), "\n").alias("ris"))


def plot_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records between two dates, open access, abstracts first, the newest first."""
    a = table(spark, d, "articles").withColumn("day", text.any_date("publication_date")).where("day between date'2018-01-01' and date'2020-12-31' and is_open_access")
    return a.orderBy(F.col("abstract").isNotNull().desc(), F.desc("day"), "article_id").limit(200).select("article_id")


# ---- SQL ----------------------------------------------------------------------------------------------------------


_NEGATED = "'[A-Za-z0-9+]+(?:-[A-Za-z0-9+]+)*-(?i:negative|seronegative|uninfected)($|[^A-Za-z0-9])', ' \\1', 'g'"
_NEGATED_TERM = "'(^|[^A-Za-z0-9])[A-Z][A-Za-z0-9+]*(?:-[A-Za-z0-9+]+)*\\s+(?i:negative|seronegative|uninfected)($|[^A-Za-z0-9])', '\\1 \\2', 'g'"


def _sql_match_text(c: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g'), {_NEGATED}), {_NEGATED_TERM})"
    shouted = f"case when length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) >= 12 and not regexp_matches({t}, '[a-z]') then lower({t}) else {t} end"
    # separators are doubled so that neighbouring matches do not share one
    return f"regexp_replace({shouted}, '([^A-Za-z0-9])', '\\1\\1', 'g')"


_SQL_NAME = "case when length({a}) <= 5 and regexp_matches({a}, '[A-Z]') and not contains({a}, ' ') then {p} else '(?i:' || {p} || ')' end"


def _sql_name(a: str) -> str:
    return _SQL_NAME.format(a=a, p=f"regexp_replace({a}, '[\\s-]+', '[\\\\s\\\\x{{a0}}-]+', 'g')")


def _sql_union(names: str) -> str:
    return f"'(?:^|[^A-Za-z0-9])(?:' || string_agg({_sql_name(names)}, '|' order by length({names}) desc, {names}) || ')(?:$|[^A-Za-z0-9])'"


def _sql_tagged(voc: str, rows: str, ties: str = "o") -> str:
    """Common table expressions up to ``tagged`` (the columns of rows, tag, hits, placed).  voc: SQL of (c, a); rows: SQL with id, title and abstract."""
    one = f"'(?:^|[^A-Za-z0-9])' || {_sql_name('v.a')} || '(?:$|[^A-Za-z0-9])'"
    count = lambda t: f"len(regexp_extract_all(case when mask is null then {t} else regexp_replace({t}, mask, ' ', 'g') end, rx))"
    return f"""with recursive voc as ({voc}), rx as (select c, {_sql_union('a')} rx, row_number() over (order by c) o from voc group by c),
mk as (select c, {_sql_union('a')} mask from (select distinct v.c, w.a from voc v join voc w on w.c <> v.c and regexp_matches(regexp_replace(w.a, '([^A-Za-z0-9])', '\\1\\1', 'g'), {one})) group by c),
src as ({rows}), m as (select id, {_sql_match_text('title')} t2, {_sql_match_text('abstract')} a2 from src),
s as (select id, c, o, {count('t2')} t, {count('a2')} a from m cross join rx left join mk using (c)),
best as (select id, case when max(20 * t + 3 * a) >= 6 then arg_max(c, (20 * t + 3 * a, -{ties})) else 'Non-descript' end tag, string_agg(c, ';' order by o) filter (t + a > 0) hits,
 nullif(concat_ws('|', string_agg(c || ';Title', '|' order by o) filter (t > 0), string_agg(c || ';Abstract', '|' order by o) filter (a > 0)), '') placed from s group by id),
tagged as (select src.*, tag, coalesce(hits, '') hits, placed from src join best using (id))"""


_VIRUS_VOC = "select distinct trim(virus_family) c, trim(virus) a from virus where trim(virus_family) <> '' and trim(virus) <> ''"
_CONDITION_VOC = """select a c, a from (select distinct trim(n) a from (select unnest(from_json(record->'conditions', '["VARCHAR"]')) n from trial_version) where trim(n) <> ''
 union select w from (select lower(split_part(n, ' ', -1)) w, n from (select distinct trim(n) n from (select unnest(from_json(record->'conditions', '["VARCHAR"]')) n from trial_version)) where contains(n, ' ')) group by w having count(*) > 1)"""
_ARTICLE_ROWS = "select article_id id, title, abstract, trim(source) source, null::varchar phase, null::varchar status from articles"
_SQL_NCT = "'NCT' || regexp_extract(upper(nct_id), 'NCT[^0-9A-Z]*([0-9]{8})', 1)"
_TRIAL_ROWS = f"""select k id, concat_ws('. ', r->>'brief_title', array_to_string(flatten(list_transform(from_json(r->'interventions', '[{{"name":"VARCHAR","other_names":["VARCHAR"]}}]'), lambda i: list_prepend(i.name, coalesce(i.other_names, [])))), '; ')) title,
 null::varchar abstract, 'clinicaltrials.gov' source, nullif(array_to_string(list_filter(from_json(r->'phases', '["VARCHAR"]'), lambda p: upper(trim(p)) not in ('', 'NA')), '/'), '') phase, upper(regexp_replace(trim(r->>'overall_status'), '[\\s,-]+', '_', 'g')) status
 from (select {_SQL_NCT} k, arg_max(record, (rpad(regexp_replace(first_seen, '[^0-9]', '', 'g'), 14, '0'), version_id)) r from trial_version group by 1)"""
_SQL_DOI = "nullif(regexp_replace(lower(trim(coalesce(nullif(trim(published_doi), ''), doi))), '^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|doi:\\s*)', ''), '')"
_SQL_KEYED = f"with a as (select *, {_SQL_DOI} doi_c from articles), k as (select *, min(article_id) over (partition by doi_c) grp from a where doi_c is not null)"
_SQL_PRIO = "case source " + " ".join(f"when '{s}' then {p}" for s, p in resolve.PRIORITY.items()) + " else 100 end"
_SQL_TOP = "list_max(list_transform(regexp_extract_all(phase, '[0-9]'), lambda x: x::int))"
_SQL_STAGE = f"case when source = 'clinicaltrials.gov' then case when {_SQL_TOP} is null then 'Trial: no phase' when {_SQL_TOP} <= 1 then 'Trial: phase 1' when {_SQL_TOP} = 2 then 'Trial: phase 2' else 'Trial: phase 3+' end when trim(source) = 'Patent' then 'Patent' when regexp_matches(trim(source), '(?i)^(preprint|biorxiv|medrxiv)') then 'Preprint' when trim(source) in ('NIH', 'NSF') then 'Grant' else 'Paper' end"
_SQL_SKEY = "case when regexp_matches(trim(source), '(?i)^(preprint|biorxiv|medrxiv)') then 'bioRxiv' else trim(source) end"
_SQL_REPORT = f"""with a as (select *, {_SQL_SKEY} src, {_SQL_DOI} doi_c from articles),
c as (select src, count(*) retrieved, max(article_id) total, case when count(nullif(trim(doi), '')) = 0 then 'Stopped early' else 'OK' end st from a group by 1),
f as (select arg_min(src, article_id) src from a where doi_c is not null group by doi_c union all select src from a where doi_c is null),
u as (select src, count(*) u from f group by 1),
r as (select c.src as source, total as matched, retrieved, coalesce(u, 0) as unique_n, greatest(0, retrieved - coalesce(u, 0)) as merged, st as status from c left join u using (src))"""
_SQL_DAY = """coalesce(case when regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(publication_date[1:10] as date)
 when regexp_matches(publication_date, '^\\d{4}-\\d{2}$') then try_cast(publication_date || '-01' as date) when regexp_matches(publication_date, '^\\d{4}$') then try_cast(publication_date || '-01-01' as date)
 when regexp_matches(publication_date, '^\\d{1,2}/\\d{1,2}/\\d{4}$') then cast(try_strptime(publication_date, '%m/%d/%Y') as date)
 when regexp_matches(publication_date, '^\\d{1,2} [A-Z][a-z]{2} \\d{4}$') then cast(try_strptime(publication_date, '%d %b %Y') as date) end)"""
_TERMS = [f"(?i)(^|[^A-Za-z0-9]){t}" for t in search.terms(QUERY)]

SQL = {
    "term_search_topk": "select doc_id, source, section from documents where " + " and ".join(f"regexp_matches(text, '{t}')" for t in _TERMS) + " order by collected_at desc, doc_id limit 100",
    "term_search_sources": "select source, count(*) as n from articles where " + " and ".join(f"(coalesce(regexp_matches(title, '{t}'), false) or coalesce(regexp_matches(abstract, '{t}'), false))" for t in _TERMS) + " group by 1",
    "source_filter": "select article_id, source from articles where regexp_matches(lower(source), 'preprint|biorxiv|medrxiv|nih|nsf')",
    "round_robin_page": "select article_id, source, turn from (select *, row_number() over (partition by source order by article_id) turn from articles) order by turn, article_id offset 100 limit 50",
    "like_search": "select article_id, case when length(abstract) > 80 then left(abstract, 80) || '...' else abstract end as abstract from articles where title ilike '%glioma%'",
    "normal_records": "select article_id, nullif(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|info:doi/|doi:\\s*)', ''), '') as doi, regexp_replace(publication_date, '^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ].*$', '\\1') as publication_date, coalesce(regexp_matches(title, '(?i)^\\W*(retracted|withdrawn)\\b'), false) as is_retracted from articles",
    "normal_authors": "select article_id, regexp_replace(regexp_replace(trim(authors), '\\s*[;|]+\\s*(?:[;|]\\s*)*', '; ', 'g'), '^[;\\s]+|[;\\s]+$', '', 'g') as authors from articles",
    "title_key_groups": "select tkey, count(*) as n from (select nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'), '[^\\pL\\pN]+', '', 'g'), '') tkey from articles) where tkey is not null group by 1 having count(*) > 1",
    "resolve_doi_groups": f"select {_SQL_DOI} as doi_c, min(article_id) as grp, count(*) as n from articles where {_SQL_DOI} is not null group by 1 having count(*) > 1",
    "resolve_fill": f"with p as (select lower(trim(doi)) d, min(pmid) pm, min(pmcid) pc from paper where trim(doi) <> '' group by 1), q as (select *, {_SQL_DOI} doi_c, lower(trim(doi)) d from articles), a as (select q.*, pm, pc from q left join p using (d)),"
    " k as (select *, min(article_id) over (partition by doi_c) grp, case when trim(abstract) not in ('', 'NA', 'NULL', 'No abstract available') then trim(abstract) end ab, is_open_access::varchar oa from a where doi_c is not null),"
    " b as (select grp, arg_max(ab, (length(ab), -article_id)) filter (ab is not null) l, arg_max(pm, (length(pm), -article_id)) filter (pm is not null) pm1, arg_max(pc, (length(pc), -article_id)) filter (pc is not null) pc1, arg_max(oa, (length(oa), -article_id)) filter (oa is not null) oa1 from k group by 1) select article_id as row_id, grp, length(coalesce(ab, l)) as abstract_len, coalesce(pc, pc1) as pmcid, coalesce(pm, pm1) as pmid, coalesce(oa, oa1) as is_open_access from k join b using (grp)",
    "resolve_kept": _SQL_KEYED + f", r as (select *, row_number() over (partition by grp order by {_SQL_PRIO}, abstract is null, publication_date desc nulls last, article_id) rk from k) select grp, max(case when rk = 1 then article_id end) as row_id, string_agg(source || ': ' || article_id, '; ' order by rk) filter (rk > 1) as merged_from from r group by grp",
    "tag_virus": _sql_tagged(_VIRUS_VOC, _ARTICLE_ROWS) + " select id as article_id, tag as primary_virus, hits from tagged",
    "tag_conditions": _sql_tagged(_CONDITION_VOC, _ARTICLE_ROWS) + " select id as article_id, tag as primary_condition, placed from tagged",
    "tag_modality": _sql_tagged(_VIRUS_VOC, _TRIAL_ROWS) + ", front as (select id, max(20 * t + 3 * a) n, arg_max(c, (20 * t + 3 * a, -o)) c from s where c not in ('Parvoviridae', 'Retroviridae') group by id) select tagged.id as nct_id, case when n >= 6 then c else tag end as family from tagged left join front using (id)",
    "tag_override": """with t as (select axp_id id, coalesce(nullif(trim(modality), ''), 'Non-descript') tag from program),
x as (select axp_id id, unnest(string_split_regex(targets, '\\s*;\\s*')) term, generate_subscripts(string_split_regex(targets, '\\s*;\\s*'), 1) pos from program where targets is not null),
l as (select transgenes term, nullif(min(virus_family), 'Parvoviridae') category from virus where transgenes is not null group by 1),
k as (select id, arg_min(category, pos) filter (category is not null) m, arg_min(term, pos) filter (category is null) u from x join l using (term) where term <> '' group by 1)
select t.id as id, coalesce(m, case when tag = 'Non-descript' then u end, tag) as tag from t left join k using (id)""",
    "bioinformatics_flag": "select article_id, regexp_matches(regexp_replace(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')), '<[^>]+>', '', 'g'), '(?i)(^|[^A-Za-z0-9])(" + "|".join(n.replace("-", " ").replace(" ", "[\\s\\x{a0}-]+") for n in tagging.COMPUTATIONAL) + ")($|[^A-Za-z0-9])') as flag from articles",
    "landscape_pivot": _sql_tagged(_VIRUS_VOC, _ARTICLE_ROWS.replace("article_id id", "article_id::varchar id") + " union all " + _TRIAL_ROWS) + f", g as (select tag, {_SQL_STAGE} st, status from tagged where tag <> 'Non-descript')" + " select tag as therapy, " + ", ".join(f"count(*) filter (st = '{s}') as {s.lower().replace(': ', '_').replace(' ', '_').replace('+', '_up')}" for s in landscape.STAGES) + f", count(*) filter (status in ({', '.join(repr(x) for x in landscape.RECRUITING)})) as recruiting, count(*) as total from g group by 1",
    "source_report": _SQL_REPORT + " select * from r",
    "flow_totals": _SQL_REPORT + " select sum(matched) as matched, bool_and(status <> 'No response' and matched is not null) as matched_complete, sum(retrieved) as retrieved, greatest(0, sum(retrieved) - (select count(*) from f)) as merged, (select count(*) from f) as unique_n from r",
    "consensus_edges": "select modality, virus_family, count(*) as n, count(distinct vector_role) as n_sources, string_agg(distinct axp_id, ';' order by axp_id) as refs from program join virus using (axp_id) where modality is not null group by 1, 2 having count(distinct vector_role) >= 2",
    "gap_analysis": "select journal, count(*) as total, count(distinct source) as n_sources, case when count(*) >= 20 and count(distinct source) >= 3 then 'SUFFICIENT' else 'GAP' end as verdict from articles where journal is not null group by 1",
    "agreement_wilson": """with a as (select trim(source) source, lower(trim(doi)) k, try_cast(publication_date[1:4] as int) y from articles), p as (select lower(trim(doi)) k, list(distinct pub_year) filter (pub_year is not null) ys from paper group by 1),
c as (select a.source, count(y) tagged, count(*) filter (y is not null and list_contains(coalesce(ys, []), y)) supported, count(*) filter (y is not null and len(coalesce(ys, [])) > 0 and not list_contains(ys, y)) conflict,
 count(*) filter (y is not null and len(coalesce(ys, [])) = 0) unsupported, count(*) filter (y is null and len(coalesce(ys, [])) > 0) missed, count(*) filter (y is null and len(coalesce(ys, [])) = 0) both_none from a left join p using (k) group by 1),
w as (select *, supported / nullif(tagged, 0)::double p, 1 + 1.96 * 1.96 / nullif(tagged, 0)::double den from c)
select source, tagged, supported, conflict, unsupported, missed, both_none, round(p, 6) as rate, case when tagged > 0 then round(greatest(0, (p + 1.96 * 1.96 / (2 * tagged)) / den - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * tagged)) / tagged) / den), 6) end as low,
 case when tagged > 0 then round(least(1, (p + 1.96 * 1.96 / (2 * tagged)) / den + 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * tagged)) / tagged) / den), 6) end as high from w""",
    "descriptor_proposals": "with t as (select distinct version_id, unnest(from_json(record->'conditions', '[\"VARCHAR\"]')) term from trial_version) select term, count(*) as n from t where term not in (select alias from alias) group by 1 having count(*) >= 5",
    "doi_sets": "with a as (select distinct lower(trim(doi)) k from articles where doi is not null), p as (select distinct lower(trim(doi)) k from paper where doi is not null) select k, case when p.k is null then 'articles' when a.k is null then 'paper' else 'both' end as part from a full join p using (k)",
    "ragged_union": "with u as (select 0 o, 'articles' source, article_id::varchar r, journal, null::int pub_year from articles union all select 1, 'paper', pmid, null, pub_year from paper union all select 2, 'program', axp_id, null, null from program) select o * 1099511627776 + row_number() over (partition by o order by r) as row_id, source, r as ref, journal, pub_year from u",
    "upsert_latest": "select coalesce(nullif(lower(trim(doi)), ''), md5(title)) as k, arg_max(article_id, (retrieved_at, article_id)) as article_id from articles group by 1",
    "clean_text": """select article_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(title, '(?i)<br\\s*/?>', '; ', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as plain,
 md5(coalesce(doi, 'NA') || '|NA|' || coalesce(title, 'NA')) as item_key, regexp_replace(regexp_replace(lower(coalesce(journal, '')), '[^\\pL\\pN]', '-', 'g'), '^-+|-+$', '', 'g') as slug from articles""",
    "markdown_titles": "select article_id, regexp_replace(title, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g') as title, replace(replace(replace(replace(replace(replace(doi, '%', '%25'), ' ', '%20'), '(', '%28'), ')', '%29'), '<', '%3C'), '>', '%3E') as target from articles",
    "publication_dates": f"select article_id, ({_SQL_DAY})::varchar as day from articles",
    "date_span": f"select trim(source) as source, min({_SQL_DAY})::varchar as first_day, max({_SQL_DAY})::varchar as last_day from articles group by 1",
    "inverted_roundtrip": "select article_id, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) as rebuilt from articles where abstract is not null",
    "ris_export": "select article_id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, nullif(array_to_string(list_transform(list_filter(string_split_regex(coalesce(authors, ''), ';\\s*'), lambda x: x <> ''), lambda x: 'AU  - ' || x), chr(10)), ''), 'DO  - ' || doi, 'PY  - ' || publication_date[1:4], 'ER  - ') as ris from articles",
    "plot_filter": f"select article_id from (select *, {_SQL_DAY} dd from articles) where dd between '2018-01-01' and '2020-12-31' and is_open_access order by abstract is not null desc, dd desc, article_id limit 200",
}

QUERIES = {
    f.__name__: f
    for f in (
        term_search_topk, term_search_sources, source_filter, round_robin_page, like_search, normal_records, normal_authors, decoded_titles, title_key_groups, resolve_doi_groups, resolve_fill, resolve_kept, resolve_works, resolve_verified,
        tag_virus, tag_conditions, tag_modality, tag_override, bioinformatics_flag, landscape_pivot, source_report, flow_totals, consensus_edges, gap_analysis, agreement_wilson, descriptor_proposals, doi_sets, ragged_union,
        upsert_latest, clean_text, safe_html, markdown_titles, publication_dates, date_span, inverted_roundtrip, ris_export, plot_filter,
    )
}
