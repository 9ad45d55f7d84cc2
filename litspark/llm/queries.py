"""Queries of the text-corpus operators (problems 4, 5, 7, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.functions import ids
from litspark.llm import canonical, leakage, linkage, packing, survivor, truncation
from litspark.session import table

CAPACITY = 2048


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """articles with work_doi (the published DOI where filled), trust and real abstract."""
    rank = table(spark, d, "source_rank").select(F.lower(F.trim("source")).alias("src"), "trust_rank")
    doi = F.coalesce(ids.doi("published_doi"), ids.doi("doi"))
    return table(spark, d, "articles").select("article_id", "title", "retrieved_at", doi.alias("work_doi"), survivor.real_text(F.col("abstract")).alias("abs"), F.lower(F.trim("source")).alias("src")).join(rank, "src", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each work and the copy that supplies its abstract."""
    a = _copies(spark, d).where("work_doi is not null")
    order = [F.col("trust_rank"), F.col("abs").isNull().cast("int"), -F.unix_micros("retrieved_at")]
    found = survivor.survivors(a, F.col("work_doi"), F.col("article_id"), order, {"abstract": F.col("abs")})
    return found.select(F.col("first_id").alias("article_id"), "survivor_id", "abstract_id")


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    """Per work the existing title nearest to the token-level consensus of its copies, weighted by trust."""
    a = _copies(spark, d)
    title = survivor.real_text(F.regexp_replace("title", r"\s+", " "))
    weight = F.lit(1.0) / F.coalesce(F.col("trust_rank"), F.lit(1000))
    return survivor.consensus(a, F.col("work_doi"), title, weight).select(F.col("grp").alias("doi"), F.col("value").alias("title"), "n")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_names(table(spark, d, "intake_name"), "intake_id", "typed_name", table(spark, d, "alias"), "axp_id", "alias", "ambiguous")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The program meant by each typed name, or NONE."""
    return _mapped(spark, d).select(F.col("row_id").alias("intake_id"), F.col("entry_id").alias("axp_id"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per origin how many names fit exactly, fit after repair, or fit none."""
    m = _mapped(spark, d).join(table(spark, d, "intake_name").select(F.col("intake_id").alias("row_id"), "origin"), "row_id")
    none = F.col("entry_id") == canonical.NONE
    return m.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(~none & (F.col("score") >= 1)).alias("exact"), F.count_if(~none & (F.col("score") < 1)).alias("repaired"), F.count_if(none).alias("unmatched"))


GRANT_SOURCES = ("nih", "nsf")


def _links(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").where(~F.lower(F.trim("source")).isin(*GRANT_SOURCES))
    a = a.select(F.col("article_id").alias("id"), "title", ids.doi("doi").alias("own"), ids.doi("published_doi").alias("pub"), ids.year("publication_date").alias("year"), "journal")
    p = table(spark, d, "paper").select(F.col("pmid").alias("id"), "title", ids.doi("doi").alias("own"), F.lit(None).cast("string").alias("pub"), F.col("pub_year").alias("year"), "journal")
    # the published version of each preprint, for papers listed under their preprint's DOI
    versions = a.where("own is not null and pub is not null and own <> pub").groupBy("own").agg(F.min("pub").alias("version"))
    # registrants whose DOIs are preprints', one row each
    prefix = F.substring_index("own", "/", 1)
    shares = a.where("own is not null").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.avg((F.col("pub").isNotNull() & (F.col("pub") != F.col("own"))).cast("int")).alias("share"))
    preprints = shares.where("share >= 0.02").select(F.col("prefix").alias("registrant"), F.lit(True).alias("registers"))

    def side(df: DataFrame, version: str) -> DataFrame:
        work = F.coalesce("pub", version, "own")
        df = df.join(preprints, prefix == F.col("registrant"), "left")
        return df.select("id", "title", work.alias("work"), (F.when(F.col("own").isNotNull(), F.coalesce("registers", F.lit(False))) & (work == F.col("own"))).alias("preprint"), F.array("own", "pub", version).alias("dois"), "year", "journal")

    return linkage.link(side(a, "pub"), side(p.join(versions, "own", "left"), "version"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles and papers that are the same work."""
    return p7_links(spark, d).where("confidence >= 0.5").select("article_id", "pmid")


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of articles and papers with the confidence that they are the same work."""
    return _links(spark, d).select(F.col("l_id").alias("article_id"), F.col("r_id").alias("pmid"), F.round("confidence", 6).alias("confidence"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Which part of which document lies in which container of 2,048 tokens, and where in it."""
    counts = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    placed = packing.pack(counts, CAPACITY)
    return placed.select(F.col("key").alias("doc_id"), "part", "n_tokens", F.col("container").alias("container_id"), "offset_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them and the share of their room that is used."""
    boxes = p8_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / F.count("*") / CAPACITY, 4).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold thirty or more running words of an evaluation passage."""
    found = leakage.contained_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "passage")
    return found.select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation suite and split the items that leaked, and into how many documents."""
    leaked = p9_found(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
    items = table(spark, d, "eval_item").select("item_id", "suite", "split_name").join(leaked, "item_id", "left")
    return items.groupBy("suite", "split_name").agg(F.count("*").alias("n_items"), F.count("docs").alias("n_leaked"), F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text ends before its own end."""
    return truncation.truncated(table(spark, d, "documents"), "doc_id", "text", "source").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source its documents, how many were cut, and the share."""
    docs = table(spark, d, "documents")
    found = truncation.truncated(docs, "doc_id", "text", "source").select("doc_id", F.lit(1).alias("hit"))
    all_ = docs.select("doc_id", F.lower(F.trim("source")).alias("source")).join(found, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("hit").alias("n_cut"))
    return all_.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))


_DOI_SQL = "nullif(regexp_replace(regexp_extract(replace(regexp_replace(lower({c}), '[\\s\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '%2f', '/'), '(10\\.[0-9]{{4,9}}/.+)$', 1), '[.,;:)\\]]+$', ''), '')"
_NO_TEXT_SQL = ", ".join("'" + t + "'" for t in survivor.NO_TEXT)
_P4_SQL = f"""
with a as (select article_id, coalesce({_DOI_SQL.format(c="published_doi")}, {_DOI_SQL.format(c="doi")}) g, lower(trim(source)) s, retrieved_at,
      case when lower(trim(abstract, E' \\t\\n\\r')) in ({_NO_TEXT_SQL}) then null else trim(abstract, E' \\t\\n\\r') end ab from articles),
r as (select a.*, coalesce(trust_rank, 100000) t, count(*) over (partition by g) n from a left join source_rank k on lower(trim(k.source)) = a.s where g is not null)
select min(article_id) as article_id, arg_min(article_id, (t, case when ab is null then 1 else 0 end, -epoch_us(retrieved_at), article_id)) as survivor_id,
       coalesce(arg_max(case when ab is not null then article_id end, (length(ab), -article_id)) filter (ab is not null), 0) as abstract_id
from r where n > 1 group by g
"""

QUERIES = {"p4_found": p4_found, "p4_titles": p4_titles, "p5_found": p5_found, "p5_report": p5_report, "p7_found": p7_found, "p7_links": p7_links, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_sources": p10_sources}
SQL = {"p4_found": _P4_SQL}
