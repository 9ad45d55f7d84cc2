"""Weighted tagging of records with a vocabulary.

Per category the aliases are counted in title and abstract, after blanking phrases that only look like an alias and
aliases of more specific categories; 20 for the title, 3 for the abstract, a primary tag from 6 on.  Each count is
guarded by a test for a literal that any match must hold, so most patterns never run.  Null and empty texts count
nothing; every row keeps its other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.plans.vocabulary import Compiled, Vocabulary, names_pattern

TITLE, ABSTRACT, PRIMARY = 20, 3, 6
NONE = "Non-descript"
# Phrases that hold an alias but do not name the organism or cell.
CONTEXT_MASKS = {
    "latin_ad": r"(?<![A-Za-z0-9])(?i:ad[\s-]+(?:hoc|libitum|lib|infinitum|interim|nauseam|hominem|valorem))(?![A-Za-z0-9])",
    "washington_dc": r"Washington,?\s*D\.?\s?C\.?(?![A-Za-z0-9])",
    "direct_current": r"(?<![A-Za-z0-9])DC[\s-]+(?i:current|voltage|power|bias|motor|field)(?![A-Za-z0-9])",
    "vector_parts": r"(?<![A-Za-z0-9])(?:CMV|hCMV|SV40|RSV|MoMLV|MMLV|MSCV)(?:[\s-]*IE)?[\s-]*(?i:promoters?|enhancers?|LTR|NLS|nuclear localization|ori|origin of replication|poly ?\(?A\)?|pA|intron|terminator)(?![A-Za-z0-9])",
    "lymphodepletion": r"(?i:lympho(?:cyte)?[\s-]*depleti(?:ng|on)(?:[\s-]+(?:chemotherapy|regimen))?)",
    "negated_hyphen": r"(?<![A-Za-z0-9])[A-Za-z0-9+]+(?:-[A-Za-z0-9+]+)*-(?i:negative|seronegative|uninfected)(?![A-Za-z0-9])",
    "negated_space": r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9+]*(?:-[A-Za-z0-9+]+)*\s+(?i:negative|seronegative|uninfected)(?![A-Za-z0-9])",
}
FED_AD_LIB, BARE_AD = r"(?i)(?<![A-Za-z0-9])ad[\s-]+lib", r"(?<![A-Za-z0-9])Ad(?![A-Za-z0-9])"
# a cheap test that every text with such a phrase passes: words of the phrases, whatever stands between them
_MAY_HOLD = r"(?i)(?<![A-Za-z0-9])(?:ad|dc)[\s-]|washington|cmv|sv40|rsv|momlv|mmlv|mscv|depleti|negative|uninfected"


def _with_match_text(df: DataFrame, raw: Column, out: str) -> DataFrame:
    """df with ``out``, the text as it is matched, and ``out``_low: no tags, no look-alike phrases, shouted texts in lower case.

    Each step is a column of its own, so that none is computed twice.
    """
    df = df.withColumn(out, F.regexp_replace(F.coalesce(raw, F.lit("")), r"<[^>]+>", ""))
    # texts that feed ad libitum call the group Ad
    fed = F.when(F.col(out).rlike(FED_AD_LIB), F.regexp_replace(out, BARE_AD, " ")).otherwise(F.col(out))
    masks = "|".join(f"(?:{m})" for m in CONTEXT_MASKS.values())
    df = df.withColumn(out, F.when(F.col(out).rlike(_MAY_HOLD), F.regexp_replace(fed, masks, " ")).otherwise(F.col(out)))
    shouted = ~F.col(out).rlike("[a-z]") & (F.length(F.regexp_replace(out, "[^A-Za-z]", "")) >= 12)
    return df.withColumn(out, F.when(shouted, F.lower(out)).otherwise(F.col(out))).withColumn(f"{out}_low", F.lower(out))


def _count(text: Column, lowered: Column, c: Compiled) -> Column:
    masked = F.regexp_replace(text, c.mask, " ") if c.mask else text
    guard = None
    for literal in c.needed:
        test = lowered.contains(literal)
        guard = test if guard is None else guard | test
    return F.when(guard, F.regexp_count(masked, F.lit(c.pattern))).otherwise(F.lit(0))


def scored(df: DataFrame, vocab: Vocabulary, title: str | None, abstract: str) -> DataFrame:
    """df with __s: an array of (score, -place, name, in title, in abstract), one entry per category."""
    cats = vocab.compiled()
    work = _with_match_text(_with_match_text(df, F.col(title) if title else F.lit(""), "__t"), F.col(abstract), "__a")
    counts = [F.struct(_count(F.col("__t"), F.col("__t_low"), c).alias("t"), _count(F.col("__a"), F.col("__a_low"), c).alias("a")) for c in cats]
    work = work.withColumn("__n", F.array(*counts)).drop("__t", "__a", "__t_low", "__a_low")
    names = F.array(*[F.lit(c.name) for c in cats])
    entry = F.transform("__n", lambda n, i: F.struct((n.t * TITLE + n.a * ABSTRACT).alias("score"), (-i).alias("ord"), F.get(names, i).alias("name"), (n.t > 0).alias("t"), (n.a > 0).alias("a")))
    return work.withColumn("__s", entry).drop("__n")


def tagged(df: DataFrame, vocab: Vocabulary, prefix: str, title: str | None, abstract: str, ties: str = "list") -> DataFrame:
    """df with primary_<prefix>, <prefix>_hits (array of names) and <prefix>_placed (name;Title and name;Abstract, titles first, or null).

    ties: ``list`` (vocabulary order) or ``name``.
    """
    s = scored(df, vocab, title, abstract)
    if ties == "name":
        s = s.withColumn("__b", F.element_at(F.array_sort(F.transform("__s", lambda x: F.struct((-x.score).alias("neg"), x["name"].alias("name"), x.score.alias("score")))), 1))
    else:
        s = s.withColumn("__b", F.array_max("__s"))
    hits = F.transform(F.filter("__s", lambda x: x.score > 0), lambda x: x["name"])
    where = lambda flag, label: F.transform(F.filter("__s", lambda x: x[flag]), lambda x: F.concat(x["name"], F.lit(f";{label}")))
    placed = F.concat(where("t", "Title"), where("a", "Abstract"))
    s = s.withColumn(f"primary_{prefix}", F.when(F.col("__b.score") >= PRIMARY, F.col("__b.name")).otherwise(NONE))
    return s.withColumn(f"{prefix}_hits", hits).withColumn(f"{prefix}_placed", F.when(F.size(placed) > 0, placed)).drop("__s", "__b")


def two_tier(df: DataFrame, vocab: Vocabulary, background: list[str], out: str, title: str | None, abstract: str) -> DataFrame:
    """df with ``out``: the best foreground category that reaches the threshold, else the best of all that does."""
    s = scored(df, vocab, title, abstract)
    front = F.array_max(F.filter("__s", lambda x: ~x["name"].isin(*background)))
    best = F.array_max("__s")
    tag = F.when(front["score"] >= PRIMARY, front["name"]).when(best["score"] >= PRIMARY, best["name"]).otherwise(NONE)
    return s.withColumn(out, tag).drop("__s")


# Phrases that mark computational work.
COMPUTATIONAL = [
    "bioinformatics", "bioinformatic", "computational biology", "genomics", "proteomics",
    "transcriptomics", "metagenomics", "phylogenetic", "phylogenetics", "sequence analysis",
    "sequence alignment", "multiple sequence alignment", "genome annotation",
    "statistical genetics", "systems biology", "machine learning", "deep learning",
    "neural network", "artificial intelligence", "r package", "bioconductor",
    "galaxy platform", "nextflow", "snakemake", "rna-seq", "scrna-seq", "single-cell rna sequencing",
    "chip-seq", "atac-seq", "whole-genome sequencing", "mass spectrometry", "network analysis",
    "pathway analysis", "gene set enrichment", "structural bioinformatics", "molecular modeling",
    "molecular modelling", "molecular docking", "molecular dynamics", "variant calling",
    "in silico",
]


def computational(title: Column, abstract: Column) -> Column:
    """Whether title or abstract, without markup, hold one of the phrases as whole words."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    return F.regexp_replace(text, "<[^>]+>", "").rlike(names_pattern(COMPUTATIONAL))


def mesh_axis(trees: Column) -> Column:
    """The axis of a descriptor by its tree numbers: virus, bacteria, or cell where it is both cell and blood or immune; else null."""
    under = lambda prefix: F.exists(trees, lambda t: t.startswith(prefix))
    return F.when(under("B04"), "virus").when(under("B03"), "bacteria").when(under("A11") & under("A15"), "cell")


def _matched(pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.length(F.regexp_extract(t, pattern, 0))


def descriptor_categories(mesh: DataFrame, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """term, axis, category of each descriptor that lies on an axis; category null where no name of the axis fits it.

    mesh: label, trees (array), terms (array of entry terms).  The category whose name matches the longest part of the
    label or an entry term counts; of equally long ones the first of the vocabulary, then the first text.
    """
    rows = mesh.select(F.col("label").alias("term"), mesh_axis(F.col("trees")).alias("axis"), F.concat(F.array("label"), F.coalesce("terms", F.array().cast("array<string>"))).alias("texts")).where("axis is not null")
    plain = F.transform("texts", lambda t: F.regexp_replace(F.trim(t), "[-/]+", " "))
    out = None
    for axis, vocab in vocabularies.items():
        found = [F.struct(F.array_max(F.transform("plain", _matched(c.pattern))).alias("n"), F.lit(-i).alias("o"), F.lit(c.name).alias("name")) for i, c in enumerate(vocab.compiled())]
        best = F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<n:int,o:int,name:string>")
        part = rows.where(F.col("axis") == axis).withColumn("plain", plain).withColumn("b", best).select("term", "axis", F.when(F.col("b.n") > 0, F.col("b.name")).alias("category"))
        out = part if out is None else out.unionByName(part)
    return out


def major_or_all(df: DataFrame, record_id: str, major: str, every: str, denied: list[str]) -> DataFrame:
    """id, pos, term: a record's major descriptors, or all of them where it has none; denied ones never count."""
    terms = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    chosen = F.when(F.size(terms(major)) > 0, terms(major)).otherwise(terms(every))
    return df.select(F.col(record_id).alias("id"), F.posexplode(chosen).alias("pos", "term")).where(~F.col("term").isin(*denied)) if denied else df.select(F.col(record_id).alias("id"), F.posexplode(chosen).alias("pos", "term"))


def unknown_descriptors(terms: DataFrame, lookup: DataFrame, budget: int) -> DataFrame:
    """The most frequent terms that the look-up table does not hold, at most ``budget`` of them (a look-up budget)."""
    return terms.join(lookup.select("term").distinct(), "term", "left_anti").groupBy("term").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "term").limit(budget)


def overridden(tags: DataFrame, terms: DataFrame, lookup: DataFrame, axis: str) -> DataFrame:
    """Curated terms over computed tags: the first mapped term replaces the tag, the first unmapped one only fills a missing tag.

    tags: id, tag.  terms: id, pos, term.  lookup: term, axis, category (null: the term has no category).
    """
    known = terms.join(lookup.where(F.col("axis") == axis), "term")
    first = known.groupBy("id").agg(
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("pos"))).alias("mapped"),
        F.min_by("term", F.when(F.col("category").isNull(), F.col("pos"))).alias("unmapped"),
    )
    tag = F.coalesce("mapped", F.when(F.col("tag") == NONE, F.col("unmapped")), "tag")
    return tags.join(first, "id", "left").select("id", tag.alias("tag"))


def longest_category(df: DataFrame, label: str, vocab: Vocabulary, out: str) -> DataFrame:
    """df with ``out``: the category whose alias matches the longest part of the label (the first on a tie), else the label itself."""
    text = F.regexp_replace(label, "[-/]", " ")
    found = [F.struct(F.length(F.regexp_extract(text, c.pattern, 0)).alias("n"), F.lit(-i).alias("o"), F.lit(c.name).alias("name")) for i, c in enumerate(vocab.compiled())]
    best = F.array_max(F.array(*found))
    return df.withColumn("__b", best).withColumn(out, F.when(F.col("__b.n") > 0, F.col("__b.name")).otherwise(F.col(label))).drop("__b")
