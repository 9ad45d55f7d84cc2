"""Vocabularies from tables, masks of look-alike phrases, curated descriptors."""

import pytest
from pyspark.sql import functions as F

from litspark.operators import tagging
from litspark.plans import vocabulary
from litspark.plans.vocabulary import Name, Vocabulary

WORDS = Vocabulary("v", {"Adenovirus": ["Ad", "adenovirus"], "Dendritic": ["DC", "dendritic cell"], "Cytomegalovirus": ["CMV"], "Chemotherapy": ["chemotherapy"], "HIV": ["HIV"], "CD4": ["CD4"], "T cell": ["T cell"]})


def _hits(spark, titles):
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string").withColumn("abstract", F.lit(None).cast("string"))
    return [sorted(r.v_hits) for r in tagging.tagged(df, WORDS, "v", "title", "abstract").orderBy("i").collect()]


def test_masks(spark):
    cases = {
        "an ad hoc test": [], "an ad  hoc test": [], "Ad\nhoc": [], "Ad was given": ["Adenovirus"], "Ad libitum; Ad + HF": [], "fed ad lib, Ad and adenovirus": ["Adenovirus"],
        "in Washington, D.C.": [], "DC current": [], "DC\ncurrent": [], "DC-voltage and DC": ["Dendritic"], "a CMV promoter": [], "CMV-IE enhancer": [], "CMV infection": ["Cytomegalovirus"], "hCMV": [],
        "lymphodepleting chemotherapy": [], "lymphocyte depletion": [], "chemotherapy": ["Chemotherapy"], "HIV-negative men": [], "HIV seronegative men": [], "CD4 negative": [], "T cell negative selection": ["T cell"], "HIV and CD4": ["CD4", "HIV"],
        "HEARING ADS FOR DC IN CMV": [], "ADENOVIRUS IN ALL PEOPLE": ["Adenovirus"], "<b>A</b>denovirus": ["Adenovirus"], "": [],
    }
    assert dict(zip(cases, _hits(spark, list(cases)), strict=True)) == cases


def test_names():
    assert Name("T cell").pattern == r"T[\s\p{Z}\-]+cell" and Name("CD8+ T").inside(Name("CD8+ T-cell line")) and not Name("T cell").inside(Name("NT cell")) and not Name("AD").inside(Name("Ad 5")) and Name("ad hoc").inside(Name("an Ad-hoc one"))
    assert Name("AAV").exact and not Name("aav").exact and not Name("A B").exact and not Name("AAVAAV").exact
    masks = Vocabulary("m", {"a": ["carcinoma"], "b": ["Lung carcinoma", "lung"], "c": ["x"]}).masks()
    assert masks == {"a": ["Lung carcinoma"], "b": [], "c": []}


def test_vocabulary_from_a_table(spark):
    df = spark.createDataFrame([("B", "b1"), ("A", "a2"), ("A", "a1 "), ("A", "a1"), (None, "x"), ("C", " ")], "c string, n string")
    assert vocabulary.from_table("v", df, "c", "n").categories == {"A": ["a1", "a2"], "B": ["b1"]}
    with pytest.raises(ValueError, match="more than 2"):
        vocabulary.from_table("v", df, "c", "n", most=2)


def test_curated_descriptors(spark):
    mesh = spark.createDataFrame(
        [("Herpesvirus 1, Human", ["B04.1"], ["HSV-1"]), ("Norovirus", ["B04.2"], None), ("T-Lymphocytes", ["A11.1", "A15.2"], ["CD8+ T cell"]), ("Listeria", ["B03.1"], []), ("Neoplasms", ["C04"], []), ("Skin", ["A17"], [])],
        "label string, trees array<string>, terms array<string>",
    )
    voc = {"virus": Vocabulary("virus", {"Herpes Simplex Virus": ["HSV 1", "herpes simplex virus"]}), "cell": Vocabulary("cell", {"T cell": ["T cell"], "CD8 T cell": ["CD8+ T cell"]}), "bacteria": Vocabulary("bacteria", {})}
    got = {(r.term, r.axis, r.category) for r in tagging.descriptor_categories(mesh, voc).collect()}
    assert got == {("Herpesvirus 1, Human", "virus", "Herpes Simplex Virus"), ("Norovirus", "virus", None), ("T-Lymphocytes", "cell", "CD8 T cell"), ("Listeria", "bacteria", None)}
    recs = spark.createDataFrame([(1, "Norovirus; Herpesvirus 1, Human", "Skin"), (2, None, "Norovirus"), (3, "", ""), (4, "Skin", None)], "i int, major string, every string")
    terms = tagging.major_or_all(recs, "i", "major", "every", ["Skin"])
    assert {(r.id, r.term) for r in terms.collect()} == {(1, "Norovirus"), (1, "Herpesvirus 1, Human"), (2, "Norovirus")}
    tags = spark.createDataFrame([(1, "Adenovirus"), (2, tagging.NONE), (3, "Adenovirus"), (4, tagging.NONE)], "id int, tag string")
    lookup = tagging.descriptor_categories(mesh, voc)
    assert {(r.id, r.tag) for r in tagging.overridden(tags, terms, lookup, "virus").collect()} == {(1, "Herpes Simplex Virus"), (2, "Norovirus"), (3, "Adenovirus"), (4, tagging.NONE)}
    assert [r.term for r in tagging.unknown_descriptors(terms, lookup.where("term <> 'Norovirus'"), 5).collect()] == ["Norovirus"]


def test_computational(spark):
    df = spark.createDataFrame([("An RNA-seq <i>study</i>", None), ("genomics", "x"), ("metagenomic", None), (None, "deep  learning"), (None, None)], "t string, a string")
    assert [r.x for r in df.select(tagging.computational(F.col("t"), F.col("a")).alias("x")).collect()] == [True, True, False, True, False]
