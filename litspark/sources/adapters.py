"""Saved pages of literature services, brought to the common record schema.

Each adapter takes a DataFrame of one service's records (its own nested or flat shape, with whatever members are there)
and gives the common columns; ``SERVICES`` names how the pages of each service hold their records.  ``read_service``
reads a folder of saved pages with a stated schema, so a broken page gives null rows, which are left out, and does not
take the others down.  Fetching itself (keys, paging, retries) is not done here.

Defined results: absent and null members give null; records without a title and an id are left out; repeated records
stay (resolution is a step of its own); empty folders give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from litspark.functions import text

TEXTS = (
    "title", "abstract", "authors", "affiliations", "publication_date", "url", "doi", "pmid", "pmcid", "nct_id", "grant_id", "source", "journal", "is_open_access", "mesh_major", "mesh_all", "published_doi",
)
RECORD = StructType([StructField(n, StringType()) for n in TEXTS] + [StructField("is_retracted", BooleanType())])


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def joined(c: Column, separator: str = "; ") -> Column:
    """The values of a list in one text; null if there are none."""
    return F.nullif(F.array_join(F.filter(F.transform(c, lambda x: F.trim(x.cast("string"))), lambda x: x != ""), separator), F.lit(""))


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    cols = [(F.lit(source) if f.name == "source" else columns.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    return df.select(*cols).where(F.col("title").isNotNull() | F.col("doi").isNotNull() | F.col("grant_id").isNotNull() | F.col("nct_id").isNotNull())


def europe_pmc(df: DataFrame) -> DataFrame:
    heads = F.filter("meshHeadingList.meshHeading", lambda m: m["descriptorName"].isNotNull())
    names = lambda ms: joined(F.transform(ms, lambda m: m["descriptorName"]))
    authors = F.regexp_replace(F.regexp_replace(F.trim("authorString"), r"\.\s*$", ""), r",\s+", "; ")
    return _record(
        df, "EPMC", title=blank(F.col("title")), abstract=blank(F.col("abstractText")), authors=blank(authors), publication_date=blank(F.col("firstPublicationDate")), doi=text.normal_doi("doi"), pmid=blank(F.col("pmid")), pmcid=blank(F.col("pmcid")),
        url=F.concat(F.lit("https://europepmc.example/article/"), "source", F.lit("/"), "id"), journal=blank(F.col("journalInfo.journal.title")), is_open_access=blank(F.col("isOpenAccess")), affiliations=joined(F.transform("authorList.author", lambda a: a["affiliation"])),
        is_retracted=F.exists(F.coalesce("pubTypeList.pubType", F.array().cast("array<string>")), lambda t: F.lower(t).contains("retract")),
        mesh_major=names(F.filter(heads, lambda m: m["majorTopic_YN"] == "Y")), mesh_all=names(heads),
    )


def openalex(df: DataFrame) -> DataFrame:
    return _record(
        df, "OpenAlex", title=blank(F.col("display_name")), abstract=blank(text.inverted_text(F.col("abstract_inverted_index"))), authors=joined(F.transform("authorships", lambda a: a["author"]["display_name"])), affiliations=affiliations_json(F.col("authorships")),
        publication_date=blank(F.col("publication_date")), doi=text.normal_doi("doi"), url=blank(F.col("id")), journal=blank(F.col("primary_location.source.display_name")), is_open_access=F.when(F.col("open_access.is_oa"), "Y").otherwise("N"), is_retracted=F.coalesce("is_retracted", F.lit(False)),
        pmid=F.nullif(F.regexp_extract("ids.pmid", r"([0-9]+)/?$", 1), F.lit("")),
    )


def affiliations_json(authorships: Column) -> Column:
    """The institutions of each author as a JSON list of lists."""
    return F.to_json(F.transform(authorships, lambda a: F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"])))


def trial_registry(df: DataFrame) -> DataFrame:
    p = "protocolSection."
    return _record(
        df, "clinicaltrials.gov", title=blank(F.coalesce(F.col(p + "identificationModule.briefTitle"), F.col(p + "identificationModule.officialTitle"))), abstract=blank(F.col(p + "descriptionModule.briefSummary")), nct_id=blank(F.col(p + "identificationModule.nctId")),
        authors=blank(F.col(p + "sponsorCollaboratorsModule.leadSponsor.name")), url=F.concat(F.lit("https://clinicaltrials.example/study/"), p + "identificationModule.nctId"),
        publication_date=text.join_date_label(F.col(p + "statusModule.startDateStruct.date"), F.col(p + "statusModule.completionDateStruct.date"), F.col(p + "statusModule.overallStatus")),
    )


def nih_projects(df: DataFrame) -> DataFrame:
    """One row per fiscal year of a project; the core project number is the grant's id."""
    built = F.concat(F.lit("https://reporter.example/project-details/"), blank(F.col("appl_id")))
    return _record(
        df, "NIH", title=blank(F.col("project_title")), abstract=blank(F.col("abstract_text")), authors=blank(F.col("contact_pi_name")), affiliations=blank(F.col("organization.org_name")), publication_date=text.normal_date("project_start_date"),
        url=F.coalesce(blank(F.col("project_detail_url")), built), grant_id=blank(F.col("core_project_num")),
    )


def nsf_awards(df: DataFrame) -> DataFrame:
    return _record(
        df, "NSF", title=blank(F.col("title")), abstract=blank(F.col("abstractText")), authors=blank(F.col("pdPIName")), affiliations=blank(F.col("awardeeName")), publication_date=blank(F.col("date")),
        url=F.concat(F.lit("https://nsf.example/showAward?AWD_ID="), blank(F.col("id"))), grant_id=blank(F.col("id")),
    )


def core_works(df: DataFrame) -> DataFrame:
    return _record(
        df, "CORE", title=blank(F.col("title")), abstract=blank(F.col("abstract")), authors=joined(F.transform("authors", lambda a: a["name"])), publication_date=text.normal_date(F.coalesce("publishedDate", F.col("yearPublished").cast("string"))),
        doi=text.normal_doi("doi"), url=F.coalesce(blank(F.col("downloadUrl")), F.concat(F.lit("https://core.example/works/"), F.col("id").cast("string"))), journal=joined(F.transform("journals", lambda j: j["title"])),
    )


def patents(df: DataFrame) -> DataFrame:
    """The publication number, else the patent number, else the application number names a patent."""
    m = "applicationMetaData."
    number = F.coalesce(blank(F.col(m + "earliestPublicationNumber")), blank(F.col(m + "patentNumber")), blank(F.col("applicationNumberText")))
    return _record(
        df, "Patent", title=blank(F.col(m + "inventionTitle")), authors=joined(F.transform(m + "inventorBag", lambda i: i["inventorNameText"])), affiliations=joined(F.transform(m + "applicantBag", lambda i: i["applicantNameText"])),
        publication_date=F.coalesce(blank(F.col(m + "earliestPublicationDate")), blank(F.col(m + "grantDate")), blank(F.col(m + "filingDate"))), url=F.concat(F.lit("https://patents.example/"), number), grant_id=number,
    )


def scopus(df: DataFrame) -> DataFrame:
    return _record(
        df, "Scopus", title=blank(F.col("dc_title")), authors=blank(F.col("dc_creator")), publication_date=blank(F.col("prism_coverDate")), doi=text.normal_doi("prism_doi"), journal=blank(F.col("prism_publicationName")), pmid=blank(F.col("pubmed_id")),
        affiliations=joined(F.transform("affiliation", lambda a: a["affilname"])), is_open_access=F.when(F.col("openaccessFlag"), "Y").otherwise("N"),
    )


def enriched(records: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Records whose missing abstract comes from a table by DOI.  abstracts: doi, abstract; of several the longest."""
    best = abstracts.where("trim(abstract) <> ''").groupBy(F.lower(text.normal_doi("doi")).alias("__d")).agg(F.max(F.struct(F.length("abstract"), "abstract"))["abstract"].alias("__a"))
    return records.join(best, F.lower("doi") == F.col("__d"), "left").withColumn("abstract", F.coalesce("abstract", "__a")).drop("__d", "__a")


def preprints(df: DataFrame) -> DataFrame:
    return _record(
        df, "bioRxiv", title=blank(F.col("title")), abstract=blank(F.col("abstract")), authors=text.normal_authors("authors"), publication_date=blank(F.col("date")), doi=text.normal_doi("doi"),
        published_doi=F.when(~F.upper("published").isin("NA", ""), text.normal_doi("published")), affiliations=blank(F.col("author_corresponding_institution")), journal=blank(F.col("server")),
    )


def pubmed(df: DataFrame) -> DataFrame:
    """Articles of PubMed XML (row tag PubmedArticle)."""
    a = "MedlineCitation.Article."
    return _record(
        df, "PubMed", title=blank(F.col(a + "ArticleTitle")), abstract=joined(F.col(a + "Abstract.AbstractText"), " "), authors=joined(F.transform(a + "AuthorList.Author", lambda x: F.concat_ws(" ", x["LastName"], x["Initials"]))),
        publication_date=F.col(a + "Journal.JournalIssue.PubDate.Year").cast("string"), pmid=F.col("MedlineCitation.PMID").cast("string"), journal=blank(F.col(a + "Journal.Title")),
    )


PUBMED = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<LastName:string,Initials:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>>>"
)


@dataclass(frozen=True)
class Service:
    """schema: of a saved page; records: the path of its list of records; adapt: to the common schema."""

    schema: str
    records: str
    adapt: Callable[[DataFrame], DataFrame]


_PROTOCOL = (
    "protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,descriptionModule:struct<briefSummary:string>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,"
    "statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,completionDateStruct:struct<date:string>>>"
)
SERVICES = {
    "epmc": Service(
        "resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,authorList:struct<author:array<struct<fullName:string,affiliation:string>>>,abstractText:string,firstPublicationDate:string,"
        "journalInfo:struct<journal:struct<title:string>>,isOpenAccess:string,pubTypeList:struct<pubType:array<string>>,meshHeadingList:struct<meshHeading:array<struct<descriptorName:string,majorTopic_YN:string>>>>>>",
        "resultList.result", europe_pmc,
    ),
    "openalex": Service(
        "results array<struct<id:string,doi:string,display_name:string,publication_date:string,is_retracted:boolean,ids:struct<pmid:string>,open_access:struct<is_oa:boolean>,primary_location:struct<source:struct<display_name:string>>,"
        "authorships:array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>,abstract_inverted_index:map<string,array<int>>>>",
        "results", openalex,
    ),
    "clinicaltrials": Service(f"studies array<struct<{_PROTOCOL}>>", "studies", trial_registry),
    "nih": Service("results array<struct<project_title:string,abstract_text:string,contact_pi_name:string,organization:struct<org_name:string>,project_start_date:string,project_detail_url:string,appl_id:string,core_project_num:string,fiscal_year:int>>", "results", nih_projects),
    "nsf": Service("response struct<award:array<struct<id:string,title:string,abstractText:string,pdPIName:string,awardeeName:string,date:string>>>", "response.award", nsf_awards),
    "core": Service("results array<struct<id:string,title:string,abstract:string,authors:array<struct<name:string>>,publishedDate:string,yearPublished:int,doi:string,downloadUrl:string,journals:array<struct<title:string>>>>", "results", core_works),
    "patents": Service(
        "patentFileWrapperDataBag array<struct<applicationNumberText:string,applicationMetaData:struct<inventionTitle:string,earliestPublicationNumber:string,patentNumber:string,earliestPublicationDate:string,grantDate:string,filingDate:string,"
        "inventorBag:array<struct<inventorNameText:string>>,applicantBag:array<struct<applicantNameText:string>>>>>",
        "patentFileWrapperDataBag", patents,
    ),
    "scopus": Service("entry array<struct<dc_title:string,dc_creator:string,prism_coverDate:string,prism_doi:string,prism_publicationName:string,pubmed_id:string,openaccessFlag:boolean,affiliation:array<struct<affilname:string>>>>", "entry", scopus),
    "preprints": Service("collection array<struct<title:string,abstract:string,authors:string,date:string,doi:string,published:string,author_corresponding_institution:string,server:string>>", "collection", preprints),
}


def read_service(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The records of one service's saved pages below path, in the common schema."""
    s = SERVICES[name]
    pages = spark.read.schema(s.schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return s.adapt(pages.select(F.explode(s.records).alias("r")).where("r is not null").select("r.*"))


def read_services(spark: SparkSession, folder: str, wanted: dict[str, bool]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The wanted services that can be read, and a status row (ok, partial, failed) for each; a failure leaves the others alone.

    wanted: by name, whether the service is asked.  A page that can't be parsed makes its service partial.
    """
    plans, status = {}, []
    for name, asked in wanted.items():
        if not asked:
            continue
        path = f"{folder.rstrip('/')}/{name}"
        try:
            broken = spark.read.schema(f"{SERVICES[name].schema}, _broken string").option("recursiveFileLookup", "true").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").json(path)
            # a query of the broken pages alone is refused, so the whole ones are counted along
            n_broken, n_pages, _ = broken.agg(F.count("_broken"), F.count("*"), F.count(SERVICES[name].records)).head()
            plans[name] = read_service(spark, name, path)
            status.append((name, "ok" if not n_broken else "partial" if n_broken < n_pages else "failed", n_pages))
        except (PySparkException, KeyError) as e:
            status.append((name, "failed", None if isinstance(e, KeyError) else 0))
    return plans, spark.createDataFrame(status, "source string, status string, pages long")


def author_affiliations(authors: Column, affiliations: Column) -> Column:
    """JSON list of every author with the record's affiliations, or the words for none."""
    names = F.when(authors.isNotNull(), F.split(authors, "; ")).otherwise(F.array().cast("array<string>"))
    return F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), F.coalesce(affiliations, F.lit("No affiliation available")).alias("affiliations"))))


def nsf_keyword(query: str) -> str:
    """Terms that must all occur, joined for the awards search; phrases keep their quotes."""
    from litspark.operators.search import terms

    return " AND ".join(f'"{t}"' if " " in t else t for t in terms(query))


def core_query(query: str) -> str:
    """A plain query looks into title and abstract; one with a field (a colon) stays."""
    plain = query.replace('"', " ").strip()
    return query if ":" in query else f'(title:"{plain}" OR abstract:"{plain}")'


def batched_terms(names: list[str], most: int, longest: int) -> list[list[str]]:
    """Different spellings in batches of at most ``most`` terms and ``longest`` characters as one query; a term beyond that is alone."""
    seen: dict[str, str] = {}
    for n in names:
        t = " ".join(n.replace('"', " ").split())
        if t:
            seen.setdefault(t.lower(), t)
    batches: list[list[str]] = []
    size = 0
    for t in sorted(seen.values(), key=lambda t: (t.lower(), t)):
        more = len(t) + 2 + (4 if batches and batches[-1] else 0)
        if not batches or len(batches[-1]) >= most or size + more > longest:
            batches.append([])
            size, more = 0, len(t) + 2
        batches[-1].append(t)
        size += more
    return batches
