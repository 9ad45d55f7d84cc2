"""File sources behind one protocol: Parquet, JSON, XML, CSV and TSV, each source isolated from the others' failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class FileSource:
    """A named source of records: files of one format below a path, optionally mapped to the common schema."""

    name: str
    path: str
    format: str = "parquet"
    schema: StructType | str | None = None
    options: dict[str, str] = field(default_factory=dict)
    adapt: Callable[[DataFrame], DataFrame] | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        df = reader.load(self.path)
        return self.adapt(df) if self.adapt else df


def json_log(name: str, path: str, schema: StructType | str) -> FileSource:
    """One JSON object per file or line in nested folders; broken lines become null rows."""
    return FileSource(name, path, "json", schema, {"recursiveFileLookup": "true", "mode": "PERMISSIVE"})


def xml_records(name: str, path: str, row_tag: str, schema: StructType | str | None = None) -> FileSource:
    """Records of one tag in XML files."""
    return FileSource(name, path, "xml", schema, {"rowTag": row_tag})


def strict_tsv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a tab-separated file: the header must be exactly ``columns`` and each line has as many cells."""
    lines = spark.read.text(path).withColumn("cells", F.split("value", "\t"))
    header = spark.read.option("sep", "\t").option("quote", "").option("header", "true").csv(path).columns
    body = lines.where(F.col("value") != "\t".join(header)).where("value <> ''")
    ok = (F.size("cells") == len(columns)) & F.lit(header == columns)
    rows = body.where(ok).select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    why = F.when(F.lit(header != columns), "header").otherwise("cells")
    return rows, body.where(~ok).select(F.col("value").alias("line"), why.alias("problem"))


def with_file_name(df: DataFrame, column: str = "file_name") -> DataFrame:
    """The name of the file each row was read from."""
    return df.withColumn(column, F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_all(spark: SparkSession, sources: list[FileSource]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Plans of the sources that can be read, and a status row for each: one that fails leaves the others alone."""
    plans, status = {}, []
    for s in sources:
        try:
            plans[s.name] = s.read(spark)
            status.append((s.name, "ok", None))
        except PySparkException as e:
            status.append((s.name, "failed", e.getCondition() or type(e).__name__))
    return plans, spark.createDataFrame(status, "source string, status string, error string")


def _sections(xml: str | None) -> list[dict[str, str | None]]:
    if not xml:
        return []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    body = root if root.tag.rpartition("}")[2] == "body" else next((e for e in root.iter() if e.tag.rpartition("}")[2] == "body"), None)
    if body is None:
        return []
    plain = lambda e: " ".join("".join(e.itertext()).split())
    named = lambda e, name: [c for c in e if isinstance(c.tag, str) and c.tag.rpartition("}")[2] == name]
    out = []
    for sec in (e for e in body.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "sec"):
        own = " ".join(plain(p) for p in named(sec, "p"))
        if own:
            out.append({"title": next((plain(t) for t in named(sec, "title")), None), "text": own})
    return out or ([{"title": None, "text": whole}] if (whole := plain(body)) else [])


def jats_sections(df: DataFrame, xml: str) -> DataFrame:
    """df with ``sections``: (title, text) of every section of an article body, its own paragraphs only; the whole body if there are none, an empty list where it can't be read."""
    return df.withColumn("sections", F.pandas_udf(lambda s: s.map(_sections), "array<struct<title:string,text:string>>")(xml))


def sectioned_text(sections: Column) -> Column:
    """Sections in one text, each under its title."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.when(s["title"].isNotNull(), F.concat(F.lit("--- "), s["title"], F.lit(" ---\n"))).otherwise(""), s["text"])), "\n\n")


def verified_import(spark: SparkSession, path: str, schema: StructType | str, digest: Column, stored: str) -> tuple[DataFrame, DataFrame]:
    """(rows, mismatches) of JSON lines, packed or not: rows whose digest, computed anew, is the stored one, and the others."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("__same", F.coalesce(digest == F.lower(F.col(stored)), F.lit(False)))
    return df.where("__same").drop("__same"), df.where("not __same").drop("__same")
