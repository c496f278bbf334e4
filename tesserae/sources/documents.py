"""Document sources: manifest and JSON files, and corpora over Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT, MANIFEST, REQUIRED


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """{"version", "documents", "indexes"} of manifest.json; a missing or broken one is an error."""
    try:
        row = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/manifest.json").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no manifest in {folder}") from e
    except Exception as e:
        raise ValueError(f"the manifest in {folder} can't be read") from e
    if row is None or row["version"] is None or row["documents"] is None:
        raise ValueError(f"the manifest in {folder} can't be read")
    return row.asDict(recursive=True)


def load_documents(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """The manifest's documents, sorted by id; any missing, broken or incomplete file fails the load."""
    manifest = manifest or read_manifest(spark, folder)
    paths = [f"{folder}/{name}" for name in manifest["documents"]]
    if not paths:
        return spark.createDataFrame([], DOCUMENT)
    try:
        docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    except AnalysisException as e:
        raise FileNotFoundError(f"a document of {folder} is missing") from e
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED])
    try:
        bad = docs.where(~whole).count()
    except Exception as e:
        raise ValueError(f"a document of {folder} can't be read") from e
    if bad:
        raise ValueError(f"{bad} documents of {folder} lack a required field")
    return docs.orderBy("id")


def as_corpus(docs: DataFrame) -> DataFrame:
    """Documents in the engine's columns; missing tags are empty, a missing heading level is 0."""
    level = F.transform("fieldBoundaries", lambda b: b.withField("headingLevel", F.coalesce(b["headingLevel"], F.lit(0))))
    return docs.select(
        F.col("id").alias("src_id"), F.col("id").alias("doc_id"), "slug", "title", "excerpt", "href", F.col("type").alias("kind"), "category", "author", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "text", level.alias("boundaries")
    )


def boundary(start: Column, end: Column, field: str, section: Column | str | None, level: int) -> Column:
    """A field boundary as a struct."""
    section = F.lit(section) if not isinstance(section, Column) else section
    return F.struct(F.lit(None).cast("long").alias("docId"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(field).alias("fieldType"), section.cast("string").alias("sectionId"), F.lit(level).alias("headingLevel"))


def document_corpus(documents: DataFrame, chars: bool = False) -> DataFrame:
    """documents(doc_id, text) with the first line as title and the rest as content of section "body".

    Boundaries count bytes, or characters if `chars`.  Rows without text are left out.
    """
    size = F.length if chars else F.octet_length
    title = F.substring_index("text", "\n", 1)
    head, whole = size(title), size("text")
    bounds = F.filter(F.array(boundary(F.lit(0), head, "title", None, 0), boundary(head + 1, whole, "content", "body", 5)), lambda b: b["start"] < b["end"])
    return documents.where("text is not null").select("doc_id", title.alias("title"), "source", "text", bounds.alias("boundaries"))


def conversation_corpus(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as documents whose sections are the turns, in order."""
    turns = conversations.where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    start = lambda i: F.octet_length(F.array_join(F.transform(F.slice("t", F.lit(1), i), lambda x: x["text"]), "\n")) + F.when(i > 0, 1).otherwise(0)
    bounds = F.transform("t", lambda x, i: boundary(start(i), start(i) + F.octet_length(x["text"]), "content", F.concat(F.lit("turn-"), x["turn"].cast("string")), 5))
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), text.alias("text"), bounds.alias("boundaries"))


def part_inputs(part: DataFrame) -> DataFrame:
    """part as inputs of a union index: names are titles, types headings, brands contents."""
    return part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("doc_title"), F.col("p_name").alias("title"), F.col("p_type").alias("heading"), F.col("p_brand").alias("content"))
