"""The index: postings, vocabulary, sections and documents as tables.

Postings are laid out by term, so that Parquet's statistics answer equality and
prefix predicates; the dictionary and skip structures of a hand-made file have
no counterpart here.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import scoring, text
from ..schema import FORMAT_VERSION
from ..session import cut, ship, shuffle_parts, spread
from .match import small

TABLES = ("docs", "boundaries", "postings", "vocab", "sections")


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with column `name`: the row's number, from `start`, in the order of `order`.

    Rows are range-partitioned and numbered within their partition, in the
    exchange that orders them; only the partitions' counts go to the driver.
    """
    # The number that Spark gives a row has its partition above 33 bits and its place in it below.
    sorted_rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33).cast("int")
    counts = {r["_part"]: r["count"] for r in sorted_rows.groupBy(part.alias("_part")).count().collect()}
    rows, at = [], start
    for p in sorted(counts):
        rows.append((p, at))
        at += counts[p]
    starts = df.sparkSession.createDataFrame(rows or [(-1, 0)], "_part int, _start long")
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + place).cast("long")).drop("_part", "_start", "_row")


def postings(docs: DataFrame, stop: frozenset[str] | None = None, boundaries_col: str | None = "boundaries") -> DataFrame:
    """Every token of docs(doc_id, text, boundaries) with its field, match type, stored and library score."""
    ship(docs.sparkSession)
    return with_base_score(_scored(text.tokenize(spread(docs), stop, boundaries_col=boundaries_col)))


def _scored(tokens: DataFrame) -> DataFrame:
    scored = tokens.withColumn("match_type", scoring.match_type(F.col("heading_level")))
    return scored if "score" in tokens.columns else scored.withColumn("score", scoring.stored_score(F.col("field_type"), F.col("offset"), F.col("text_len")))


def segments(docs: DataFrame, stop: frozenset[str] | None = None, boundaries_col: str | None = "boundaries", scorer: Callable[[dict], float] | None = None) -> DataFrame:
    """postings() as save() lays them out: segments of whole documents, each sorted by term, with `first` and without the library score, which follows from the rest.

    `scorer` is a user's function that scores each match instead of the stored score.
    """
    ship(docs.sparkSession)
    info = tuple(c for c in scoring.DOC_COLUMNS if c in docs.columns) if scorer is not None else ()
    return _scored(text.tokenize(spread(docs), stop, boundaries_col=boundaries_col, by_term=True, score=scorer, info=info))


def with_base_score(post: DataFrame) -> DataFrame:
    """`post` with the library score, where it isn't stored."""
    if "base_score" in post.columns:
        return post
    return post.drop("first").withColumn("base_score", scoring.final_score(F.col("field_type"), F.col("offset"), F.col("text_len")))


def posting_order() -> list:
    """Order of a term's postings; ties of the stored score keep the library score's order."""
    return [F.desc("score"), F.asc("doc_id"), F.desc("base_score"), F.asc("offset")]


#: Postings of a term that one task ranks; longer lists are ranked piece by piece.
LIST = 1 << 20


def _range_number(c: Column, bounds: list) -> Column:
    """How many of the sorted `bounds` are below the value, by binary search in nested conditions."""

    def at(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c > F.lit(bounds[mid]), at(mid + 1, high)).otherwise(at(low, mid))

    return at(0, len(bounds))


def posting_places(post: DataFrame) -> DataFrame:
    """`post` with `place`: each posting's rank in its term's list, from 1.

    Every posting is exchanged once, by term.  Lists of over LIST postings are cut
    along the order into pieces, by score and by ranges of documents, which are
    ranked by themselves; the pieces' counts give where each begins.
    """
    spark, total = post.sparkSession, post.count()
    parts = max(shuffle_parts(spark), total // (2 * LIST))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(*posting_order()))
    long_lists = post.groupBy("term").count().where(F.col("count") > LIST).collect()
    if not long_lists:
        return post.repartition(parts, "term").withColumn("place", rank)
    is_long = F.col("term").isin([r["term"] for r in long_lists])
    short = post.where(~is_long).repartition(parts, "term").withColumn("place", rank)
    pieces, rows = 1 + 2 * max(r["count"] for r in long_lists) // LIST, post.where(is_long)
    bounds = []
    if isinstance(post.schema["doc_id"].dataType, NumericType):
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []))
    key = ["term", "score", "_range"]
    rows = rows.withColumn("_range", _range_number(F.col("doc_id"), bounds))
    before = F.sum("count").over(Window.partitionBy("term").orderBy(F.desc("score"), F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    starts = small(cut(rows.groupBy(*key).count().select(*key, F.coalesce(before, F.lit(0)).alias("_start"))))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", F.desc("base_score"), "offset"))
    ranked = rows.repartition(parts, *key).withColumn("_n", inside).join(starts, key)
    return short.unionByName(ranked.withColumn("place", (F.col("_start") + F.col("_n")).cast("int")).drop("_n", "_range", "_start"))


def hot_terms(docs: DataFrame, parts: int, stop: frozenset[str] | None = None, one_in: int = 50) -> list[str]:
    """The terms that fill half a part of `parts` or more, judged by one document in `one_in`: fewer than 2 * `parts`.

    They only steer the layout; a term taken wrongly costs time, not results.
    """
    some = text.tokenize(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0), stop).groupBy("term").agg(F.count("*").alias("n"))
    counted = cut(some)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r["term"] for r in counted.where(F.col("n") * 2 * parts > F.lit(total)).collect()]


def by_term(post: DataFrame, hot: list[str], parts: int) -> DataFrame:
    """`post` in `parts` parts by term, sorted; the postings of the `hot` terms are dealt over all parts by document."""
    spark = post.sparkSession
    if hot:
        names = spark.createDataFrame([(t, True) for t in hot], "term string, _hot boolean")
        post = post.join(F.broadcast(names), "term", "left")
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(16 * parts))).otherwise(F.lit(0))
        return post.withColumn("_salt", salt).repartition(parts, "term", "_salt").drop("_hot", "_salt").sortWithinPartitions("term", *posting_order())
    return post.repartition(parts, "term").sortWithinPartitions("term", *posting_order())


def checksum(df: DataFrame) -> int:
    """A sum of the rows' CRC32s, whatever their order."""
    return df.agg(F.coalesce(F.sum(F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary"))), F.lit(0))).first()[0]


def vocabulary(post: DataFrame) -> DataFrame:
    """(term_idx, term, term_len, doc_freq) of all terms, numbered in byte order.

    Where `post` has the column `first`, a term's documents are the rows that
    have it set: one row for each term and task is exchanged, not one for each
    term and document.
    """
    documents = F.coalesce(F.sum((F.col("first") & F.col("doc_id").isNotNull()).cast("long")), F.lit(0)) if "first" in post.columns else F.countDistinct("doc_id")
    terms = cut(post.groupBy("term").agg(documents.alias("doc_freq")).withColumn("term_len", F.octet_length("term")))
    return dense_index(terms, ["term"], "term_idx").select("term_idx", "term", "term_len", "doc_freq")


def section_table(boundaries: DataFrame) -> DataFrame:
    """(section_idx, section_id): the distinct section ids of all boundaries, from 1; 0 stands for none."""
    ids = boundaries.select("section_id").where("section_id is not null").distinct()
    return dense_index(ids, ["section_id"], "section_idx", 1).select("section_idx", "section_id")


def include(docs: DataFrame, rule: str | dict) -> DataFrame:
    """The documents that an index definition includes: "*" (any string) all; else those equal in every given key of category and type; other keys are ignored."""
    if isinstance(rule, str):
        return docs
    known = {"category": "category", "type": "kind"}
    tests = [F.col(known[k]) == v for k, v in rule.items() if k in known]
    return docs.where(reduce(lambda a, b: a & b, tests)) if tests else docs


def fields(docs: DataFrame, kept: list[str] | None) -> DataFrame:
    """`docs` with the boundaries of the kept field types only; text outside them counts as content."""
    return docs if kept is None else docs.withColumn("boundaries", F.filter("boundaries", lambda b: b["fieldType"].isin(kept)))


def renumber(docs: DataFrame) -> DataFrame:
    """`docs(src_id, ...)` with doc_id 0..n-1 in the order of src_id."""
    return dense_index(docs, ["src_id"], "doc_id")


def select_mode(doc_count: int, text_bytes: int, prefix: bool = True, fuzzy: bool = True) -> str:
    """suffix, inverted or hybrid, by corpus size and the matching that is needed."""
    if doc_count <= 50 and text_bytes <= 100_000:
        return "suffix"
    if prefix or fuzzy:
        return "hybrid" if doc_count >= 500 else "suffix"
    return "inverted" if doc_count >= 500 else "suffix"


@dataclass
class Index:
    """An index's tables; lazily read, so a query touches only those it needs."""

    docs: DataFrame
    boundaries: DataFrame
    postings: DataFrame
    stored_vocab: DataFrame | None
    stored_sections: DataFrame | None
    #: The postings as save() lays them out; without it, save() lays `postings` out by term.
    segments: DataFrame | None = None

    @property
    def sections(self) -> DataFrame:
        """The stored section table, or, for an index that isn't saved, one made on first use."""
        if self.stored_sections is None:
            self.stored_sections = section_table(self.boundaries)
        return self.stored_sections

    @property
    def vocab(self) -> DataFrame:
        """The stored vocabulary, or, for an index that isn't saved, one made on first use."""
        if self.stored_vocab is None:
            self.stored_vocab = vocabulary(self.postings)
        return self.stored_vocab

    @classmethod
    def build(cls, docs: DataFrame, rule: str | dict = "*", kept_fields: list[str] | None = None, stop: frozenset[str] | None = None, scorer=None) -> "Index":
        """Index of docs(doc_id, title, text, boundaries array, ...), filtered by an index definition."""
        chosen = fields(include(docs, rule), kept_fields)
        laid = segments(chosen, stop, scorer=scorer)
        bounds = chosen.select("doc_id", F.explode("boundaries").alias("b")).select("doc_id", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.fieldType").alias("field_type"), F.col("b.sectionId").alias("section_id"), F.col("b.headingLevel").alias("heading_level"))
        meta = chosen.withColumn("text_len", F.octet_length(F.coalesce("text", F.lit("")))).drop("text", "boundaries")
        return cls(meta, bounds, with_base_score(laid), None, None, laid)

    def save(self, path: str, check: bool = False) -> "Index":
        """Writes the tables, their counts and, if `check`, their checksums; returns the index as read back.

        Segments are written as they come, so postings aren't exchanged; pages of
        files sorted by term are skipped by their statistics.
        """
        spark = self.docs.sparkSession
        laid = by_term(self.postings, [], shuffle_parts(spark)) if self.segments is None else self.segments
        laid.write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("docs", "boundaries"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        stored, docs, bounds = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "boundaries"))
        if "first" in stored.columns and not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
            # Documents that share an id may lie in several segments.
            stored = stored.drop("first")
        vocabulary(stored).write.mode("overwrite").parquet(f"{path}/vocab")
        (section_table(bounds) if self.stored_sections is None else self.stored_sections).write.mode("overwrite").parquet(f"{path}/sections")
        tables = {name: with_base_score(t) if name == "postings" else t for name in TABLES for t in [spark.read.parquet(f"{path}/{name}")]}
        counts = {name: t.count() for name, t in tables.items()}
        sums = {name: checksum(t) for name, t in tables.items()} if check else None
        spark.createDataFrame([(FORMAT_VERSION, json.dumps(counts), json.dumps(sums))], "version int, counts string, sums string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        return Index.load(spark, path)

    @staticmethod
    def header(spark: SparkSession, path: str) -> dict:
        """An index's version, counts and checksums (none where it was saved without); a version that isn't known is an error."""
        meta = spark.read.schema("version int, counts string, sums string").json(f"{path}/meta").first()
        if meta is None or meta["version"] != FORMAT_VERSION:
            raise ValueError(f"unknown index format at {path}")
        return {"version": meta["version"], "counts": json.loads(meta["counts"]), "sums": json.loads(meta["sums"] or "null") or {}}

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = False) -> "Index":
        """Reads an index; a version that isn't known, or, if `check`, counts, checksums or contents that aren't right are errors."""
        loader = IncrementalLoader(spark, path)
        for name in TABLES:
            loader.load(name, check)
        index = loader.finalize()
        if check:
            from .validate import index_violations

            wrong = index_violations(index).limit(5).collect()
            if wrong:
                raise ValueError(f"the index at {path} isn't valid: {[tuple(r) for r in wrong]}")
        return index

    def inspect(self) -> DataFrame:
        """(name, rows, columns) of each table."""
        spark = self.docs.sparkSession
        return spark.createDataFrame([(n, getattr(self, n).count(), len(getattr(self, n).columns)) for n in TABLES], "name string, rows long, columns int")

    def term_postings(self, term: str) -> DataFrame:
        """A term's postings, best first; the predicate reaches the scan."""
        return self.postings.where(F.col("term") == term).orderBy(*posting_order())

    def totals(self) -> DataFrame:
        """(docs, terms, text_bytes) of the corpus."""
        docs = self.docs.select(F.lit(1).alias("docs"), F.lit(0).alias("terms"), F.col("text_len").alias("text_bytes"))
        terms = self.vocab.select(F.lit(0).alias("docs"), F.lit(1).alias("terms"), F.lit(0).cast("long").alias("text_bytes"))
        return docs.unionByName(terms).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms", "text_bytes")])


class IncrementalLoader:
    """Reads an index table by table, in any order; a search that needs few tables can begin before all are there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        self.spark, self.path = spark, path
        self.header = Index.header(spark, path)
        self.tables: dict[str, DataFrame] = {}

    def load(self, name: str, check: bool = False) -> DataFrame:
        """Reads a table; if `check`, a count or checksum that differs from the header's is an error."""
        if name not in TABLES:
            raise ValueError(f"an index has the tables {TABLES}")
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if name == "postings":
            df = with_base_score(df)
        if check:
            if df.count() != self.header["counts"][name]:
                raise ValueError(f"table {name} at {self.path} doesn't have {self.header['counts'][name]} rows")
            if name in self.header["sums"] and checksum(df) != self.header["sums"][name]:
                raise ValueError(f"table {name} at {self.path} doesn't have its checksum")
        self.tables[name] = df
        return df

    @property
    def pending(self) -> tuple[str, ...]:
        return tuple(n for n in TABLES if n not in self.tables)

    def pending_count(self) -> int:
        return len(self.pending)

    def is_complete(self) -> bool:
        return not self.pending

    def finalize(self) -> Index:
        """The index; tables that weren't loaded are an error."""
        if self.pending:
            raise ValueError(f"not loaded yet: {', '.join(self.pending)}")
        return Index(*[self.tables[n] for n in TABLES])


def build_indexes(docs: DataFrame, definitions: dict[str, dict], path: str, **how) -> dict[str, Index]:
    """One saved index for each definition {name: {"include": ..., "fields": ...}}, each from the same documents."""
    return {name: Index.build(docs, d.get("include", "*"), d.get("fields"), **how).save(f"{path}/{name}") for name, d in definitions.items()}
