"""Validation: invariants as queries that return violations (rule, key and detail), none if all holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .index import Index

SECTION_ID = "^[A-Za-z0-9_-]+$"


def asof(rows: DataFrame, starts: DataFrame, key: str, at: str, start: str, place: Column | None = None) -> DataFrame:
    """`rows` with the last `start` of their key that is at or before `at`, by one window over both tables; null if there is none.

    `place` says where a start is, if it isn't the start itself; of starts at one place the greatest counts.
    """
    both = rows.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn(start, F.lit(None).cast(starts.schema[start].dataType))
    marks = starts.select(key, (F.col(start) if place is None else place).alias("_at"), F.lit(0).alias("_kind"), F.col(start))
    every = both.unionByName(marks, allowMissingColumns=True)
    last = F.last(start, ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_kind", start).rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn(start, last).where("_kind = 1").drop("_at", "_kind")


def section_at(offsets: DataFrame, sections: DataFrame) -> DataFrame:
    """offsets(doc_id, offset) with the section_id that holds them: the last that starts at or before, if it reaches so far.

    The section goes along in the window, so offsets are exchanged once.
    """
    marks = sections.select("doc_id", F.struct(F.col("start").cast("long").alias("start"), "end", "section_id").alias("_section"))
    found = asof(offsets, marks, "doc_id", "offset", "_section", F.col("_section.start"))
    return found.withColumn("section_id", F.when(F.col("offset") < F.col("_section.end"), F.col("_section.section_id"))).drop("_section")


def sections(bounds: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(rule, doc_id, at) for bounds(doc_id, start, end, section_id): malformed, bad_id, overlap, gap and, given lengths(doc_id, text_len), short."""
    way = Window.partitionBy("doc_id").orderBy("start", "end")
    seen = bounds.withColumn("_last", F.lag("end").over(way))
    rules = {
        "malformed": F.col("start") >= F.col("end"),
        "bad_id": F.col("section_id").isNotNull() & ~F.col("section_id").rlike(SECTION_ID),
        "overlap": F.col("_last") > F.col("start"),
        "gap": F.coalesce("_last", F.lit(0)) < F.col("start"),
    }
    found = seen.select("doc_id", F.col("start").alias("at"), F.explode(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])).alias("rule")).where("rule is not null").select("rule", "doc_id", "at")
    if lengths is not None:
        last = bounds.groupBy("doc_id").agg(F.max("end").alias("end"))
        short = lengths.join(last, "doc_id").where("end < text_len").select(F.lit("short").alias("rule"), "doc_id", F.col("end").alias("at"))
        found = found.unionByName(short)
    return found


def index_violations(index: Index) -> DataFrame:
    """(rule, key) for an index: every posting within its text and of a known document and term, counts that agree, no empty table."""
    post, vocab, docs = index.postings, index.vocab, index.docs
    key = F.concat_ws(":", "term", F.col("doc_id").cast("string"), F.col("offset").cast("string")).alias("key")
    tests = {
        "offset_out_of_text": (F.col("offset") < 0) | (F.col("offset") + F.octet_length("term") > F.col("text_len") + 8),
        "empty_term": F.col("term") == "",
        "field_unknown": ~F.col("field_type").isin("title", "heading", "content"),
        "match_type_differs": F.col("match_type") != scoring.match_type(F.col("heading_level")),
        "score_not_positive": (F.col("score") <= 0) | (F.col("base_score") <= 0),
    }
    parts = [post.select(F.explode(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("rule"), key).where("rule is not null")]
    parts.append(post.join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("document_unknown").alias("rule"), key))
    freq = post.groupBy("term").agg(F.countDistinct("doc_id").alias("_df"))
    parts.append(freq.join(vocab, "term", "full").where("_df is null or doc_freq is null or _df <> doc_freq").select(F.lit("doc_freq_differs").alias("rule"), F.col("term").alias("key")))
    parts.append(vocab.groupBy("term").count().where("count > 1").select(F.lit("term_repeats").alias("rule"), F.col("term").alias("key")))
    ahead = vocab.select((F.col("term_idx") - 1).alias("term_idx"), F.col("term").alias("_next"))
    parts.append(vocab.join(ahead, "term_idx").where("term >= _next").select(F.lit("vocabulary_unsorted").alias("rule"), F.col("term").alias("key")))
    for name, table in (("documents_empty", docs), ("vocabulary_empty", vocab)):
        parts.append(table.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("rule"), F.lit("").alias("key")))
    return reduce(DataFrame.unionByName, parts)


RULES = ("offset_out_of_text", "empty_term", "field_unknown", "match_type_differs", "score_not_positive", "document_unknown", "doc_freq_differs", "term_repeats", "vocabulary_unsorted", "documents_empty", "vocabulary_empty")


def report(index: Index) -> DataFrame:
    """(rule, violations) of every rule of an index, 0 where it holds."""
    rules = index.docs.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    found = index_violations(index).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("violations"))


def suffix_violations(array: DataFrame, docs: DataFrame) -> DataFrame:
    """(rule, doc_id, offset) for a suffix array: order, completeness, offsets and common prefixes."""
    way = Window.partitionBy(F.left("suffix", F.lit(3))).orderBy("place")
    seen = array.withColumn("_last", F.lag("suffix").over(way))
    unsorted = seen.where("_last > suffix").select(F.lit("unsorted").alias("rule"), "doc_id", "offset")
    lcp = seen.where(F.col("_last").isNotNull() & ((F.left("suffix", F.col("lcp")) != F.left("_last", F.col("lcp"))) | ((F.length("suffix") > F.col("lcp")) & (F.length("_last") > F.col("lcp")) & (F.left("suffix", F.col("lcp") + 1) == F.left("_last", F.col("lcp") + 1))))).select(F.lit("lcp_wrong").alias("rule"), "doc_id", "offset")
    sized = array.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs.select("doc_id", F.length("text").alias("len")), "doc_id", "full")
    missing = sized.where("coalesce(n, 0) <> coalesce(len, 0)").select(F.lit("incomplete").alias("rule"), "doc_id", F.coalesce(F.col("n").cast("int"), F.lit(0)).alias("offset"))
    bad = array.join(docs.select("doc_id", F.length("text").alias("len")), "doc_id", "left").where("len is null or offset < 0 or offset >= len").select(F.lit("entry_invalid").alias("rule"), "doc_id", "offset")
    return reduce(DataFrame.unionByName, [unsorted, lcp, missing, bad])


def hierarchy_violations(post: DataFrame) -> DataFrame:
    """Scores of a lower field type that reach those of a higher one."""
    s = post.groupBy("field_type").agg(F.min("base_score").alias("low"), F.max("base_score").alias("high"))
    rank = F.when(F.col("field_type") == "title", 2).when(F.col("field_type") == "heading", 1).otherwise(0)
    a, b = s.withColumn("r", rank), s.select(F.col("field_type").alias("other"), F.col("high").alias("other_high"), F.col("low").alias("other_low")).withColumn("o", F.when(F.col("other") == "title", 2).when(F.col("other") == "heading", 1).otherwise(0))
    return a.join(b, F.col("r") > F.col("o")).where("low <= other_high").select(F.lit("field_hierarchy").alias("rule"), "field_type", "other")


def intersect(post: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) of the documents that have every term."""
    wanted = sorted(set(terms))
    return post.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")
