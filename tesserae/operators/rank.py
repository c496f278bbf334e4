"""Ranking: accumulation over terms and sections, folds, merging and final orders.

Everything is grouped by query, so one plan ranks any number of queries.
"""

from __future__ import annotations

import statistics
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CUT_RESULTS, MOST_RESULTS
from .index import dense_index


def result_order() -> list[Column]:
    """Final order: match type, score descending, title, document; the tier plays no part."""
    return [F.asc("match_type"), F.desc("score"), F.asc("title"), F.asc("doc_id")]


def top(rows: DataFrame, order: list[Column], limit: int, by: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """The first `limit` rows of each group in an order, with their number from 1 as `rank`."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def exact_sum(c: str) -> Column:
    """The sum of a column of floats as a decimal number, whatever the rows' order: equal addends give equal sums, so ties stay ties."""
    return F.sum(F.col(c).cast("decimal(28,18)")).cast("double")


def every(rows: DataFrame) -> DataFrame:
    """All of rows(query_id, doc_id, score, ...) with their rank by score and document; the order is made by ranges, so no task holds a query's rows."""
    placed = dense_index(rows.withColumn("_down", -F.col("score")), ["query_id", "_down", "doc_id"], "_place")
    first = placed.groupBy("query_id").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "query_id").withColumn("rank", (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first", "_down")


def accumulate(hits: DataFrame, n_terms: DataFrame, titles: DataFrame, limit: int, dedup_sections: bool = True) -> DataFrame:
    """Multi-term results from hits(query_id, term_pos, doc_id, section_id, match_type, score, term, seq).

    Scores of all postings of a document's section are added up; its match type
    is the best, its term that of the first hit (by seq) of that type.
    Documents must have a hit of every term (n_terms: query_id, n).  With
    `dedup_sections` a document's sections are added up into one result in its
    best section (match type, score, then lowest id, none first).
    """
    first = F.struct("match_type", "seq")
    sections = hits.groupBy("query_id", "doc_id", "section_id").agg(exact_sum("score").alias("score"), F.min("match_type").alias("match_type"), F.min_by("term", first).alias("matched_term"), F.collect_set("term_pos").alias("_pos"))
    per_doc = hits.groupBy("query_id", "doc_id").agg(F.countDistinct("term_pos").alias("_hit")).join(n_terms, "query_id").where("_hit = n").select("query_id", "doc_id")
    sections = sections.drop("_pos").join(per_doc, ["query_id", "doc_id"])
    if dedup_sections:
        best = F.struct("match_type", -F.col("score"), "section_id")
        sections = sections.groupBy("query_id", "doc_id").agg(F.min_by("section_id", best).alias("section_id"), F.min_by("matched_term", best).alias("matched_term"), F.min("match_type").alias("match_type"), exact_sum("score").alias("score"))
    return top(sections.join(titles, "doc_id"), [*result_order(), F.asc("section_id")], limit)


def first_posting(hits: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """Exact single-term results: each document's best posting, in posting order."""
    one = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.desc("base_score"), F.asc("offset"))
    return top(hits.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").join(titles, "doc_id"), [F.desc("score"), F.asc("doc_id")], limit)


def prefix_fold(hits: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """Prefix single-term results.

    In the order of terms and postings, the first hit of the best match type
    gives section and term; the score is the greatest from that hit on.
    """
    order = [F.asc("term"), F.desc("raw_score"), F.desc("base_score"), F.asc("offset")]
    doc = Window.partitionBy("query_id", "doc_id")
    placed = hits.withColumn("_pos", F.row_number().over(doc.orderBy(*order))).withColumn("_best", F.min("match_type").over(doc))
    first = placed.withColumn("_p", F.min(F.when(F.col("match_type") == F.col("_best"), F.col("_pos"))).over(doc))
    folded = first.where(F.col("_pos") >= F.col("_p")).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("section_id", "_pos").alias("section_id"), F.min_by("term", "_pos").alias("matched_term"), F.first("_best").alias("match_type"))
    return top(folded.join(titles, "doc_id"), result_order(), limit)


def fuzzy_fold(hits: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """Fuzzy single-term results: each document's best hit by match type and score, the first seen of equals."""
    seen = [F.asc("match_type"), F.desc("score"), F.asc("distance"), F.asc("term"), F.desc("raw_score"), F.desc("base_score"), F.asc("offset")]
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*seen))).where("_n = 1")
    folded = one.select("query_id", "doc_id", "score", "section_id", F.col("term").alias("matched_term"), "match_type")
    return top(folded.join(titles, "doc_id"), result_order(), limit)


def merge_best(results: DataFrame, limit: int) -> DataFrame:
    """One row a document, the best by the final order, then that order and `limit`: several tiers' or sources' results in one."""
    order = [*result_order(), F.asc("tier"), F.asc("section_idx")]
    one = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).where("_n = 1").drop("_n", "rank")
    return top(one, result_order(), limit)


def stream_best(results: DataFrame) -> DataFrame:
    """One row a document, the best by score, then tier."""
    order = [F.desc("score"), F.asc("tier"), F.asc("match_type"), F.asc("section_idx")]
    return results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).where("_n = 1").drop("_n")


def merge_score_sets(scores: DataFrame) -> DataFrame:
    """Documents that all non-empty terms have: scores(query_id, term_pos, doc_id, score) to the sum over terms of the greatest score."""
    best = scores.groupBy("query_id", "term_pos", "doc_id").agg(F.max("score").alias("score"))
    live = best.groupBy("query_id").agg(F.countDistinct("term_pos").alias("_n"))
    total = best.groupBy("query_id", "doc_id").agg(exact_sum("score").alias("score"), F.count("*").alias("_hit"))
    return total.join(live, "query_id").where("_hit = _n").select("query_id", "doc_id", "score")


def library_top(scores: DataFrame, titles: DataFrame) -> DataFrame:
    """Library results: by score, title and document; of more than 200 hits the first 100."""
    rows = top(scores.join(titles, "doc_id"), [F.desc("score"), F.asc("title"), F.asc("doc_id")], MOST_RESULTS + 1)
    many = F.max("rank").over(Window.partitionBy("query_id"))
    return rows.withColumn("_many", many).where((F.col("_many") <= MOST_RESULTS) | (F.col("rank") <= CUT_RESULTS)).drop("_many")


def tier_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "tier").agg(F.count("*").alias("hits"))


#: Half widths of normal confidence intervals, in standard errors.
CONFIDENCE = {90: 1.645, 95: 1.96, 99: 2.576}


def benchmark_statistics(samples: DataFrame, by: list[str], value: str, confidence: int = 95) -> DataFrame:
    """Mean, sample deviation and confidence interval (90, 95 or 99 %) of timings; stable if the interval is under a tenth of the mean."""
    s = samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = CONFIDENCE[confidence] * F.col("sd") / F.sqrt("n")
    return s.select(*by, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), (2 * half < 0.1 * F.col("mean")).alias("stable"))


def sample_until_stable(run, confidence: int = 95, least: int = 30, most: int = 1000) -> dict[str, float]:
    """Times `run` from `least` to `most` times, until the interval is under a tenth of the mean; figures in milliseconds."""
    times: list[float] = []
    while True:
        began = time.perf_counter()
        run()
        times.append(1000 * (time.perf_counter() - began))
        if len(times) >= max(2, least):
            mean, sd = statistics.fmean(times), statistics.stdev(times)
            half = CONFIDENCE[confidence] * sd / len(times) ** 0.5
            if 2 * half < 0.1 * mean or len(times) >= most:
                return {"n": len(times), "mean": mean, "sd": sd, "low": mean - half, "high": mean + half, "stable": 2 * half < 0.1 * mean}
