"""Suffix arrays: every suffix in order, with the longest common prefix of neighbours.

Suffixes are ordered within buckets of their first characters; a bucket's
offset comes from the counts of the buckets before it.  So no task orders more
than one bucket, and `width` can be raised for larger texts.  That writes every
suffix out, which suits names and terms.  suffix_order is for texts of any
length: it sorts by a bounded key and doubles the compared length until no two
different suffixes tie, so a suffix is never more than its place and a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_prefix_length
from ..session import cut
from .index import dense_index


def _ordered(rows: DataFrame, ties: list[str], width: int) -> DataFrame:
    """rows(suffix, ...) with place (from 0) and lcp (with the suffix before; 0 for the first)."""
    rows = rows.withColumn("_bucket", F.left("suffix", F.lit(width)))
    way = Window.partitionBy("_bucket").orderBy("suffix", *ties)
    inside = rows.withColumn("_n", F.row_number().over(way)).withColumn("_before", F.lag("suffix").over(way))
    # One row a bucket, so this window holds bucket names only.
    sizes = rows.groupBy("_bucket").count()
    along = Window.orderBy("_bucket")
    starts = sizes.select("_bucket", F.coalesce(F.sum("count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.lag("_bucket").over(along).alias("_last"))
    lcp = F.when(F.col("_before").isNotNull(), common_prefix_length(F.col("suffix"), F.col("_before"))).when(F.col("_last").isNotNull(), common_prefix_length(F.col("_bucket"), F.col("_last"))).otherwise(F.lit(0))
    return inside.join(starts, "_bucket").withColumn("place", (F.col("_start") + F.col("_n") - 1).cast("long")).withColumn("lcp", lcp.cast("int")).drop("_bucket", "_n", "_before", "_start", "_last")


def suffix_array(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, offset, suffix, place, lcp) of every character suffix of docs(doc_id, text)."""
    offsets = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("offset"))
    return _ordered(offsets.select("doc_id", "offset", suffix_at(F.col("text"), F.col("offset")).alias("suffix")), ["doc_id", "offset"], width)


def suffix_order(docs: DataFrame, width: int = 16, most_rounds: int = 40) -> DataFrame:
    """(doc_id, offset, place) of every character suffix of docs(doc_id, text), equal suffixes by doc_id and offset.

    Ranks by the first `width` characters are refined by prefix doubling: a
    suffix's rank by 2h characters follows from its own by h and that of the
    suffix h further on.  Only suffixes that still tie with a different one take
    part in a round; rows are ordered by ranges and groups only counted, so a
    text that repeats itself fills no task.
    """
    offsets = docs.where(F.length("text") > 0).select("doc_id", "text", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("offset"))
    keyed = offsets.select("doc_id", "offset", (F.col("size") - F.col("offset")).alias("left"), F.substr("text", F.col("offset") + 1, F.lit(width)).alias("_key"))
    placed = cut(dense_index(keyed, ["_key", "doc_id", "offset"], "_n"))
    rank = placed.groupBy("_key").agg(F.min("_n").alias("rank"), F.count("*").alias("many"))
    ranks = cut(placed.join(rank, "_key").select("doc_id", "offset", "left", "rank", "many"))
    h = width
    for _ in range(most_rounds):
        # Suffixes shorter than h are compared to their end: those that tie are equal.
        tied = cut(ranks.where((F.col("many") > 1) & (F.col("left") >= h)))
        if tied.isEmpty():
            break
        ahead = ranks.select("doc_id", (F.col("offset") - h).alias("offset"), F.col("rank").alias("second"))
        keys = tied.join(ahead, ["doc_id", "offset"], "left").select("doc_id", "offset", "left", "rank", F.coalesce("second", F.lit(-1)).alias("second"))
        placed = cut(dense_index(keys, ["rank", "second", "doc_id", "offset"], "_n"))
        first = placed.groupBy("rank").agg(F.min("_n").alias("_first"))
        group = placed.groupBy("rank", "second").agg(F.min("_n").alias("_start"), F.count("*").alias("many")).join(first, "rank")
        new = placed.join(group, ["rank", "second"]).select("doc_id", "offset", "left", (F.col("rank") + F.col("_start") - F.col("_first")).alias("rank"), "many")
        settled = ranks.where(~((F.col("many") > 1) & (F.col("left") >= h)))
        ranks = cut(settled.unionByName(new))
        h *= 2
    else:
        raise RuntimeError(f"suffixes still tie after {most_rounds} rounds")
    return dense_index(ranks.select("doc_id", "offset", "rank"), ["rank", "doc_id", "offset"], "place").select("doc_id", "offset", "place")


def vocabulary_suffix_array(vocab: DataFrame, width: int = 3) -> DataFrame:
    """(term, offset, suffix, place, lcp) of every suffix of vocab(term)."""
    offsets = vocab.where(F.length("term") > 0).select("term", F.explode(F.sequence(F.lit(0), F.length("term") - 1)).alias("offset"))
    return _ordered(offsets.withColumn("suffix", suffix_at(F.col("term"), F.col("offset"))), ["term", "offset"], width)


def suffix_at(text: Column, offset: Column) -> Column:
    """The text from a character offset on."""
    return F.substr(text, offset + 1)


def search(array: DataFrame, prefix: str) -> DataFrame:
    """The suffixes that begin with `prefix`, a range of places; the predicate is a prefix test that a sorted table can skip by."""
    return array.where(F.col("suffix").startswith(prefix))
