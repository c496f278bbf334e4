"""Matching of query terms with vocabulary terms.

A stated set of query terms is met with every vocabulary term in one pass over
the vocabulary: the terms are a literal array, from which each row keeps those
that match.  There is no nested-loop join, and one term is a plain filter whose
predicate reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

MODES = ("exact", "prefix", "substring", "fuzzy", "library_fuzzy")
#: Query terms a pass over the vocabulary; more go in blocks.
BLOCK = 256
#: Rows of a broadcast side at most; larger ones are joined by exchanges.
BROADCAST_KEYS = 200_000

QueryTerm = tuple[int, int, str]


def library_distance(query: str) -> int:
    """Edit distance that the library search allows: 1 up to 5 bytes, else 2."""
    return 2 if len(query.encode()) > 5 else 1


def _test(term: Column, mode: str, most: int):
    def one(q: Column) -> Column:
        if mode == "exact":
            return term == q["qt"]
        if mode == "prefix":
            return term.startswith(q["qt"])
        if mode == "substring":
            return term.contains(q["qt"])
        return (F.abs(F.length(term) - F.length(q["qt"])) <= most) & F.levenshtein(term, q["qt"], most).between(0, q["k"])

    return one


def match_terms(vocab: DataFrame, queries: list[QueryTerm], mode: str, keep: bool = False) -> DataFrame:
    """(query_id, term_pos, qt, term, distance) of the terms of `vocab(term)` that match each query term; with `keep`, and its other columns.

    fuzzy allows a distance of 2, library_fuzzy of 1 or 2 by the query's length;
    both include distance 0.  Empty query terms match nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    queries = [q for q in queries if q[2]]
    columns = vocab.columns if keep else ["term"]
    if not queries:
        return vocab.select(F.lit(0).alias("query_id"), F.lit(0).alias("term_pos"), F.lit("").alias("qt"), *columns, F.lit(0).alias("distance")).where("false")
    parts = []
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        most = max(library_distance(q) for _, _, q in block) if mode == "library_fuzzy" else 2
        source = vocab.select(*columns)
        if mode in ("exact", "prefix"):
            tests = [F.col("term") == q if mode == "exact" else F.col("term").startswith(q) for q in sorted({q for _, _, q in block})]
            source = source.where(reduce(lambda a, b: a | b, tests)) if mode == "prefix" else source.where(F.col("term").isin(sorted({q for _, _, q in block})))
        literal = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(p).alias("term_pos"), F.lit(q).alias("qt"), F.lit(library_distance(q) if mode == "library_fuzzy" else 2).alias("k")) for i, p, q in block])
        found = source.withColumn("_q", F.explode(F.filter(literal, _test(F.col("term"), mode, most))))
        distance = F.levenshtein("term", F.col("_q.qt"), 2) if "fuzzy" in mode else F.lit(0)
        parts.append(found.select("_q.query_id", "_q.term_pos", "_q.qt", *columns, distance.alias("distance")))
    return reduce(DataFrame.unionByName, parts)


def delete_neighbourhood(term: Column, most: int = 2) -> Column:
    """The term and all it becomes by deleting up to `most` characters, distinct."""

    def shorter(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))

    out = level = F.array(term)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def small(rows: DataFrame) -> DataFrame:
    """`rows`, which are computed already, marked for a broadcast if there are up to BROADCAST_KEYS, else for exchanges."""
    return F.broadcast(rows) if rows.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else rows.hint("merge")


def _segment(size: Column, k: Column, most: int) -> tuple[Column, Column]:
    """Start and length of the segment number `k` of a string of `size` characters cut into `most` + 1; the last ones are the longer ones."""
    parts = most + 1
    least, more = F.floor(size / parts).cast("int"), (size % parts).cast("int")
    before = F.greatest(k - (parts - more), F.lit(0))
    return k * least + before, least + F.when(k >= parts - more, 1).otherwise(0)


def fuzzy_join(vocab: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """(qt, term, distance) for query terms held in a table, queries(qt), of any number.

    A term is cut into `most` + 1 segments, so within that distance one of them
    stands unchanged in the query, at most `most` places away.  Each term has as
    many keys as segments, each query those of all lengths and places that can
    match; an equi-join on them finds the candidates, which are verified.  Keys
    of up to BROADCAST_KEYS are broadcast, so the vocabulary isn't shuffled.
    """
    places = F.sequence(F.lit(0), F.lit(most))
    number, at, size = F.col("_number"), F.col("_at"), F.col("_size")
    first, many = _segment(size, number, most)
    left = vocab.select("term", F.length("term").alias("_size"), F.explode(places).alias("_number")).select("term", "_size", "_number", F.substr("term", first + 1, many).alias("_key"))
    ways = F.sequence(F.lit(-most), F.lit(most))
    sizes = queries.select("qt").where("qt is not null").distinct().select("qt", F.explode(ways).alias("_d")).select("qt", (F.length("qt") + F.col("_d")).alias("_size")).where("_size >= 0")
    spots = sizes.select("*", F.explode(places).alias("_number")).select("*", F.explode(ways).alias("_d")).withColumns({"_at": first + F.col("_d"), "_many": many})
    inside = spots.where((at >= 0) & (at + F.col("_many") <= F.length("qt")))
    right = cut(inside.select("qt", "_size", "_number", F.substr("qt", at + 1, F.col("_many")).alias("_key")).distinct())
    right = small(right)
    pairs = left.join(right, ["_size", "_number", "_key"]).select("qt", "term").withColumn("distance", F.levenshtein("term", "qt", most))
    return pairs.where("distance >= 0").distinct()
