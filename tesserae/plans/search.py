"""Search plans: tiered, library, suffix, unified and union search.

Each entry point takes one query or a list of them; a list is answered by one
plan, its rows told apart by query_id, the query's place in the list.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import rank
from ..operators.index import Index, select_mode
from ..operators.match import QueryTerm, match_terms, small
from ..session import cut

RESULT = ["query_id", "rank", "doc_id", "score", "section_idx", "tier", "match_type", "matched_term"]
MOST_LIMIT = 10_000


def _list(queries: str | list[str]) -> list[str]:
    return [queries] if isinstance(queries, str) else list(queries)


class Engine:
    """Searches an index."""

    def __init__(self, index: Index, normalize_query: bool = False) -> None:
        self.index = index
        self.normalize_query = normalize_query
        self.titles = index.docs.select("doc_id", "title")

    @classmethod
    def load(cls, spark, path: str, **how) -> "Engine":
        return cls(Index.load(spark, path), **how)

    def doc_count(self) -> int:
        return self.index.docs.count()

    def vocab_size(self) -> int:
        return self.index.vocab.count()

    # Tiered search

    def _terms(self, queries: list[str]) -> tuple[list[QueryTerm], list[QueryTerm]]:
        """Query terms of the single-term and of the multi-term queries."""
        single, multi = [], []
        for i, q in enumerate(queries):
            parts = text.parse_tiered(q, self.normalize_query)
            (single if len(parts) == 1 else multi).extend((i, p, t) for p, t in enumerate(parts))
        return single, multi

    def _hits(self, terms: list[QueryTerm], tier: int, exclude: DataFrame | None) -> DataFrame:
        """Postings of the terms that match, with the tier's score and the order in which a sequential search sees them."""
        post = self.index.postings
        if tier == 1:
            # The postings' own terms answer it; the predicate reaches their scan.
            hits = match_terms(post, terms, "exact", keep=True)
        else:
            found = match_terms(self.index.vocab, terms, "prefix" if tier == 2 else "fuzzy")
            hits = post.join(small(cut(found.where("distance > 0") if tier == 3 else found)), "term")
        if exclude is not None:
            hits = hits.join(exclude.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
        raw = F.col("score").cast("double")
        score: Column = raw if tier == 1 else scoring.prefix_penalty(raw, F.col("qt"), F.col("term")) if tier == 2 else scoring.fuzzy_penalty(raw, F.col("distance"))
        seq = F.struct("term_pos", "distance", "term", -F.col("score"), "doc_id", -F.col("base_score"), "offset")
        return hits.withColumn("raw_score", F.col("score")).withColumn("seq", seq).withColumn("score", score)

    def _counts(self, multi: list[QueryTerm]) -> DataFrame:
        n: dict[int, int] = {}
        for i, _, _ in multi:
            n[i] = n.get(i, 0) + 1
        return self.index.docs.sparkSession.createDataFrame(sorted(n.items()) or [(-1, 0)], "query_id int, n long")

    def tier(self, queries: str | list[str], tier: int, limit: int = 10, exclude: DataFrame | None = None, dedup_sections: bool = True) -> DataFrame:
        """Results of one tier: 1 exact, 2 prefix, 3 fuzzy; `exclude(query_id, doc_id)` names documents to leave out.

        An empty query, or a limit of 0, has no results.
        """
        single, multi = self._terms(_list(queries))
        parts = []
        if single or not multi:
            hits = self._hits(single, tier, exclude)
            if tier == 1:
                parts.append(rank.first_posting(hits, self.titles, limit).withColumn("matched_term", F.col("term")))
            else:
                parts.append((rank.prefix_fold if tier == 2 else rank.fuzzy_fold)(hits, self.titles, limit))
        if multi:
            parts.append(rank.accumulate(self._hits(multi, tier, exclude), F.broadcast(self._counts(multi)), self.titles, limit, dedup_sections))
        columns = ["query_id", "rank", "doc_id", "score", "section_id", "match_type", "matched_term", "title"]
        out = parts[0].select(*columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(*columns))
        # Section numbers are joined to the results only.
        numbered = out.join(self.index.sections, "section_id", "left").withColumn("section_idx", F.coalesce("section_idx", F.lit(0)).cast("int"))
        return numbered.withColumn("tier", F.lit(tier)).select(*RESULT, "title")

    def tiers(self, queries: str | list[str], limit: int = 10, dedup_sections: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The three tiers, each without the results of those before; only a tier's limited results exclude."""
        one = cut(self.tier(queries, 1, limit, None, dedup_sections))
        two = cut(self.tier(queries, 2, limit, one, dedup_sections))
        return one, two, self.tier(queries, 3, limit, one.unionByName(two), dedup_sections)

    def search(self, queries: str | list[str], limit: int = 10, dedup_sections: bool = True) -> DataFrame:
        """Tiered search: the tiers' results in the final order, `limit` for each query."""
        one, two, three = self.tiers(queries, min(limit, MOST_LIMIT), dedup_sections)
        every = one.unionByName(two).unionByName(three).drop("rank")
        return rank.top(every, [*rank.result_order(), F.asc("section_idx"), F.asc("tier")], limit).select(*RESULT, "title")

    def search_timed(self, query: str, limit: int = 10) -> tuple[DataFrame, dict[str, float]]:
        """search() with the count and milliseconds of each tier."""
        stats: dict[str, float] = {}
        done: DataFrame | None = None
        for tier in (1, 2, 3):
            began = time.perf_counter()
            got = cut(self.tier(query, tier, limit, done))
            stats[f"t{tier}_count"] = got.count()
            stats[f"t{tier}_ms"] = 1000 * (time.perf_counter() - began)
            done = got if done is None else done.unionByName(got)
        return rank.top(done.drop("rank"), rank.result_order(), limit).select(*RESULT, "title"), stats

    def resolve(self, results: DataFrame) -> DataFrame:
        """Results with link, title, excerpt and section id, joined after the limit."""
        info = self.index.docs.select("doc_id", *[c for c in ("href", "excerpt") if c in self.index.docs.columns])
        return results.join(info, "doc_id", "left").join(self.index.sections, "section_idx", "left")

    # Library search

    def library(self, queries: str | list[str], mode: str, exclude: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score, title) by library scores; mode is exact, substring (expanded), fuzzy or hybrid.

        Terms without hits are left out of the conjunction.  hybrid takes, for
        each term, the first of exact, substring and fuzzy that has hits.
        """
        terms = [(i, p, t) for i, q in enumerate(_list(queries)) for p, t in enumerate(text.parse_library(q))]
        kinds = {"exact": ["exact"], "substring": ["substring"], "fuzzy": ["library_fuzzy"], "hybrid": ["exact", "substring", "library_fuzzy"]}[mode]
        found = None
        for tier, kind in enumerate(kinds, 1):
            part = match_terms(self.index.vocab, terms, kind).withColumn("tier", F.lit(tier))
            found = part if found is None else found.unionByName(part)
        found = cut(found)
        if mode == "hybrid":
            first = found.groupBy("query_id", "term_pos").agg(F.min("tier").alias("tier"))
            found = found.join(first, ["query_id", "term_pos", "tier"])
        hits = self.index.postings.join(small(cut(found)), "term").select("query_id", "term_pos", "doc_id", F.col("base_score").alias("score"))
        if exclude is not None:
            hits = hits.join(exclude.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
        return rank.library_top(rank.merge_score_sets(hits), self.titles).select("query_id", "rank", "doc_id", "score", "title")

    def search_exact(self, queries: str | list[str]) -> DataFrame:
        return self.library(queries, "exact")

    def search_expanded(self, queries: str | list[str], exclude: DataFrame | None = None) -> DataFrame:
        return self.library(queries, "substring", exclude)

    def search_fuzzy(self, queries: str | list[str], exclude: DataFrame | None = None) -> DataFrame:
        return self.library(queries, "fuzzy", exclude)

    def search_hybrid(self, queries: str | list[str]) -> DataFrame:
        return self.library(queries, "hybrid")


def _occurrence(term: str):
    """A function of a boundary (None: the whole text as content) that scores the first place of `term` in it, null if there is none."""

    def score(b: Column | None) -> Column:
        start = F.lit(0).cast("long") if b is None else b["start"]
        at = F.call_function("locate", F.lit(term), F.col("text"), (start + 1).cast("int")) - 1
        inside = at >= 0 if b is None else (at >= 0) & (at < b["end"])
        return F.when(inside, scoring.final_score(F.lit("content") if b is None else b["fieldType"], at, F.length("text")))

    return lambda b: score(b)


def search_text(docs: DataFrame, queries: str | list[str]) -> DataFrame:
    """Full-text substring search over docs(doc_id, title, text, boundaries): (query_id, rank, doc_id, score).

    Each boundary's first occurrence of a term is its best one, so only that is
    looked for.  Boundaries count characters here; the text is taken as it is (the
    caller normalizes).  Text outside all boundaries counts
    as content.
    """
    parts = []
    for i, q in enumerate(_list(queries)):
        for p, t in enumerate(text.parse_library(q)):
            best = F.greatest(F.array_max(F.transform("boundaries", _occurrence(t))), _occurrence(t)(None))
            parts.append(docs.where(F.col("text").contains(t)).select(F.lit(i).alias("query_id"), F.lit(p).alias("term_pos"), "doc_id", best.alias("score")))
    if not parts:
        return docs.select(F.lit(0).alias("query_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).where("false")
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return rank.every(rank.merge_score_sets(every)).select("query_id", "rank", "doc_id", "score")


def search_unified(engine: Engine, docs: DataFrame, queries: str | list[str], mode: str) -> DataFrame:
    """suffix: full-text; inverted: exact terms; hybrid: exact terms, or full-text where these find nothing."""
    if mode == "suffix":
        return search_text(docs, queries)
    exact = engine.search_exact(queries).select("query_id", "rank", "doc_id", "score")
    if mode == "inverted":
        return exact
    rest = search_text(docs, queries)
    return exact.unionByName(rest.join(exact.select("query_id").distinct(), "query_id", "left_anti"))


class UnifiedIndex:
    """What the search mode of a corpus requires: its texts for suffix, an inverted index for inverted, both for hybrid."""

    def __init__(self, mode: str, docs: DataFrame, engine: Engine | None) -> None:
        self.mode, self.docs, self.engine = mode, docs, engine

    @classmethod
    def build(cls, docs: DataFrame, corpus: DataFrame, prefix: bool = True, fuzzy: bool = True, stop: frozenset[str] | None = None, built: Engine | None = None) -> "UnifiedIndex":
        """From one corpus with boundaries that count characters (`docs`) and bytes (`corpus`); the mode follows from its size and needs.

        An engine that is `built` already is taken where the mode needs one.
        """
        size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
        mode = select_mode(size["n"], size["b"], prefix, fuzzy)
        return cls(mode, docs, None if mode == "suffix" else built or Engine(Index.build(corpus, stop=stop)))

    def search(self, queries: str | list[str]) -> DataFrame:
        return search_text(self.docs, queries) if self.mode == "suffix" else search_unified(self.engine, self.docs, queries, self.mode)


SOURCES = (("title", 100.0), ("heading", 10.0), ("content", 1.0))


def union_corpora(inputs: DataFrame) -> dict[str, DataFrame]:
    """One corpus for each of the columns title, heading and content of inputs(doc_id, doc_title, ...), blank texts left out."""
    out = {}
    for name, _ in SOURCES:
        bound = F.array(F.struct(F.lit(None).cast("long").alias("docId"), F.lit(0).cast("long").alias("start"), F.octet_length(name).cast("long").alias("end"), F.lit(name).alias("fieldType"), F.lit(None).cast("string").alias("sectionId"), F.lit(5).alias("headingLevel")))
        out[name] = inputs.where(F.trim(F.col(name)) != "").select("doc_id", F.col("doc_title").alias("title"), F.col(name).alias("text"), bound.alias("boundaries"))
    return out


def search_union_grouped(engines: dict[str, Engine], queries: str | list[str]) -> dict[str, DataFrame]:
    """Hybrid results of each source."""
    return {name: e.search_hybrid(queries) for name, e in engines.items()}


def search_union(engines: dict[str, Engine], queries: str | list[str]) -> DataFrame:
    """(query_id, rank, doc_id, source, score): hybrid search of titles, headings and contents, scored 100, 10 or 1, the best source of each document."""
    every = None
    for k, (name, score) in enumerate(SOURCES):
        if name in engines:
            part = engines[name].search_hybrid(queries).select("query_id", "doc_id", F.lit(name).alias("source"), F.lit(score).alias("score"), F.lit(k).alias("_k"))
            every = part if every is None else every.unionByName(part)
    best = every.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("source", "_k").alias("source"))
    return rank.every(best).select("query_id", "rank", "doc_id", "source", "score")


def progressive(engine: Engine, query: str, limit: int = 10) -> Iterator[tuple[int, DataFrame]]:
    """After each tier, (tier, all results so far): tiers don't exclude each other here, a document's best row counts."""
    fetch = min(max(limit, 100), 1000)
    so_far = None
    for tier in (1, 2, 3):
        got = cut(engine.tier(query, tier, fetch))
        so_far = got if so_far is None else so_far.unionByName(got)
        yield tier, rank.merge_best(so_far, limit).select(*RESULT, "title")
