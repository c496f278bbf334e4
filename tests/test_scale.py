"""Steps whose cost must not outgrow the input: what is broadcast, shuffled and left open by ties."""

import random

import pytest
from pyspark.sql import functions as F

import naive
import oracle
from tesserae import catalogue
from tesserae.operators import index as ix
from tesserae.operators import rank, validate
from tesserae.operators.match import fuzzy_join
from tesserae.plans import search as sp
from test_search import corpus, generated


def test_fuzzy_join_never_broadcasts_the_vocabulary(spark, tmp_path):
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(300)}
    spark.createDataFrame([(w,) for w in sorted(words)], "term string").write.parquet(str(tmp_path / "vocab"))
    asked = sorted(words)[::7] + ["", "a", "bb"]
    vocab, queries = spark.read.parquet(str(tmp_path / "vocab")), spark.createDataFrame([(w,) for w in asked], "qt string")
    for most in (1, 2):
        found = fuzzy_join(vocab, queries, most)
        want = {(q, t, naive.distance(q, t)) for q in asked for t in words if naive.distance(q, t) <= most}
        assert {tuple(x) for x in found.select("qt", "term", "distance").collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("name", ["html_titles", "html_sections"])
def test_references_are_decoded_as_in_sql(spark, tmp_path, name):
    heads = ["a &quot;b&quot; &amp;amp; c", "x &lt;y&gt;", "&#39;s&nbsp;t", "&amp;lt; <b>bold</b>"]
    pages = [(i, f"https://a.org/{i}", f"<p>z</p><h1 class='t'>{h}</h1><p>y &quot;</p>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert oracle.differences(df, oracle.connect(str(tmp_path)), catalogue.ORACLES[name]) == ""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_written_without_exchanging_postings(spark, tmp_path):
    docs = corpus(spark, generated(6)).repartition(9)
    twice = docs.unionByName(docs.where("doc_id < 5"))
    laid = ix.Index.build(twice, stop=frozenset()).segments
    assert "hashpartitioning(term" not in plan_of(laid)
    got = ix.Index.build(twice, stop=frozenset()).save(str(tmp_path / "i"), check=True)
    once = ix.Index.build(docs, stop=frozenset()).save(str(tmp_path / "j"), check=True)
    assert got.postings.columns == once.postings.columns and "first" not in got.postings.columns
    assert "hashpartitioning(term" not in plan_of(spark.read.parquet(str(tmp_path / "i/postings")))
    for index in (got, once):
        want = {r["term"]: r["n"] for r in ix.postings(docs, frozenset()).groupBy("term").agg(F.countDistinct("doc_id").alias("n")).collect()}
        assert {r["term"]: r["doc_freq"] for r in index.vocab.collect()} == want
    assert sorted(map(tuple, got.postings.select("term", "doc_id", "offset", "score", "base_score").collect())) == sorted(map(tuple, ix.postings(twice, frozenset()).select("term", "doc_id", "offset", "score", "base_score").collect()))


def test_segments_are_sorted_by_term(spark):
    rows = ix.segments(corpus(spark, generated(7)).coalesce(1), frozenset()).collect()
    assert [r["term"] for r in rows] == sorted(r["term"] for r in rows)
    seen = set()
    for r in rows:
        assert r["first"] == ((r["term"], r["doc_id"]) not in seen)
        seen.add((r["term"], r["doc_id"]))


def test_found_terms_are_broadcast_whatever_the_vocabulary_measures(spark, tmp_path):
    engine = sp.Engine(ix.Index.build(corpus(spark, generated(8)), stop=frozenset()).save(str(tmp_path / "i")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (engine.tier("rus", 2), engine.tier("rus we", 2), engine.tier("gide", 3), engine.library("rus gide", "hybrid"), engine.library("rus", "substring")):
            assert "hashpartitioning(term" not in plan_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_addends_tie_in_any_order(spark):
    hits = [(0, p, d, None, 4, s, "t", p) for d, scores in ((1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.3))) for p, s in enumerate(scores)]
    df = spark.createDataFrame(hits, "query_id int, term_pos int, doc_id long, section_id string, match_type int, score double, term string, seq int").coalesce(1)
    titles, n = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, title string"), spark.createDataFrame([(0, 3)], "query_id int, n long")
    got = rank.accumulate(df, n, titles, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 0.6), (2, 0.6)]
    sums = rank.merge_score_sets(df.select("query_id", "term_pos", "doc_id", "score")).collect()
    assert {(r["doc_id"], r["score"]) for r in sums} == {(1, 0.6), (2, 0.6)}


def test_own_scores_join_nothing(spark):
    docs = corpus(spark, generated(9)).repartition(9)
    post = ix.Index.build(docs, stop=frozenset(), scorer=lambda c: 3.5 + c["doc"]["doc_id"] + 100 * len(c["doc"]["title"]) + c["match"]["offset"]).postings
    assert "Join" not in plan_of(post)
    titles = {r["doc_id"]: r["title"] for r in docs.collect()}
    rows = post.collect()
    assert len(rows) == ix.postings(docs, frozenset()).count() and all(r["score"] == 3 + r["doc_id"] + 100 * len(titles[r["doc_id"]]) + r["offset"] for r in rows)


def test_long_posting_lists_are_ranked_in_pieces(spark, monkeypatch):
    post = ix.postings(corpus(spark, generated(10, 60)), frozenset())
    want = {}
    for r in sorted(post.collect(), key=lambda r: (r["term"], -r["score"], r["doc_id"], -r["base_score"], r["offset"])):
        want.setdefault(r["term"], []).append((r["doc_id"], r["offset"]))
    for most in (7, 1 << 20):
        monkeypatch.setattr(ix, "LIST", most)
        df = ix.posting_places(post)
        assert {(r["term"], r["place"], r["doc_id"], r["offset"]) for r in df.collect()} == {(t, n, *x) for t, xs in want.items() for n, x in enumerate(xs, 1)}
        assert df.count() == post.count() and set(df.columns) == {*post.columns, "place"} and "rangepartitioning" not in plan_of(df)
    assert max(map(len, want.values())) > 14


def test_sections_of_offsets_need_one_exchange(spark):
    offsets = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 3)], "doc_id long, offset long")
    bounds = spark.createDataFrame([(1, 0, 4, "a"), (1, 5, 8, "b"), (3, 0, 9, "c")], "doc_id long, start long, end long, section_id string")
    df = validate.section_at(offsets, bounds)
    assert {tuple(r) for r in df.select("doc_id", "offset", "section_id").collect()} == {(1, 0, "a"), (1, 5, "b"), (1, 9, None), (2, 3, None)}
    assert plan_of(df).count("Exchange") == 1 and "Join" not in plan_of(df)
