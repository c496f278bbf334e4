"""The staged loader, checksums, layout of common terms, ranks without windows and the unified index."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import index as ix
from tesserae.operators import rank, validate
from tesserae.plans import search as sp
from test_search import corpus, generated


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved"))
    ix.Index.build(corpus(spark, generated(3)), stop=frozenset()).save(path, check=True)
    return path


def test_staged_loading(spark, saved):
    loader = ix.IncrementalLoader(spark, saved)
    assert loader.pending == ix.TABLES and loader.pending_count() == 5 and not loader.is_complete()
    with pytest.raises(ValueError, match="postings"):
        loader.finalize()
    loader.load("vocab", check=True)
    assert loader.tables["vocab"].count() == loader.header["counts"]["vocab"] and loader.pending_count() == 4
    with pytest.raises(ValueError):
        loader.load("nothing")
    for name in loader.pending:
        loader.load(name, check=True)
    assert loader.is_complete() and sp.Engine(loader.finalize()).search("rust").count() > 0


def test_checksums_and_rules_on_load(spark, saved, tmp_path):
    index = ix.Index.load(spark, saved, check=True)
    assert ix.checksum(index.postings) == ix.checksum(index.postings.repartition(7)) != ix.checksum(index.postings.limit(3))
    path = str(tmp_path / "bad")
    index.save(path, check=True)
    index.docs.withColumn("title", F.lit("changed")).write.mode("overwrite").parquet(f"{path}/docs")
    with pytest.raises(ValueError, match="checksum"):
        ix.Index.load(spark, path, check=True)
    ix.Index.load(spark, path)
    wrong = ix.Index(index.docs, index.boundaries, index.postings.withColumn("score", F.lit(0)), index.vocab, index.sections)
    wrong.save(path)
    with pytest.raises(ValueError, match="score_not_positive"):
        ix.Index.load(spark, path, check=True)


def test_report_names_every_rule(spark, saved):
    index = ix.Index.load(spark, saved)
    assert {r["rule"]: r["violations"] for r in validate.report(index).collect()} == dict.fromkeys(validate.RULES, 0)
    mixed = ix.Index(index.docs, index.boundaries, index.postings, index.vocab.withColumn("term_idx", -F.col("term_idx")), index.sections)
    assert {r["rule"] for r in validate.report(mixed).where("violations > 0").collect()} == {"vocabulary_unsorted"}


def test_common_terms_are_dealt_over_all_parts(spark):
    docs = [(i, f"t{i}", "same same " + f"w{i % 40}", [(0, 3, "content", None, 5)]) for i in range(400)]
    df = corpus(spark, docs)
    assert ix.hot_terms(df, 4, frozenset(), one_in=1) == ["same"] and ix.hot_terms(df.limit(0), 4, frozenset()) == []
    post = ix.postings(df, frozenset())
    parts = ix.by_term(post, ["same"], 4).withColumn("p", F.spark_partition_id())
    assert parts.count() == post.count() == 1200 and set(parts.drop("p").columns) == set(post.columns)
    spread = parts.groupBy("term").agg(F.countDistinct("p").alias("n")).collect()
    assert all(r["n"] == (4 if r["term"] == "same" else 1) for r in spread)


def test_ranks_of_whole_results(spark):
    r = random.Random(2)
    rows = [(q, d, float(r.randint(0, 5))) for q in range(3) for d in range(r.randint(0, 60))]
    got = rank.every(spark.createDataFrame(rows, "query_id int, doc_id long, score double").repartition(5)).collect()
    for q in range(3):
        mine = sorted(((s, d) for p, d, s in rows if p == q), key=lambda x: (-x[0], x[1]))
        assert sorted((g["rank"], g["doc_id"], g["score"]) for g in got if g["query_id"] == q) == [(n, d, s) for n, (s, d) in enumerate(mine, 1)]
    assert rank.every(spark.createDataFrame([], "query_id int, doc_id long, score double")).count() == 0


def test_unified_index_follows_its_mode(spark):
    few, many = corpus(spark, generated(4, 5)), corpus(spark, generated(4, 510))
    assert sp.UnifiedIndex.build(few, few).mode == "suffix" and sp.UnifiedIndex.build(few, few).engine is None
    both = sp.UnifiedIndex.build(many, many, stop=frozenset())
    assert both.mode == "hybrid" and both.search("rust").count() == both.engine.search_exact("rust").count() > 0
    assert both.search("trus").count() == sp.search_text(many, "trus").count() > 0
    exact = sp.UnifiedIndex.build(many, many, prefix=False, fuzzy=False, stop=frozenset())
    assert exact.mode == "inverted" and exact.search("trus").count() == 0


def test_timing_until_stable():
    s = rank.sample_until_stable(lambda: sum(range(20_000)), 99, 5, 400)
    assert 5 <= s["n"] <= 400 and s["low"] <= s["mean"] <= s["high"]
    with pytest.raises(KeyError):
        rank.sample_until_stable(lambda: None, 50, 2, 3)
