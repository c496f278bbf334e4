import random

import pytest
from pyspark.sql import functions as F

import naive
from tesserae.functions import text
from tesserae.operators import index as ix
from tesserae.operators import rank, suffixes, validate
from tesserae.operators.match import delete_neighbourhood, fuzzy_join, match_terms
from tesserae.plans import search as sp
from tesserae.streaming import ingest, progressive

CORPUS_SCHEMA = "doc_id long, title string, kind string, category string, text string, boundaries array<struct<docId: long, start: long, end: long, fieldType: string, sectionId: string, headingLevel: int>>"


def corpus(spark, docs):
    rows = [(d, t, "page" if d % 2 else "post", f"c{d % 3}", x, [(d, a, b, f, s, level) for a, b, f, s, level in bs]) for d, t, x, bs in docs]
    return spark.createDataFrame(rows, CORPUS_SCHEMA)


def generated(seed, n=25):
    """Documents of a few short words in titles, headings and contents, so that every tier has ties and folds."""
    r = random.Random(seed)
    vocab = ["rust", "rusts", "rusty", "trust", "ruse", "web", "webs", "guide", "gids", "é", "café", "cafe", "naïve", "x1"]
    docs = []
    for d in range(n):
        title = " ".join(r.choice(vocab) for _ in range(r.randint(1, 3)))
        out, bounds = title, [(0, len(title.encode()), "title", None, 0)]
        for k in range(r.randint(0, 4)):
            heading = " ".join(r.choice(vocab) for _ in range(2))
            body = ", ".join(r.choice(vocab) for _ in range(r.randint(1, 8)))
            for part, field, level in ((heading, "heading", r.randint(1, 5)), (body, "content", 5)):
                start = len(out.encode()) + 1
                out += "\n" + part
                bounds.append((start, len(out.encode()), field, f"s{k}", level))
        docs.append((d, title, out, bounds))
    return docs


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs = generated(1)
    index = ix.Index.build(corpus(spark, docs), stop=frozenset()).save(str(tmp_path_factory.mktemp("index")))
    return sp.Engine(index), naive.Naive(docs), docs


def rows(df, *names):
    return [tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in df.orderBy("rank").collect()]


def want(found):
    return [(r["doc"], round(r["score"], 9), r["sec"], r["mt"], r["term"]) for r in found]


NAMES = ("doc_id", "score", "section_idx", "match_type", "matched_term")
QUERIES = ["rust", "RUST web", "rus", "caf", "cafe", "café", "gide", "rust rust", "web guide rust", "zzz", "e", "trust x1"]


@pytest.mark.parametrize("tier", [1, 2, 3])
def test_tiers_equal_a_sequential_search(world, tier):
    engine, plain, _ = world
    for limit in (3, 100):
        got = engine.tier(QUERIES, tier, limit)
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9), r["section_idx"], r["match_type"], r["matched_term"]))
        for i, q in enumerate(QUERIES):
            assert found.get(i, []) == want(plain.tier(q, tier, limit)), (q, tier, limit)


@pytest.mark.parametrize("limit", [2, 10])
def test_tiered_search_equals_a_sequential_search(world, limit):
    engine, plain, _ = world
    for dedup in (True, False):
        got = engine.search(QUERIES, limit, dedup)
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9), r["section_idx"], r["match_type"], r["matched_term"]))
        for i, q in enumerate(QUERIES):
            assert sorted(found.get(i, [])) == sorted(want(plain.search(q, limit, dedup))), q


def test_empty_queries_and_limits(world):
    engine = world[0]
    for q in ("", "   ", "\t"):
        assert engine.search(q).count() == 0
    assert engine.search("rust", 0).count() == 0


def test_normalized_queries(world):
    engine = sp.Engine(world[0].index, normalize_query=True)
    assert engine.tier("CAFÉ", 1).count() == world[0].tier("cafe", 1).count() > 0
    assert world[0].tier("café", 1).count() == 0


def test_library_search(world):
    engine, plain, docs = world

    def expected(query, modes):
        sets = []
        for q in naive.normalize(query).split():
            k = 2 if len(q.encode()) > 5 else 1
            tests = {"exact": lambda t: t == q, "substring": lambda t: q in t, "fuzzy": lambda t: naive.distance(t, q) <= k}
            for m in modes:
                terms = [t for t in plain.vocab if tests[m](t)]
                if terms:
                    best = {}
                    for t in terms:
                        for _, d, base, *_ in plain.post[t]:
                            best[d] = max(best.get(d, 0), -base)
                    sets.append(best)
                    break
        if not sets:
            return []
        both = set.intersection(*map(set, sets))
        return sorted(((round(sum(s[d] for s in sets), 9), d) for d in both), key=lambda x: (-x[0], plain.titles[x[1]], x[1]))

    for mode, modes in (("exact", ["exact"]), ("substring", ["substring"]), ("fuzzy", ["fuzzy"]), ("hybrid", ["exact", "substring", "fuzzy"])):
        for q in ("rust", "Café web", "us gide", "zzzz rust", "nothinghere"):
            assert rows(engine.library(q, mode), "score", "doc_id") == expected(q, modes), (mode, q)


def test_library_cut(spark):
    docs = [(i, f"t{i:04d}", "same word", [(0, 9, "content", None, 5)]) for i in range(230)]
    engine = sp.Engine(ix.Index.build(corpus(spark, docs)))
    assert [r[0] for r in rows(engine.search_exact("same"), "doc_id")] == list(range(100))
    engine = sp.Engine(ix.Index.build(corpus(spark, docs[:200])))
    assert engine.search_exact("same").count() == 200


def test_title_beats_content_and_heading_lies_between(spark):
    docs = [(0, "a", "x rust", [(0, 1, "title", None, 0), (2, 6, "heading", "h", 2)]), (1, "b", "y rust", [(0, 1, "title", None, 0), (2, 6, "content", "h", 5)]), (2, "rust", "rust", [(0, 4, "title", None, 0)])]
    engine = sp.Engine(ix.Index.build(corpus(spark, docs)))
    assert [r[0] for r in rows(engine.search("rust"), "doc_id")] == [2, 0, 1]


def test_exclusion_uses_limited_results(spark):
    docs = [(i, f"t{i}", "term", [(0, 4, "content", None, 5)]) for i in range(6)]
    engine = sp.Engine(ix.Index.build(corpus(spark, docs)))
    one, two, _ = engine.tiers("term", 2)
    assert {r["doc_id"] for r in one.collect()} == {0, 1} and {r["doc_id"] for r in two.collect()} == {2, 3}


def test_progressive_and_stream(world):
    engine, plain, _ = world
    seen = list(sp.progressive(engine, "rust", 5))
    assert [t for t, _ in seen] == [1, 2, 3] and all(df.count() <= 5 for _, df in seen)
    last = rows(seen[-1][1], "doc_id", "score")
    every = [dict(r, tier=t) for t in (1, 2, 3) for r in plain.tier("rust", t, 100)]
    best = {}
    for r in sorted(every, key=lambda r: (*plain.key(r)[:4], r["tier"])):
        best.setdefault(r["doc"], r)
    assert last == [(r["doc"], round(r["score"], 9)) for r in sorted(best.values(), key=plain.key)][:5]
    steps = list(progressive.stream(engine, "rust", 6))
    assert [s for s, _ in steps] == ["tier 1", "tier 2", "tier 3", "finished"]
    ids = [r["doc_id"] for _, df in steps[:-1] for r in df.collect()]
    assert len(ids) == len(set(ids)) <= 6
    assert steps[-1][1].count() <= 6
    assert list(progressive.stream(engine, " ")) == []


def test_timed_search_and_resolution(world):
    engine, plain, _ = world
    found, stats = engine.search_timed("rust", 5)
    assert rows(found, *NAMES) == want(plain.search("rust", 5)) and stats["t1_count"] == len(plain.tier("rust", 1, 5))
    assert {"section_id"} <= set(engine.resolve(found).columns)
    assert engine.doc_count() == 25 and engine.vocab_size() == len(plain.vocab)


def test_index_round_trip_filters_and_violations(spark, world, tmp_path):
    engine, plain, docs = world
    df = corpus(spark, docs)
    path = str(tmp_path / "i")
    saved = ix.Index.build(df, {"category": "c1", "type": "post"}, ["title"], frozenset()).save(path)
    again = ix.Index.load(spark, path, check=True)
    assert {r["doc_id"] for r in again.docs.collect()} == {d for d in range(25) if d % 3 == 1 and d % 2 == 0}
    assert {r["field_type"] for r in saved.boundaries.collect()} == {"title"}
    assert again.postings.where("field_type = 'content'").count() > 0
    assert validate.index_violations(again).count() == 0
    assert validate.hierarchy_violations(engine.index.postings).count() == 0
    broken = ix.Index(again.docs.limit(0), again.boundaries, again.postings, again.vocab.limit(1), again.sections)
    assert {"document_unknown", "doc_freq_differs", "documents_empty"} <= {r["rule"] for r in validate.index_violations(broken).collect()}
    spark.createDataFrame([(99, "{}")], "version int, counts string").write.mode("overwrite").json(f"{path}/meta")
    with pytest.raises(ValueError):
        ix.Index.load(spark, path)
    assert [tuple(r) for r in engine.index.sections.orderBy("section_idx").collect()] == sorted((i, s) for s, i in plain.section.items())
    assert [r["term"] for r in engine.index.vocab.orderBy("term_idx").collect()] == plain.vocab
    assert ix.include(df, "anything").count() == 25 and ix.include(df, {"author": "x"}).count() == 25


def test_custom_scores(spark, world):
    engine, _, docs = world
    df = corpus(spark, docs)
    index = ix.Index.build(df, stop=frozenset(), scorer=lambda c: (7.9 if c["term"] == "rust" else -3) + 0 * len(c["doc"]["title"]))
    assert {(r["term"] == "rust", r["score"]) for r in index.postings.select("term", "score").distinct().collect()} == {(True, 7), (False, 0)}
    with pytest.raises(Exception, match="finite"):
        ix.Index.build(df, scorer=lambda c: float("nan")).postings.select("score").collect()


def test_matching(spark):
    vocab = spark.createDataFrame([(t,) for t in ["hello", "hallo", "helloo", "helo", "world", "ehllo", "", "straße", "strasse"]], "term string")
    q = [(0, 0, "hello"), (1, 0, "lo"), (2, 0, "")]
    assert {(r["qt"], r["term"]) for r in match_terms(vocab, q, "substring").collect()} >= {("lo", "hallo"), ("hello", "helloo"), ("lo", "ehllo")}
    assert {(r["term"], r["distance"]) for r in match_terms(vocab, q[:1], "fuzzy").collect()} == {("hello", 0), ("hallo", 1), ("helloo", 1), ("helo", 1), ("ehllo", 2)}
    assert {r["term"] for r in match_terms(vocab, q[:1], "library_fuzzy").collect()} == {"hello", "hallo", "helloo", "helo"}
    assert match_terms(vocab, [], "exact").count() == 0
    with pytest.raises(ValueError):
        match_terms(vocab, q, "sound")
    many = [(i, 0, f"q{i}") for i in range(300)] + [(300, 0, "world")]
    assert [tuple(r)[:4] for r in match_terms(vocab, many, "exact").collect()] == [(300, 0, "world", "world")]
    rnd = random.Random(2)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    left, right = spark.createDataFrame([(t,) for t in set(terms[:40])], "term string"), spark.createDataFrame([(t,) for t in set(terms[40:])], "qt string")
    got = {tuple(r) for r in fuzzy_join(left, right).select("qt", "term", "distance").collect()}
    assert got == {(b, a, naive.distance(a, b)) for a in set(terms[:40]) for b in set(terms[40:]) if naive.distance(a, b) <= 2}
    one = vocab.limit(1).select(delete_neighbourhood(F.lit("abc"), 1).alias("x")).first()["x"]
    assert sorted(one) == ["ab", "abc", "ac", "bc"]


def test_text_search_and_unified(spark):
    docs = [(0, "a", "TypeScript rules", [(0, 10, "title", None, 0), (11, 16, "content", "s", 5)]), (1, "b", "see JavaScript and TypeScript", [(0, 3, "title", None, 0), (4, 29, "content", "s", 5)]), (2, "c", "none", [])]
    df = corpus(spark, [(d, t, x.lower(), b) for d, t, x, b in docs])
    got = rows(sp.search_text(df, "script"), "doc_id", "score")
    assert got == [(0, round(100 + 0.5 * (1 - 4 / 16), 9)), (1, round(1 + 0.5 * (1 - 8 / 29), 9))]
    assert [r[0] for r in rows(sp.search_text(df, "script see nowhere"), "doc_id")] == [1]
    assert sp.search_text(df, "").count() == 0
    engine = sp.Engine(ix.Index.build(df, stop=frozenset()))
    assert sp.search_unified(engine, df, "script", "inverted").count() == 0
    assert sp.search_unified(engine, df, "script", "hybrid").count() == 2
    assert sp.search_unified(engine, df, "see", "hybrid").count() == 1
    assert sp.search_unified(engine, df, "rules", "suffix").count() == 1


def test_union_search(spark):
    inputs = spark.createDataFrame([(0, "a", "rust book", "", "about"), (1, "b", "x", "rust", "rust"), (2, "c", "y", "z", "rust")], "doc_id long, doc_title string, title string, heading string, content string")
    engines = {n: sp.Engine(ix.Index.build(c, stop=frozenset())) for n, c in sp.union_corpora(inputs).items()}
    assert rows(sp.search_union(engines, "rust"), "doc_id", "source", "score") == [(0, "title", 100.0), (1, "heading", 10.0), (2, "content", 1.0)]
    grouped = sp.search_union_grouped(engines, "rust")
    assert {n: [r[0] for r in rows(df, "doc_id")] for n, df in grouped.items()} == {"title": [0], "heading": [1], "content": [1, 2]}


def test_suffix_arrays(spark):
    texts = ["banana", "bandana", "", "éclair ban", "aaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    array = suffixes.suffix_array(docs)
    got = [(r["doc_id"], r["offset"], r["lcp"]) for r in array.orderBy("place").collect()]
    plain = sorted(((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t))), key=lambda x: (x[0].encode(), x[1], x[2]))
    lcp = [0] + [len(__import__("os").path.commonprefix([a[0], b[0]])) for a, b in zip(plain, plain[1:])]
    assert got == [(d, i, n) for (_, d, i), n in zip(plain, lcp)]
    assert validate.suffix_violations(array, docs).count() == 0
    assert {r["rule"] for r in validate.suffix_violations(array.where("offset > 0"), docs).collect()} >= {"incomplete"}
    assert suffixes.search(array, "ban").count() == 3
    words = spark.createDataFrame([("ab",), ("b",)], "term string")
    assert [(r["term"], r["offset"]) for r in suffixes.vocabulary_suffix_array(words).orderBy("place").collect()] == [("ab", 0), ("ab", 1), ("b", 0)]


def test_sections(spark):
    bounds = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 9, "b"), (2, 0, 4, "bad id"), (2, 3, 8, "c"), (3, 2, 2, "d")], "doc_id long, start long, end long, section_id string")
    lengths = spark.createDataFrame([(1, 9), (2, 20), (3, 2)], "doc_id long, text_len long")
    got = {(r["rule"], r["doc_id"]) for r in validate.sections(bounds, lengths).collect()}
    assert got == {("bad_id", 2), ("overlap", 2), ("short", 2), ("malformed", 3), ("gap", 3)}
    at = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 30), (3, 1)], "doc_id long, offset long")
    assert {(r["doc_id"], r["offset"]): r["section_id"] for r in validate.section_at(at, bounds).collect()} == {(1, 0): "a", (1, 4): "a", (1, 5): "b", (1, 30): None, (3, 1): None}


def test_merging(spark):
    s = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 0, 2, 3.0), (0, 1, 1, 1.5), (0, 1, 2, 2.5), (0, 1, 2, 0.5)], "query_id int, term_pos int, doc_id long, score double")
    assert {(r["doc_id"], r["score"]) for r in rank.merge_score_sets(s).collect()} == {(1, 3.5), (2, 5.5)}
    stats = rank.benchmark_statistics(spark.createDataFrame([("a", 10.0), ("a", 10.1), ("a", 9.9)], "k string, v double"), ["k"], "v").first()
    assert stats["stable"] and abs(stats["mean"] - 10) < 1e-9 and abs(stats["sd"] - 0.1) < 1e-9


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ünï  Code\tß ", "a-b"), ("हिन्दी 한글", "https://x.org/a/b"), (None, None)], "s string, u string")
    got = [tuple(r) for r in df.select(text.normalize_exact("s"), text.normalize(F.col("s")), text.normalize_light(F.col("s")), text.slugify(F.col("s")), text.href_prefix(F.col("u"))).collect()]
    assert got[0] == ("uni code ß", "uni code ß", "ünï code ß", "n-code", None)
    assert got[1][0] == text.normalize_text("हिन्दी 한글") and got[1][4] == "https://x.org/a/" and got[2] == (None,) * 5
    assert text.normalize_text("नमस्ते") == "" and text.parse_tiered(" A\tb ") == ["a", "b"] and text.parse_library("Él") == ["el"]
    pairs = spark.createDataFrame([("abcd", "abxy"), ("", "a"), ("same", "same"), ("éa", "éb")], "a string, b string")
    assert [r[0] for r in pairs.select(text.common_prefix_length(F.col("a"), F.col("b"))).collect()] == [2, 0, 4, 1]
    d = pairs.select(text.levenshtein_within(F.col("a"), F.col("b"), 1)).collect()
    assert [r[0] for r in d] == [None, 1, 0, 1]
    assert "the" in text.stop_words() and "für" in text.stop_words("de") and "fur" in text.stop_words("de")
    assert text.format_bytes(10) == "10 B" and text.format_bytes(2048) == "2.0 KB"
    marks = spark.createDataFrame([("a",), (" ",), ("é",), ("-",)], "c string")
    assert [r[0] for r in marks.select(text.is_word_boundary(F.col("c"))).collect()] == [False, True, False, True]


def test_index_modes():
    assert [ix.select_mode(*x) for x in ((50, 100_000), (51, 1), (600, 1), (600, 1, False, False), (60, 10**6, False, False))] == ["suffix", "suffix", "hybrid", "inverted", "suffix"]


def test_incremental_indexing(spark, tmp_path):
    docs = generated(5, 12)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    corpus(spark, docs[:6]).write.parquet(inbox)
    stream = lambda: spark.readStream.schema(CORPUS_SCHEMA).parquet(inbox)
    ingest.append_postings(stream(), out, str(tmp_path / "c"), frozenset()).awaitTermination(120)
    corpus(spark, docs[6:]).write.mode("append").parquet(inbox)
    ingest.append_postings(stream(), out, str(tmp_path / "c"), frozenset()).awaitTermination(120)
    got = spark.read.parquet(out)
    plain = naive.Naive(docs)
    assert got.groupBy("term").count().count() == len(plain.vocab) and got.count() == sum(map(len, plain.post.values()))
