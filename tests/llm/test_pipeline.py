import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import langid, quality, queries
from test_simhash import brute as brute_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(12)
    syllables = {"en": ["the", "an", "er", "ing", "st", "ou"], "de": ["sch", "ung", "öf", "ein", "keit", "der"]}
    vocab = {k: ["".join(r.choice(v) for _ in range(r.randint(1, 3))) for _ in range(300)] for k, v in syllables.items()}
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(vocab[lang]) for _ in range(r.choice([40, 120, 400]))), lang))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(12)]
    rows += [(320 + i, rows[i][1].upper(), rows[i][2]) for i in range(3)]
    rows += [(400, None, "en"), (401, "", None), (402, "too short", "en"), (403, "0 1 2 3 4 5 6 7 8 9 10 11 12", "en"), (404, "a b c d e " * 30, "de"), (None, rows[20][1], None)]
    rows += [rows[3], rows[3]]
    return [(i, t, lang, "hot" if (i or 0) % 3 else None, len(t or "")) for i, t, lang in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "near_dedup", "best_fit_packing"]

    good = stages["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {(r["doc_id"]) for r in quality.judge(docs).where("kept").collect()}
    want = Counter(r for r in map(tuple, docs.collect()) if r[0] in kept)
    assert plain(good) == want and 404 not in kept and 402 not in kept and len(kept) > 230

    identified = stages["language_id"](spark, good, folder)
    model = langid.fit(good)
    ok = {r["doc_id"] for r in langid.identify(good, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert identified.columns == docs.columns and plain(identified) == Counter({r: n for r, n in plain(good).items() if r[0] in ok})

    unique = stages["near_dedup"](spark, identified, folder)
    rows = [(r["doc_id"], r["text"]) for r in identified.collect()]
    groups = {r[3] for r in brute_dedup(rows)}
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == sorted(groups)
    assert unique.join(identified, "doc_id", "left_anti").count() == 0

    packed = stages["best_fit_packing"](spark, unique, folder)
    assert {r["doc_id"] for r in packed.collect()} == groups
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert fill[0] <= 1024 and fill[2] <= -(-fill[1] // 1024) * 1.05 + 1


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert plain(got.select(*names)) == plain(docs.select(*names))


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and [x.split()[0] for x in COLUMNS.split(", ")] == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_stages_take_long_texts_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.where("doc_id < 100")
    word = first.first()["text"].split()
    long = " ".join(word[(i * i + i // 7) % len(word)] + word[i * 3 % len(word)] for i in range(120_000))
    extra = first.unionByName(spark.createDataFrame([(7000, long, "en", None, len(long))], COLUMNS))
    extra = extra.withColumns({c: F.lit(1) for c in ("_id", "_key", "_text_key", "chunk", "part", "nll", "fp", "root", "kept", "score", "lang_pred", "n")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, folder)
        assert got.columns == extra.columns and got.count() > 50, name
    packed = corpus_pipeline.STAGES[-1][1](spark, extra.where("doc_id = 7000"), folder).collect()
    assert sum(r["length"] for r in packed) > 120_000 and max(r["length"] for r in packed) == 1024


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_their_columns(spark, folder, name):
    want = {
        "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op2_html_text": "page_id url text n_chars",
        "op4_simhash": "doc_id fingerprint n_near component_id",
        "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6_toxicity": "doc_id held_out score predicted",
        "op8_language_id": "doc_id held_out lang_pred score",
        "op9_imatch": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    }
    got = queries.QUERIES[name](spark, folder)
    assert set(want.get(name, "doc_id").split()) <= set(got.columns)
    rows = got.count()
    table = "pages" if name == "op2_html_text" else "documents"
    total = spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert rows >= total if name in ("op5_packing", "op7_token_counts") else rows == total
