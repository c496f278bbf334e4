import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import html_blocks as hb
from tesserae.llm import terms, toxicity
from tesserae.llm import textops as T


def test_blocks_decode_and_survive_broken_markup():
    page = "<!DOCTYPE html><head><title>no</title></head><body>lead <b>bold<!-- x > y --> in</b>\n<p>one<br>two &amp;amp; &eacute;&nbsp;z<p>three<script>var t='</p>';</script> four<div class='a b' id=c>five</div></section>tail <a href='>'>link</a> <unclosed"
    texts, paths, links = hb.blocks(page)
    assert texts[:4] == ["lead bold in", "one two &amp; é z", "three four", "five"] and texts[4].startswith("tail link")
    assert paths[3].path()[-4:] == ("div", "c:a", "c:b", "i:c") and links[0] == 0 < links[4]
    for bad in (None, "", "   ", "plain text", "<", "<p", "<script>never closed", "<!-- open", "<div " * 300, "&#0; &bogus; &#x110000;"):
        hb.blocks(bad)


def test_only_what_is_not_shown_is_left_out():
    page = "<article><p>a <svg/> b <math><mi>x</mi>=<mn>2</mn></math> c<svg><text>no</text></svg> d<video src=x>e<p>f <select><option>o</select> g <template><p>t</p></template>h</article>"
    assert hb.blocks(page)[0] == ["a b x=2 c de", "f g h"]
    deep = "<footer>" + "<div class='a b c'>" * 300 + "x" + "</div>" * 300 + "</footer><p>y"
    texts, paths, _ = hb.blocks(deep)
    assert texts == ["x", "y"] and len(paths[0].path()) == 1 + 4 * 300 and paths[0].path()[0] == "footer" and paths[1].path() == ("p",)


@pytest.mark.parametrize("piece", ["<script ", '<a "', "<a '", "<div>", "<svg", "<", "<!--", "</", "<p class='", "&amp", "<video>", "<select>x", '<div x="<" ', "a=b <", "<td><tr>", "</div>", "<math><mi>", "<title>"])
def test_malformed_pages_of_a_megabyte(piece):
    began = time.process_time()
    hb.blocks(piece * (1_000_000 // len(piece)))
    hb.blocks("<div><p>" * 60_000 + piece * (500_000 // len(piece)))
    assert time.process_time() - began < 10


def test_hand_written_pages():
    pages = [
        ("""<html><body><div id="wrap"><div class="masthead"><a href="/">The Daily Example</a></div>
<ul class="menu"><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul>
<div class="story"><h1>Bridge reopens after repairs</h1><p>The old bridge over the river opened again on Monday after eight months of work.</p>
<p>Engineers replaced the deck and most of the railings, the council said.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="1">Ten ways to cook rice</a></li><li><a href="2">Weather for the week</a></li></ul></div>
<div class="footer">Copyright The Daily Example. All rights reserved.</div></div></body></html>""",
         "Bridge reopens after repairs The old bridge over the river opened again on Monday after eight months of work. Engineers replaced the deck and most of the railings, the council said."),
        ("""<body><header><a href=/>My notes</a></header><nav><a href=/a>About</a> <a href=/b>Archive</a></nav><main>
<h1>Growing beans</h1><p>Beans want warmth, so wait until the soil is warm before you sow them in rows.</p><ul><li>Water them well in dry weeks.</li><li>Pick them young and often.</li></ul></main>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Great post, thanks for sharing it with us all!</p></div></section><footer>&copy; 2020 My notes</footer></body>""",
         "Growing beans Beans want warmth, so wait until the soil is warm before you sow them in rows. Water them well in dry weeks. Pick them young and often."),
    ]
    assert hb.main_texts(hb.trained(), [p for p, _ in pages]) == [t for _, t in pages]


def test_gradients_are_right():
    r = np.random.default_rng(0)
    m = hb.Labeller(3, width=5, hidden=4)
    x, mask = r.normal(size=(6, 3, 5)), np.ones((6, 3))
    mask[4:, 1] = 0
    y = (r.random((6, 3)) > 0.5).astype(float)
    _, g = m.gradients(x, mask, y)
    for k in m.p:
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in m.p[k].shape)
            old = m.p[k][i]
            m.p[k][i] = old + 1e-5
            up = m.gradients(x, mask, y)[0]
            m.p[k][i] = old - 1e-5
            down = m.gradients(x, mask, y)[0]
            m.p[k][i] = old
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5


def test_held_out_layouts():
    model, r = hb.trained(), random.Random(99)
    hit = wrong = missed = 0
    for _ in range(150):
        page, main = hb.generated_page(r)
        parsed = hb.blocks(page)
        left = list(main)
        for t, p in zip(parsed[0], hb.label(model, [parsed])[0]):
            real = t in left
            if real:
                left.remove(t)
            hit += real and p >= 0.5
            wrong += not real and p >= 0.5
            missed += real and p < 0.5
        assert not left
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_extract(spark):
    body = "<article><h1>A title of words</h1><p>" + "Some prose of the article, with words. " * 9 + "</p><p>More &amp; more of it here.</p></article>"
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav>{body}<footer>&copy; site</footer></body></html>"
    rows = [(1, "u", page, "x")] * 2 + [(2, None, None, "x"), (3, "v", "", "x"), (None, "w", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hb.extract(df).collect()
    want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == sorted([(1, want, len(want))] * 2 + [(2, "", 0), (3, "", 0), (0, want, len(want))])
    assert hb.extract(df.limit(0)).count() == 0


def corpus():
    r = random.Random(6)
    vocab = ["".join(r.choice("aeiou" if k % 2 else "bcdfgt") for k in range(5)) for _ in range(900)]
    bad = ["vile", "nasty", "rotten", "crude", "foul", "rank", "mean", "grim"]
    rows, labels = [], []
    for i in range(600):
        toxic = r.random() < 0.25
        w = [r.choice(vocab) for _ in range(40)]
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(bad).upper() + r.choice(["", ",", "."]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "VILE! nasty rotten"), (None, "vile crude nasty"), (5, rows[5][1])]
    docs = spark.createDataFrame([(a, b, 1.0, "xx") for a, b in rows + extra], "doc_id long, text string, score double, lang string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    truth = {i: y for i, _, y in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["held_out"] for i in held) and not by[None]["held_out"]
    assert all(by[i]["predicted"] == truth[i] for i in held)
    assert by[1000]["predicted"] == by[1001]["predicted"] == 0 and by[1002]["predicted"] == by[None]["predicted"] == 1
    flipped = spark.createDataFrame([(i, q, 1 - y if i in set(held) else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}
    assert all(abs(again[i] - by[i]["score"]) < 1e-12 for i in by)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_toxicity_without_toxic_labels_or_rows(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r["predicted"] for r in toxicity.score(docs, known).collect()} == {0}
    assert toxicity.score(docs.limit(0), known).count() == 0


def keys_of(words):
    data, off = T.column(pa.array(words))
    return toxicity._letters(data, off)[0]


def test_graph_walk_and_lexicon_equal_brute_force(spark, monkeypatch):
    rows, labels = corpus()
    rows, window = rows[:250], 3
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(3)
    words = [re.findall(r"[a-z]+", t.lower()) for _, t in rows]
    single = Counter(w for x in words for w in set(x))
    seeds = ["vile", "nasty", "rotten", *[w for w, _ in single.most_common(12) if w not in "vile nasty rotten crude foul rank mean grim"][-4:]]
    key = dict(zip(single, keys_of(list(single)).tolist()))
    order = np.argsort(np.array([key[s] for s in seeds], np.uint64))
    names = [seeds[i] for i in order]
    monkeypatch.setattr(terms, "_HELD", 3000)
    edges = toxicity.seed_graph(df, np.array([key[s] for s in names], np.uint64), window, 2)
    near = Counter()
    for x in words:
        near.update({(x[i + k], x[i]) for i in range(len(x)) for k in range(-window, window + 1) if k and 0 <= i + k < len(x) and x[i] in names and x[i + k] != x[i]})
    n = len(rows) + 2
    want = {(key[w], names.index(s)): (c, single[w], np.log(c * n / (single[w] * single[s]))) for (w, s), c in near.items() if c >= 2 and c * n > single[w] * single[s]}
    got = {(r["word"] % 2**64, r["seed"]): (r["n"], r["df"], r["weight"]) for r in edges.collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)

    table = {w: i for i, w in enumerate(sorted({w for w, _ in want}))}
    a = np.zeros((len(names), len(table)))
    for (w, s), (_, _, v) in want.items():
        a[s, table[w]] = v
    to = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
    back = (a / a.sum(axis=0)).T
    starts = np.array([[1 / 3 if x in ("vile", "nasty", "rotten") else 0.0 for x in names], [0.0 if x in ("vile", "nasty", "rotten") else 1 / 4 for x in names]])
    x = starts.copy()
    for _ in range(12):
        alone = np.where(a.sum(axis=1) > 0, 0.0, x)
        x = 0.5 * (x @ to @ back + alone) + 0.5 * starts
    walked, _ = toxicity.walk(edges.repartition(2, "word"), starts)
    assert np.abs(walked - x).max() < 1e-12 and np.abs(walked.sum(axis=1) - 1).max() < 1e-9


def test_rare_toxic_words_count(spark):
    """Words in 4 of 3000 documents are seeds if these are labelled; an unlabelled word that always stands by one has a polarity."""
    r = random.Random(3)
    vocab = ["".join(r.choice("aeiou" if k % 2 else "bcdfgt") for k in range(5)) for _ in range(500)]
    rows, labels = [], []
    learned = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    bad, unlabelled = set(learned[:40:10]), set(learned[1:41:10])
    for i in range(3000):
        w = [r.choice(vocab) for _ in range(30)]
        if i in bad or i in unlabelled:
            w[10:12] = ["zzslur", "qqmate"]
        if i not in unlabelled:
            labels.append((i, 1, int(i in bad)))
        rows.append((i, " ".join(w)))
    rows.append((5000, "QQMATE ! and nothing else"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, known).collect()}
    assert all(got[i]["predicted"] == 1 for i in bad | unlabelled) and got[5000]["score"] > 0.5
    assert sum(x["predicted"] for x in got.values()) == len(bad | unlabelled)


def test_pairs_of_few_documents_have_edges_and_polarity(spark):
    """Without a floor given, every pair with a PMI over zero is an edge, also of one or two documents, and reaches the lexicon."""
    rows, labels = corpus()
    rows = [*rows, (800, "so vile qqonce one"), (801, "some nasty qqtwice rotten things"), (802, "other qqtwice words")]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").repartition(3)
    words = [re.findall(r"[a-z]+", t.lower()) for _, t in rows]
    single = Counter(w for x in words for w in set(x))
    key = dict(zip(single, keys_of(list(single)).tolist()))
    names = sorted(["vile", "nasty", "rotten", *[w for w, _ in single.most_common(14)][-4:]], key=key.get)
    marked = np.array([s in ("vile", "nasty", "rotten") for s in names])
    near, some = Counter(), Counter()
    for x in words:
        pairs = {(x[i + k], x[i]) for i in range(len(x)) for k in range(-5, 6) if k and 0 <= i + k < len(x) and x[i] in names and x[i + k] != x[i]}
        near.update(pairs)
        some.update({w for w, s in pairs if marked[names.index(s)]})
    n = len(rows) + 1
    want = {(key[w], names.index(s)): (c, single[w], some[w]) for (w, s), c in near.items() if c * n > single[w] * single[s]}
    got = toxicity.seed_graph(df, np.array([key[s] for s in names], np.uint64), marked=marked).collect()
    assert {(r["word"] % 2**64, r["seed"]) for r in got} == want.keys() and min(c for c, _, _ in want.values()) == 1
    assert {(r["word"] % 2**64, r["seed"]): (r["n"], r["df"], r["near"]) for r in got} == want

    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = {r["word"] % 2**64: r["polarity"] for r in toxicity.induce(df, known)[0].collect()}
    # In one of one and in one of two documents near toxic seeds, however many of these.
    assert 0.3 < lexicon[key["qqonce"]] <= 1 / 2 and 0.2 < lexicon[key["qqtwice"]] <= 1 / 3


def test_lexicon_in_pieces_scores_alike(spark, monkeypatch):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows[:200], (700, "vile " * 100_000)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {r["doc_id"]: r["score"] for r in toxicity.score(docs, known).collect()}
    monkeypatch.setattr(toxicity, "_PIECE", 3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, known).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
