import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tesserae.llm import quality
from tesserae.llm import textops as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcé漢#!") for _ in range(rnd.randint(1, 6)))
    out = [None, "", " \n\t", "a", "\n\na\n", "x y z v w " * 4, "same line\nsame line\nsame line", "tail\n", "\x0b\x0c\r a\r\n a\r\n", "\x00\x01\x02\x03 b"]
    for _ in range(150):
        lines = [" ".join(word() for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 12))]
        out.append("\n".join(rnd.choice(lines) for _ in range(len(lines))))
    return out


def test_base_metrics_equal_brute_force():
    rows = texts()
    data, off = T.column(pa.array(rows))
    got = quality.base_metrics(data, off)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, t in enumerate(rows):
        assert tuple(int(got[n][i]) for n in names) == brute_base(t), repr(t)


def brute_discounts(values):
    n = [sum(1 for v in values if v == i) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    return [0.0] + [min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d, 1)]


def brute_scores(rows):
    """(nll, unigram_nll) of each text under modified Kneser-Ney of all other texts, in plain Python."""
    words = [WORD.findall(t or "") for t in rows]
    grams = [Counter(zip([None, *w], w)) for w in words]
    whole = sum(grams, Counter())
    lefts = Counter(b for _, b in whole)
    d2, d1 = brute_discounts(whole.values()), brute_discounts(lefts.values())
    free = sum(d1[min(v, 3)] for v in lefts.values()) / max(1, sum(lefts.values()))
    out = []
    for w, own in zip(words, grams):
        if not w:
            out.append(None)
            continue
        rest = Counter({g: c - own[g] for g, c in whole.items() if c > own[g]})
        left, context, mass = Counter(b for _, b in rest), Counter(), defaultdict(float)
        for (a, _), c in rest.items():
            context[a] += c
            mass[a] += d2[min(c, 3)]
        total = max(1, sum(left.values()))
        nll = low = 0.0
        for a, b in zip([None, *w], w):
            p1 = (left[b] - d1[min(left[b], 3)]) / total + free / (len(lefts) + 1)
            p2 = (rest[a, b] - d2[min(rest[a, b], 3)] + mass[a] * p1) / context[a] if context[a] else p1
            nll, low = nll - math.log(p2), low - math.log(p1)
        out.append((nll / len(w), low / len(w)))
    return out


def judged(df):
    return {r["doc_id"]: r for r in quality.judge(df).collect()}


def test_scores_and_verdicts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "_PART", 300)
    monkeypatch.setattr(quality, "_CHUNK", 2000)
    rows = [*texts(), "a b c d a b c d", "a b c d a b c d", "b a d c", "only once here"]
    docs = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(rows)]
    want = brute_scores(rows)
    got = judged(spark.createDataFrame([(*d, True, 0.5) for d in docs], "doc_id long, text string, lang string, kept boolean, nll double").repartition(3))
    assert len(got) == len(docs)
    for i, w in enumerate(want):
        if w is None:
            assert got[i]["nll"] is None and not got[i]["kept"] and got[i]["base_failed"]
            continue
        assert abs(got[i]["nll"] - w[0]) < 1e-9 * max(1, w[0]) and abs(got[i]["unigram_nll"] - w[1]) < 1e-9 * max(1, w[1])
    for band in ("en", "fr", None):
        mine = [i for i, w in enumerate(want) if w and docs[i][2] == band]
        limits = []
        for k in (0, 1):
            x = np.round([want[i][k] for i in mine], 3)
            limits.append((np.median(x), max(0.01, 1.4826 * np.median(np.round(np.abs(x - np.median(x)), 3)))))
        for i in mine:
            n, repeat = len(WORD.findall(rows[i])), brute_base(rows[i])[4]
            wide = 4.5 * math.sqrt(1 + 50 / n)
            failed = n < 10 or 100 * repeat > 20 * n
            assert got[i]["base_failed"] == failed
            inside = want[i][0] <= limits[0][0] + limits[0][1] * wide and abs(want[i][1] - limits[1][0]) <= limits[1][1] * wide
            assert got[i]["kept"] == (not failed and inside)


def test_result_is_the_same_for_any_chunks_and_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    want = judged(df)
    monkeypatch.setattr(quality, "_PART", 50)
    monkeypatch.setattr(quality, "_CHUNK", 300)
    got = judged(df.repartition(5))
    for i, r in want.items():
        assert got[i]["kept"] == r["kept"] and (r["nll"] is None or abs(got[i]["nll"] - r["nll"]) < 1e-9)


def test_copies_dont_fall_below_the_band(spark):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    text = lambda: " ".join(rnd.choice(vocab) for _ in range(120))
    copied = text()
    rows = [(i, text(), "en") for i in range(200)] + [(500 + i, copied + f" x{i}", "en") for i in range(60)]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(r["kept"] for r in got.values())


def test_words_that_repeat_the_commonest_alone_fall_below_the_band(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(x for _ in range(60) for x in (rnd.choice(vocab), rnd.choice(["of", "the", "and"]))), "en") for i in range(200)]
    rows.append((900, " ".join(rnd.choice(["of", "the", "and"]) for _ in range(14)), "en"))
    got = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got[900]["unigram_nll"] < got[900]["unigram_low"] and not got[900]["kept"]


def test_junk_is_rejected_and_clean_text_kept(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice(["the", "an", "er", "ing", "st", "ou", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    clean = [(i, " ".join(rnd.choice(vocab) for _ in range(120))) for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rnd.choice("0qzxj@^~") for _ in range(9)) for _ in range(120))) for i in range(9)]
    df = spark.createDataFrame([(i, t, "en") for i, t in clean + junk], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept >= {i for i, _ in clean} and not kept & {i for i, _ in junk}
    assert quality.keep_good(df).columns == df.columns


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge(empty).count() == 0
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en")] * 3 + [(None, None, None)]
    assert quality.judge(spark.createDataFrame(rows, empty.schema)).count() == 4


def test_shuffled_words_are_rejected(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice(["the", "an", "er", "ing", "st", "ou", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    after = {w: rnd.sample(vocab, 4) for w in vocab}

    def prose():
        out = [rnd.choice(vocab)]
        while len(out) < 150:
            out.append(rnd.choice(after[out[-1]]))
        return out

    clean = [(i, " ".join(prose()), "en") for i in range(300)]
    salad = []
    for i in range(9):
        w = prose()
        rnd.shuffle(w)
        salad.append((1000 + i, " ".join(w), "en"))
    df = spark.createDataFrame(clean + salad, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[i]["kept"] != got[i]["base_failed"] for i, _, _ in clean)
    for i, _, _ in salad:
        assert not got[i]["base_failed"]
        assert not got[i]["kept"] and got[i]["unigram_low"] <= got[i]["unigram_nll"] <= got[i]["unigram_high"]


def test_clashing_columns_and_long_texts(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(40)), "en", i, i, i) for i in range(30)]
    rows.append((99, "lorem ipsum dolor " * 150_000, "en", 0, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _id int, _key int, _text_key int")
    got = quality.keep_good(df)
    assert got.columns == df.columns and 99 not in {r["doc_id"] for r in got.collect()} and got.count() > 20


def test_every_language_has_its_band(spark):
    rows = [(i, f"common words number {i % 7} and more of them are here now", "en") for i in range(50)]
    rows += [(100, "zażółć gęślą jaźń kot pies i trzeba dziesięć słów tu jest", "pl")]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got[100]["kept"] and got[100]["band_high"] != got[0]["band_high"]
