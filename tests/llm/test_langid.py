import random
import zlib

import numpy as np
import pyarrow as pa

from tesserae.llm import langid
from tesserae.llm import textops as T

SYLLABLES = {"aa": ["ta", "ro", "mi", "ka"], "bb": ["sch", "ung", "öf", "ßen"], "cc": ["éau", "oux", "ièr", "ent"]}


def make(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = make(300) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "aa"), (1004, "\u2764\ufe0f 123", "aa"), (1005, "\u0301 \u0301", "bb"), (1003, "TAROMI", None), (1003, "TAROMI", None), (None, "öfschung " * 3, None)]
    df = spark.createDataFrame([(*r, 0.0, "z") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(a == b for a, b in held)
    for i in (1000, 1001, 1002, 1004, 1005):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[1003]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learns_nothing_from_held_out_or_unlabelled_rows(spark):
    rows = [(i, "onlyheldout" if zlib.crc32(str(i).encode()) % 3 == 1 else "seen", "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "yy") for i in range(60)] + [(100, "nolabel", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["languages"] == ["yy"]


def test_backs_off_to_shorter_grams(spark):
    rows = [(i, t, x) for i, t, x in make(200, 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text, lang in (("taromixyz", "aa"), ("xxungxx", "bb"), ("ß", "bb")):
        data, off = T.column(pa.array([text]))
        w = langid._Letters(data, off)
        s = langid.word_scores(model, w.cp, w.starts, w.ends, w.hash)
        assert model["languages"][int(np.argmax(s[0]))] == lang


def test_empty_table_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    df = spark.createDataFrame([*make(90, 5), (500, "77", "aa"), (501, None, None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(90))


def test_clashing_columns_and_long_texts(spark):
    rows = [(i, t, x, 1, 2, 3) for i, t, x in make(60, 6)] + [(900, "taromi " * 200_000, "aa", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _id int, _key int, _text_key int")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {*range(60), 900}


def brute_prediction(rows, text):
    """Word-first backoff in plain Python: the best language by summed log frequencies."""
    import math
    import re
    from collections import Counter

    words = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t or "")]
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    languages = sorted({x for _, x in learned})
    count = {n: {x: Counter() for x in languages} for n in range(6)}
    for t, x in learned:
        for w in words(t):
            count[0][x][w] += 1
            s = f"\x01{w}\x01"
            for n in range(1, 6):
                count[n][x].update(s[i : i + n] for i in range(len(s) - n + 1))
    known = {n: set().union(*count[n].values()) for n in count}

    def log(n, g, x):
        return math.log((count[n][x][g] + 0.05) / (sum(count[n][x].values()) + 0.05 * (len(known[n]) + 1)))

    total = dict.fromkeys(languages, 0.0)
    for w in words(text):
        if w in known[0]:
            grams, n = [w], 0
        else:
            s = f"\x01{w}\x01"
            for n in range(5, 0, -1):
                grams = [g for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g in known[n]]
                if grams:
                    break
        for x in languages:
            total[x] += sum(log(n, g, x) for g in grams) / max(1, len(grams))
    best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x]))
    many = len(words(text))
    return best, 1 / sum(math.exp((total[x] - total[best]) * min(many, 50) / many) for x in languages)


def test_predictions_equal_brute_force(spark):
    rows = make(40, 8)
    extra = [(500, "taro unseenword schung"), (501, "éau ßen ro"), (502, "xyz"), (503, "ta ta ta sch sch sch")]
    df = spark.createDataFrame([*rows, *[(i, t, None) for i, t in extra]], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    for i, t in [*[(i, t) for i, t, _ in rows], *extra]:
        lang, score = brute_prediction(rows, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4


def test_ties_go_to_the_first_by_name(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:8]
    df = spark.createDataFrame([(i, "same words here", "zz" if k % 2 else "bb") for k, i in enumerate(ids)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df)).collect()} == {"bb"}
