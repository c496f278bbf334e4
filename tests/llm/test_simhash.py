import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(fp)) if j != i and bin(fp[i] ^ fp[j]).count("1") <= 2] for i in range(len(fp))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = min(ids) if ids else None
    return Counter((rows[i][0], f"{fp[i]:016x}", len(near[i]), out[i]) for i in range(len(rows)))


def digest(df):
    got = df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "n_near", "component_id").collect()
    return Counter(tuple(r) for r in got)


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeéüß") for _ in range(rnd.randint(1, 14)))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "x" * 5000), (None, "null id"), (6, "ONE"), (6, "ONE")]
    for i in range(10, 60):
        base = [word() for _ in range(rnd.choice([5, 40, 300, 3000]))]
        rows.append((10 * i, " ".join(base)))
        for j in range(rnd.randint(0, 5)):
            new = list(base)
            if j:
                new[rnd.randrange(len(new))] = word()
            rows.append((10 * i + 1 + j, "\n".join(new).upper() if j == 2 else " ".join(new)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fp string, n_near int")
    assert digest(simhash.near_duplicates(docs)) == brute(rows)


def test_crowded_cells_pass_to_the_finer_grid(spark):
    rnd = random.Random(3)
    points = {rnd.getrandbits(64) for _ in range(40)}
    for p in list(points)[:4]:
        for _ in range(60):
            points.add(p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for cell_rows in (2, 20, 10**6):
        got = [tuple(r) for r in simhash.links(df, cell_rows=cell_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_popcount_embedding_is_a_lower_bound(spark):
    rnd = random.Random(5)
    rows = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(200)]
    a, b = simhash.embedding(F.col("a"), 32), simhash.embedding(F.col("b"), 32)
    l1 = sum((F.abs(x - y) for x, y in zip(a, b)), F.lit(0))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(l1 > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (100, 106)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 105, 106, 200]], "fp long")
    got = dict(tuple(r) for r in simhash.components(nodes, edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 105: 100, 106: 100, 200: 200}


def test_empty_table_and_dedupe(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedupe(empty).count() == 0
    rows = corpus()
    docs = spark.createDataFrame([(a, b, f"s{i % 3}", i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, root string, n int")
    kept = simhash.dedupe(docs)
    assert kept.columns == docs.columns
    want = Counter(k[3] for k in {(r[3],): r for r in brute(rows)}.values())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_dedupe_with_clashing_columns(spark):
    rows = [(1, "a b c d", 1, 2, 3), (2, "a b c d", 1, 2, 3), (2, "a b c d", 1, 2, 3), (3, None, 1, 2, 3), (4, "", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, _text_key int")
    kept = simhash.dedupe(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    twice = simhash.dedupe(df.where("doc_id = 2"))
    assert [r["doc_id"] for r in twice.collect()] == [2]


def test_a_family_crowded_in_the_finest_grid(spark):
    rnd = random.Random(11)
    base = rnd.getrandbits(63)
    points = {base ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 3))) for _ in range(500)}
    want = {(min(a, b), max(a, b)) for a in points for b in points if a != b and bin(a ^ b).count("1") <= 2}
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = [tuple(r) for r in simhash.links(df, cell_rows=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
