import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import imatch, sharding, terms
from tesserae.llm import textops as T


def corpus(n=120):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefgé") for _ in range(5)) for _ in range(900)]
    rows = [(i * 3, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 20, 150])))) for i in range(n)]
    return rows + [(1, None), (2, ""), (4, "ééé"), (5, rows[7][1]), (5, rows[7][1])]


def test_terms_are_counted_exactly(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter(w for _, t in rows for w in set((t or "").split()))
    for held in (1 << 22, 10):
        monkeypatch.setattr(terms, "_HELD", held)
        assert sorted(r["df"] for r in terms.document_frequencies(df).collect()) == sorted(want.values())
    least, most = 0.02 * len(rows), 0.05 * len(rows)
    got = imatch.lexicon(df, least_share=0.02, most_share=0.05)
    data, off = T.column(pa.array([w for w, c in want.items() if max(2, least) <= c <= most]))
    assert set(got.tolist()) == set((terms.word_hashes(data, off)[0] & ~np.uint64(terms.ROWS - 1)).tolist()) and len(got)


def brute_mix(x):
    m = (1 << 64) - 1
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & m
    return x ^ (x >> 32)


def brute_signature(keys):
    """The signature of a set of term keys, one key and one subset at a time."""
    m = (1 << 64) - 1
    keys = [brute_mix(k | 1) for k in sorted(keys)]

    def digest(some, salt):
        return brute_mix((sum(brute_mix((k + salt * 0x9E3779B97F4A7C15) & m) for k in some) + len(some)) & m) if some else 0

    parts = []
    for level in range(12):
        for j in range(8):
            some = [k for k in keys if not any(brute_mix(k ^ ((j + 1) * 0xC2B2AE3D27D4EB4F & m)) >> q & 1 for q in range(level + 1))]
            h = digest(some, 2 + level * 8 + j)
            parts.append(h % 65535 + 1 if h else 0)
    return digest(keys, 1), parts


def brute_likeness(a, b):
    if a == b and a[0]:
        return 1.0
    n, k = [0] * 12, [0] * 12
    for i, (x, y) in enumerate(zip(a[1], b[1])):
        n[i // 8] += x != 0 or y != 0
        k[i // 8] += x == y != 0
    full = [y / x for x, y in zip(n, k) if 2 * x >= 8]
    return max(full) if full else sum(k) / max(1, sum(n))


def test_edited_neighbours_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, fingerprint string").repartition(7)
    keys = imatch.lexicon(df)
    got = imatch.edited_neighbours(df, keys=keys).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(df, keys=keys).collect()}
    known = set(keys.tolist())

    def signature(t):
        data, off = T.column(pa.array([t]))
        return brute_signature({k for k in (terms.word_hashes(data, off)[0] & ~np.uint64(terms.ROWS - 1)).tolist() if k in known})

    text = lambda s: f"{s[0]:016x}" + "".join(f"{x:04x}" for x in s[1])
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        a, b, c = map(signature, (t, e, u))
        assert prints[i] == text(a)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), round(1.0 if e == t else brute_likeness(a, b), 9), round(1.0 if u == t else brute_likeness(a, c), 9)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    assert Counter(tuple(r[n] for n in names) + (round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == Counter(want)
    assert sum(w[5] for w in want) > 3 * sum(w[6] for w in want)


def test_long_texts(spark):
    rows = [(1, "alpha beta gamma delta " * 60_000), (2, "alpha beta"), (3, "x" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.edited_neighbours(df).collect()}
    assert [got[i]["n_chars"] for i in (1, 2, 3)] == [len(t) for _, t in rows]
    assert {r["size"] for r in sharding.shard_documents(df).collect()} == {len(t) + 1 for _, t in rows}


@pytest.mark.parametrize("rows", [[], [(1, "only one document here")], [(None, "a b"), (None, "a b"), (3, None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert imatch.edited_neighbours(df).count() == len(rows)
    assert sharding.shard_documents(df).count() == len(rows)


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, where, load = defaultdict(list), defaultdict(set), [0] * shards
    text_of = {i: t or "" for i, t in rows}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[text_of[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(x) == 1 for x in where.values())
    return load


def test_shards_balance_and_keep_groups(spark):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.randint(1, 400) + str(rnd.randint(0, 10**6))) for i in range(3000)]
    df = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, shard int").repartition(6)
    load = check_shards(rows, sharding.shard_documents(df).collect(), 16)
    assert max(load) - min(load) <= 10


def test_a_hot_group_leaves_the_rest_even(spark):
    rnd = random.Random(8)
    rows = [(i, "y" * rnd.randint(1, 90) + str(i)) for i in range(2000)] + [(5000 + i, "hot " * 20) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    load = sorted(check_shards(rows, sharding.shard_documents(df).collect(), 16))
    assert load[-1] == 1000 * 81 and load[-2] - load[0] <= 30


def test_differencing_keeps_sums():
    rnd = random.Random(3)
    nodes = [tuple(rnd.randint(0, 50) for _ in range(5)) for _ in range(40)]
    places, sums = sharding.difference(nodes, 5)
    load = [0] * 5
    for n, p in zip(nodes, places):
        assert sorted(p) == list(range(5))
        for k, s in enumerate(p):
            load[s] += n[k]
    assert sorted(load) == sorted(sums) and max(load) - min(load) <= 12
    places, sums = sharding.difference([(8, 0), (7, 0), (6, 0), (5, 0), (4, 0)], 2)
    assert sorted(sums) == [14, 16]


def brute_differencing(sizes, shards):
    """Loads by Karmarkar-Karp on a plain list: merge the two partitions of largest spread, largest with smallest."""
    parts = [sorted([n] + [0] * (shards - 1)) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]


def test_one_task_equals_plain_differencing(spark):
    rnd = random.Random(4)
    sizes = [rnd.randint(10**6, 2 * 10**6) * 2 + 1 for _ in range(3000)]
    rows = [(bytearray(str(i).encode()), n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "key binary, bytes long").coalesce(1)
    where = {bytes(r["key"]): r["shard"] for r in sharding.shard_groups(df, 5).collect()}
    load = [0] * 5
    for k, n in rows:
        load[where[bytes(k)]] += n
    assert sorted(load) == brute_differencing(sizes, 5)


def test_ties_and_small_tables_of_groups(spark):
    df = spark.createDataFrame([(bytearray(str(i).encode()), 7) for i in range(40)], "key binary, bytes long")
    load = Counter(r["shard"] for r in sharding.shard_groups(df, 8).collect())
    assert set(load.values()) == {5} and len(load) == 8
