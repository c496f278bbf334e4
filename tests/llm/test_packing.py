import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing


def documents():
    rnd = random.Random(1)
    texts = [None, "", " ", "a\x00b", "<|endoftext|> plain", "漢字かな 한글 العربية 🎉", "don't I'll  x\n\n y\t z", "é" * 3000, "word " * 4000, "q" * 1023]
    texts += [" ".join("".join(rnd.choice("aeioutrsn") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.choice([3, 60, 400, 1500]))) for _ in range(120)]
    return list(enumerate(texts)) + [(5, "again"), (5, "again"), (None, "no id")]


def test_places_ids_and_cuts(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = documents()
    docs = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, piece int").repartition(5)
    got = packing.pack_documents(docs, with_ids=True).collect()
    want = defaultdict(int)
    total = 0
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024)] if len(ids) > 1024 else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    have = defaultdict(int)
    spans = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert have == want
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(spans) <= -(-total // 1024) * 1.02 + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_valid_and_tight(seed):
    rnd = np.random.default_rng(seed)
    sizes = rnd.integers(1, 1025 if seed % 2 else 200, 3000)
    where, fill = packing.best_fit(sizes, 1024)
    assert (np.bincount(where, weights=sizes) == fill).all() and fill.max() <= 1024
    bound = max(-(-sizes.sum() // 1024), (sizes > 512).sum())
    assert len(fill) <= 1.03 * bound + 1


def test_best_fit_takes_the_fullest_bin():
    where, _ = packing.best_fit(np.array([6, 5, 4, 3]), 10)
    assert where.tolist() == [0, 1, 0, 1]
    where, _ = packing.best_fit(np.array([7, 8, 2, 1]), 10)
    assert where.tolist() == [1, 0, 0, 1]
