import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tesserae.llm import packing, pieces, token_counts


def texts():
    r = random.Random(1)
    out = ["", None, " ", "  a   b", "a\n\n\tb  ", "漢字 é\x00x", "don’t 🎉🎉 stop", "x" * 700, " " * 20 + "q", "the of"]
    return out + ["".join(r.choice("abcthe éß漢.,\n 1") for _ in range(r.randint(0, 60))) for _ in range(200)]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_path())


def test_merges_equal_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rows = texts()
    ids, off = pieces.encode(model, pa.array(rows), "bpe")
    for i, t in enumerate(rows):
        assert ids[off[i] : off[i + 1]].tolist() == sp.encode(t or "")


def brute_best(text, scores, unknown):
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = [0.0] + [None] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 16), j):
            x = scores.get(s[i:j], unknown if j == i + 1 else None)
            if x is not None and (best[j] is None or best[i] + x > best[j]):
                best[j] = best[i] + x
    return best[-1]


def test_viterbi_is_optimal(model):
    proto = pb.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        proto.ParseFromString(f.read())
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    rows = [t for t in texts() if t and all(c == " " or c in scores for c in t) and "  " not in t and not t.startswith(" ")]
    assert len(rows) > 3
    ids, off = pieces.encode(model, pa.array(rows))
    for i, t in enumerate(rows):
        mine = ids[off[i] : off[i + 1]].tolist()
        assert "".join(proto.pieces[k].piece for k in mine) == "▁" + t.replace(" ", "▁")
        assert abs(sum(proto.pieces[k].score for k in mine) - brute_best(t, scores, min(scores.values()) - 10)) < 1


def test_round_trip(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "no id", 1), (3, "again", 1), (3, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ids int").repartition(3)
    for rule in ("viterbi", "bpe", "model"):
        enc = pieces.encode_documents(df, rule=rule)
        assert enc.where("round_trip").count() == len(rows)
        for r in enc.collect():
            assert r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got = Counter((r["doc_id"], r["text"]) for r in pieces.decode_documents(enc).collect())
        assert got == Counter((i, t or "") for i, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_documents(empty).count() == 0


def brute_counts(text, encode, size, rule, bounds=None):
    raw = (text or "").encode()
    bounds = bounds or [0] + [i + 1 for i, c in enumerate(raw) if c == 10 and i + 1 < len(raw)] + [len(raw)]
    out, at = [0.0] * (len(bounds) - 1), 0
    for i in encode([text or ""])[0].tolist():
        parts = [max(0, min(bounds[s + 1], at + size[i]) - max(bounds[s], at)) for s in range(len(out))]
        if rule == "share":
            for s, p in enumerate(parts):
                out[s] += p / size[i]
        elif rule == "start":
            out[next(s for s, p in enumerate(parts) if p)] += 1
        else:
            out[parts.index(max(parts))] += 1
        at += size[i]
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_equal_brute_force(spark, rule):
    rows = list(enumerate(texts())) + [(4, "x\ny"), (4, "x\ny"), (300, "a\n\n\n\n   b\n c\n"), (301, "\n"), (302, "\n\n\n")]
    df = spark.createDataFrame([(a, b, "f") for a, b in rows], "doc_id long, text string, field string")
    got = token_counts.count_sections(df, rule=rule).collect()
    encode = packing.encoder(*packing.default_paths())
    size = token_counts.token_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        for s, n in enumerate(brute_counts(t, encode, size, rule)):
            want[i, s, round(n, 6)] += 1
    assert Counter((r["doc_id"], r["section"], round(r["n_tokens"], 6)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], [0.0, 0, 0])
        by[r["doc_id"]][0] += r["n_tokens"]
        by[r["doc_id"]][1] += r["doc_tokens"] * (r["section"] == 0)
        assert r["field"] == ("title" if r["section"] == 0 else "body") and r["start_char"] <= r["end_char"]
    assert all(abs(a - b) < 1e-6 for a, b, _ in by.values())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields_equal_brute_force(spark, rule):
    rows = [(1, "A title", "Some body text,\nof two lines", "é"), (2, None, "", None), (3, "", "only this", ""), (3, "", "only this", ""), (4, "x" * 900, "  ", "end")]
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, title string, body string, note string, sizes int, field string")
    encode = packing.encoder(*packing.default_paths())
    size = token_counts.token_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, *parts in rows:
        parts = [p or "" for p in parts]
        parts = [p + "--" for p in parts[:-1]] + parts[-1:]
        bounds = [len("".join(parts[:k]).encode()) for k in range(4)]
        for name, n in zip(("title", "body", "note"), brute_counts("".join(parts), encode, size, rule, bounds)):
            want[i, name, round(n, 6)] += 1
    got = token_counts.count_fields(df, ["title", "body", "note"], separator="--", rule=rule).collect()
    assert Counter((r["doc_id"], r["field"], round(r["n_tokens"], 6)) for r in got) == want


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        token_counts.count_sections(spark.createDataFrame([], "doc_id long, text string"), rule="other")
