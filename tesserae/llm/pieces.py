"""SentencePiece encoding and decoding, batched in numpy.

A text is cut into units that no piece of the vocabulary crosses; the distinct
units of a batch are encoded once.  Units of equal length advance together: at
each place, hashes of the substrings that end there probe the sorted piece
keys of all units at once, and the best start is kept as a back-pointer
(Viterbi, the unigram rule).  The merge rule of byte-pair models runs on the
same layout.  Characters without a piece become byte pieces or the unknown id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

_M = np.uint64(0x9FB21C651E98DF25)
META = 0x2581
_MODELS: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary: sorted hashes of its pieces with ids and scores, and each id's bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if len(n.precompiled_charsmap) or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        self.dummy = bool(n.add_dummy_prefix)
        self.kind = {1: "viterbi", 2: "bpe"}.get(proto.trainer_spec.model_type, "viterbi")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes_at = np.full(256, self.unknown, np.int32)
        body = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes_at[int(p.piece[3:5], 16)] = i
                body.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (1, 4):
                body.append(p.piece.replace("▁", " ").encode())
            else:
                body.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
        self.fallback = bool(proto.trainer_spec.byte_fallback)
        self.text = np.frombuffer(b"".join(body), np.uint8)
        self.text_off = np.append(0, np.cumsum([len(b) for b in body])).astype(np.int64)
        self.longest = max(len(p) for _, p, _ in normal)
        keys = np.array([self._key(p) for _, p, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([i for i, _, _ in normal], np.int32)[order]
        self.scores = np.array([s for _, _, s in normal], np.float32)[order]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.longer = np.zeros(1 << 22, bool)
        self.longer[(np.array([self._key(x) for x in {p[:k] for _, p, _ in normal for k in range(1, len(p))}], np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        self.unknown_score = np.float32(min(float(s) for _, _, s in normal) - 10)
        pairs = {(a, b) for _, p, _ in normal for a, b in zip(map(ord, p), map(ord, p[1:]))}
        self.pairs = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)

    @staticmethod
    def _key(piece: str) -> int:
        cp = np.array([[ord(c) for c in piece]], np.uint32)
        return int(T.mix(_prefix(cp)[0, -1:] + np.uint64(len(piece)))[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted keys and whether they are there; a table of the keys' upper bits spares most searches."""
        found = self.table[(h >> np.uint64(44)).astype(np.int64)]
        at = np.zeros(len(h), np.int64)
        some = np.flatnonzero(found)
        at[some], found[some] = T.lookup(self.keys, h[some])
        return at, found


def load(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _prefix(cp: np.ndarray) -> np.ndarray:
    """Horner prefix hashes (units x length + 1) of code points."""
    out = np.zeros((cp.shape[0], cp.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(cp.shape[1]):
            out[:, k + 1] = out[:, k] * _M + cp[:, k].astype(np.uint64) + np.uint64(1)
    return out


def _span(prefix: np.ndarray, rows, a, b, powers: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [a, b) of the given rows."""
    with np.errstate(over="ignore"):
        return T.mix(prefix[rows, b] - prefix[rows, a] * powers[b - a] + np.asarray(b - a).astype(np.uint64))


def _power(n: int) -> np.ndarray:
    out = np.full(n + 1, _M, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


def viterbi(model: Pieces, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of units of equal length: starts flagged (units x length) and the piece index that begins there (-1: no piece).

    Of equal sums the segmentation whose last piece is longest is taken.
    """
    n, size = cp.shape
    prefix, powers = _prefix(cp), _power(size)
    every = np.arange(n)
    best = np.full((n, size + 1), -np.inf, np.float32)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int32)
    piece = np.full((n, size + 1), -1, np.int32)
    for i in range(size):
        live = every
        for j in range(i + 1, min(size, i + model.longest) + 1):
            h = _span(prefix, live, i, j, powers)
            at, found = model.find(h)
            if j == i + 1:
                value = best[:, i] + np.where(found, model.scores[at], model.unknown_score)
                at, hit = np.where(found, at, -1), every
            else:
                hit, at = live[found], at[found]
                value = best[hit, i] + model.scores[at]
            up = value > best[hit, j]
            rows = hit[up]
            best[rows, j], back[rows, j], piece[rows, j] = value[up], i, at[up]
            # Only units whose text so far begins some longer piece go on.
            live = live[model.longer[(h >> np.uint64(42)).astype(np.int64)]]
            if not len(live):
                break
    start = np.zeros((n, size), bool)
    chosen = np.full((n, size), -1, np.int32)
    at = np.full(n, size)
    live = every
    while len(live):
        i = back[live, at[live]]
        start[live, i] = True
        chosen[live, i] = piece[live, at[live]]
        at[live] = i
        live = live[i > 0]
    return start, chosen


def merges(model: Pieces, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair segmentations of units of equal length, as viterbi() gives them: the best-scored adjacent pair is merged, the leftmost of equals, until no pair is a piece."""
    n, size = cp.shape
    prefix, powers = _prefix(cp), _power(size)
    every = np.arange(n)
    follow = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size - 1), (n, 1))
    start = np.ones((n, size), bool)
    gain = np.full((n, size), -np.inf, np.float32)

    def look(rows: np.ndarray, i: np.ndarray) -> None:
        ok = i >= 0
        rows, i = rows[ok], i[ok]
        j = follow[rows, i]
        inside = j < size
        gain[rows[~inside], i[~inside]] = -np.inf
        rows, i, j = rows[inside], i[inside], j[inside]
        end = follow[rows, j]
        at, found = model.find(_span(prefix, rows, i, end, powers))
        gain[rows, i] = np.where(found & (end - i <= model.longest), model.scores[at], -np.inf)

    for k in range(size - 1):
        look(every, np.full(n, k))
    live = every
    while len(live):
        i = np.argmax(gain[live], axis=1)
        go = gain[live, i] > -np.inf
        live, i = live[go], i[go]
        if not len(live):
            break
        j = follow[live, i]
        end = follow[live, j]
        start[live, j] = False
        gain[live, j] = -np.inf
        follow[live, i] = end
        inside = end < size
        before[live[inside], end[inside]] = i[inside]
        look(live, i)
        look(live, before[live, i])
    chosen = np.full((n, size), -1, np.int32)
    rows, i = np.nonzero(start)
    at, found = model.find(_span(prefix, rows, i, follow[rows, i], powers))
    chosen[rows, i] = np.where(found, at, -1)
    return start, chosen


def encode_units(model: Pieces, units: np.ndarray, off: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units (code points with offsets), one after the other, and their offsets."""
    n = len(off) - 1
    # Boundaries that no piece crosses split a unit further.
    key = units[:-1].astype(np.int64) << 21 | units[1:].astype(np.int64) if len(units) > 1 else np.zeros(0, np.int64)
    cut = np.append(True, ~T.lookup(model.pairs, key)[1]) if len(units) else np.zeros(0, bool)
    cut[off[:-1][off[:-1] < len(units)]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(units)))
    out_id = np.zeros(len(units), np.int32)
    flag = np.zeros(len(units), bool)
    rare = np.zeros(len(units), bool)
    for length in np.unique(size).tolist():
        mine = begin[size == length]
        step = max(1, (1 << 20) // length)
        for at in range(0, len(mine), step):
            where = mine[at : at + step, None] + np.arange(length)
            start, chosen = (merges if rule == "bpe" else viterbi)(model, units[where])
            flag[where] = start
            out_id[where] = np.where(chosen >= 0, model.ids[chosen], model.unknown)
            rare[where] = start & (chosen < 0)
    if rare.any() and model.fallback:
        cps = units[rare]
        raw = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    else:
        raw, width = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    count = flag.astype(np.int64)
    if len(width):
        count[rare] = width
    place = np.append(0, np.cumsum(count))
    ids = np.zeros(int(place[-1]), np.int32)
    whole = flag & ~rare if len(width) else flag
    ids[place[:-1][whole]] = out_id[whole]
    if len(width):
        spot = np.repeat(place[:-1][rare], width) + np.arange(len(raw)) - np.repeat(np.cumsum(width) - width, width)
        ids[spot] = model.bytes_at[raw]
    return ids, place[off]


def _buffer(model: Pieces, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a space before each row that isn't empty (the dummy prefix), and offsets."""
    if not model.dummy:
        return data, off
    some = np.diff(off) > 0
    new = off + np.append(0, np.cumsum(some))
    out = np.full(int(new[-1]), 0x20, np.uint8)
    index = np.arange(len(data)) + np.repeat(np.cumsum(some), np.diff(off))
    out[index] = data
    return out, new


def encode(model: Pieces, texts: pa.Array, rule: str = "viterbi") -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other (int32), and each text's offset; null and empty texts have none."""
    data, off = T.column(texts)
    ids, sizes = [], []
    for _, _, d, o in T.slices(data, off, 1 << 22):
        d, o = _buffer(model, d, o)
        if not len(d):
            sizes.append(np.diff(o))
            continue
        space = d == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[o[:-1][o[:-1] < len(d)]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(d))
        h = T.hash_slices(T.running(d), begin, end)
        _, one, inv = np.unique(h, return_index=True, return_inverse=True)
        body, b_off = T.gather(d, begin[one], end[one])
        lead = np.append(0, np.cumsum((body & 0xC0) != 0x80))
        cp = T.code_points(body).copy()
        cp[cp == 0x20] = META
        u_ids, u_off = encode_units(model, cp, lead[b_off], rule)
        flat, f_off = T.gather(u_ids, u_off[inv], u_off[inv + 1])
        ids.append(flat)
        sizes.append(np.diff(f_off[np.searchsorted(begin, o)]))
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int64)


def decode(model: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id sequences and their offsets; a dummy prefix is taken off."""
    body, b_off = T.gather(model.text, model.text_off[ids], model.text_off[ids + 1])
    ends = b_off[off]
    if not model.dummy:
        return body, ends
    keep = np.ones(len(body), bool)
    first = ends[:-1][np.diff(ends) > 0]
    keep[first[body[first] == 0x20]] = False
    place = np.append(0, np.cumsum(keep))
    return body[keep], place[ends]


def default_path() -> str:
    """Place of the public piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rule: str = "viterbi", with_ids: bool = True) -> DataFrame:
    """Every row's doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text) and, if asked for, ids.

    rule "viterbi" takes the segmentation of the greatest summed piece scores,
    "bpe" merges by rank, "model" what the file is made for.  A null text has no
    ids and counts as empty.  U+2581 in a text stands for a space, so such a
    text doesn't come back.  Repeated rows repeat; an empty table gives none.
    """
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        way = model.kind if rule == "model" else rule
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ids, off = encode(model, b.column("text"), way)
                data, t_off = T.column(b.column("text"))
                back, b_off = decode(model, ids, off)
                same = np.array([bool(len(x) == len(y)) and bool((x == y).all()) for x, y in ((data[t_off[i] : t_off[i + 1]], back[b_off[i] : b_off[i + 1]]) for i in range(b.num_rows))], bool)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * off[i] : 4 * off[i + 1]]) for i in range(b.num_rows)]
                cols = [b.column("doc_id"), pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array(same)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_ids", "ids_crc32", "round_trip", *["ids"] * with_ids])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of id lists; a null or empty list gives an empty text, bytes that aren't UTF-8 the replacement character."""
    path = path or default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            lists = b.column("ids").fill_null([]) if b.column("ids").null_count == 0 else pa.array([x or [] for x in b.column("ids").to_pylist()], pa.list_(pa.int32()))
            off = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
            body, ends = decode(model, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), off)
            raw = body.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
