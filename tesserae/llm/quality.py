"""Quality rules with an n-gram perplexity model of words.

The model is interpolated modified Kneser-Ney of order 2 over the words of all
documents, each document beginning with a start mark.  Nothing is pruned, and
no table of it is ever in one place: documents are held as chunks of numbered
words (word_chunks), chunks send sorted arrays of gram hashes to ranges of
hashes, and the task that has a range counts them and answers every chunk in
the order of its keys (count_grams, count_words).  A document is scored without
its own counts at every level (score_chunk), so a text doesn't foretell itself.

Each language has a band of its own, [median - lower * s, median + upper * s], s
being the scaled median absolute deviation, widened for short documents.  The
bigram perplexity has the upper bound; the perplexity under the model's
continuation unigrams, which copies of a text leave as it is, has both.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sparkops import bounded, bucketed, cut, keep_rows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_M = np.uint64(0x9FB21C651E98DF25)


def base_metrics(data: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row, with the words found."""
    starts, ends, first = T.words(data, off)
    run = T.running(data)
    h = T.hash_slices(run, starts, ends)
    rows = len(off) - 1
    count = np.diff(first)
    lead = (data & 0xC0) != 0x80
    word_chars = T.sums(lead & ~T.SPACE[data], off)
    n_symbols = T.sums(_SYMBOL[data], off)
    # Lines: from a row's start or after \n, to \n or the row's end.
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(off, breaks, "right") - 1
    line_start = np.concatenate([off[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(rows), row_of_break])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    if len(line_end):
        closing = np.flatnonzero(np.append(line_row[1:] != line_row[:-1], True))
        line_end[closing] = off[line_row[closing] + 1]
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    line = T.hash_slices(run, line_start, line_end)
    order = np.lexsort((line, line_row))
    a, b = line[order], line_row[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    n_dup = np.bincount(b[1:][same], minlength=rows).astype(np.int64)
    # Windows of words, told apart by row.
    n_repeat = np.zeros(rows, np.int64)
    if len(h) >= window:
        with np.errstate(over="ignore"):
            w = h[: len(h) - window + 1].copy()
            for k in range(1, window):
                w = w * _M + h[k : len(h) - window + 1 + k]
            row = T.row_of(first)[: len(w)]
            inside = np.arange(len(w)) + window <= first[row + 1]
            w = T.mix(w ^ (row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        at = np.flatnonzero(inside)
        twice = at[T.repeated(w[at])]
        if len(twice):
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + window, -1)
            n_repeat = T.sums(np.cumsum(edge[:-1]) > 0, first)
    return {"n_words": count, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "starts": starts, "ends": ends, "first": first, "hash": h}


#: Text a chunk of documents holds; a document is never split.
_CHUNK = 12 << 20
#: Tokens of a chunk scored at once.
_SCORED = 1 << 18
#: Keys that a range of hashes is made for.
_PART = 1 << 20
#: The start mark's hash, of any width.
_BEGIN = np.uint64(0x2545F4914F6CDD1D)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _planes(values: np.ndarray) -> bytes:
    """The integers' bytes, all lowest bytes first, then the next ones."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unplanes(data: bytes, n: int, kind=np.int64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Keys by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unsteps(data: bytes, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplanes(data, n, np.uint64), dtype=np.uint64)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def hash_bits(text_bytes: int) -> int:
    """Bits of a hash for so much text: at any size, an unseen gram is taken for a seen one once in 4096 times or less."""
    return min(62, max(40, int(text_bytes // 4).bit_length() + 12))


def _shift(bits: int) -> np.uint64:
    return np.uint64(64 - bits)


def word_chunks(docs: DataFrame, bits: int) -> DataFrame:
    """Chunks of `docs(doc_id, text, lang, text_key)`: the documents' ids, languages, keys and base metrics, the chunk's words (hashes of `bits` bits, commonest first) and the numbers of its tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        size, number = 0, TaskContext.get().partitionId() << 24

        def pack() -> pa.RecordBatch:
            nonlocal number
            ids, langs, keys = (pa.concat_arrays([x[i] for x in held]) for i in range(3))
            metrics, h = np.concatenate([x[3] for x in held], axis=1), np.concatenate([x[4] for x in held])
            held.clear()
            number += 1
            words, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            n = len(ids)
            off = pa.array([0, n], pa.int32())
            row = [pa.array([number]), pa.array([n]), pa.array([len(h)]), pa.array([len(words)]), pa.ListArray.from_arrays(off, ids), pa.ListArray.from_arrays(off, langs), pa.array([_planes(keys.to_numpy(zero_copy_only=False).astype(np.int64))]), pa.array([_planes(metrics.ravel())]), pa.array([_steps(words[order])]), pa.array([_planes(place[inverse])])]
            return pa.RecordBatch.from_arrays(row, ["chunk", "n_docs", "n_tokens", "n_words", "ids", "langs", "keys", "metrics", "words", "tokens"])

        for batch in batches:
            data, off = T.column(batch.column("text"))
            for i, j, d, o in T.slices(data, off, 1 << 20):
                if size and size + len(d) > _CHUNK:
                    yield pack()
                    size = 0
                b = base_metrics(d, o)
                held.append((*(batch.column(x)[i:j] for x in ("doc_id", "lang", "text_key")), np.stack([b[x].astype(np.int64) for x in METRICS]), b["hash"] >> _shift(bits)))
                size += max(1, len(d))
        if held:
            yield pack()

    schema = f"chunk long, n_docs long, n_tokens long, n_words long, ids array<{kind}>, langs array<string>, keys binary, metrics binary, words binary, tokens binary"
    return docs.select("doc_id", "text", "lang", "text_key").mapInArrow(run, schema)


class Chunk:
    """A chunk's documents, words and bigrams.

    The word after the last is the start mark.  `left` and `right` are of the
    tokens, `first` each document's first token; `keys` are the distinct bigrams'
    and `gram` is each token's.
    """

    def __init__(self, row: dict, bits: int) -> None:
        n, self.n_words = row["n_docs"], row["n_words"]
        self.metrics = _unplanes(row["metrics"], n * len(METRICS)).reshape(len(METRICS), n)
        self.words = np.append(_unsteps(row["words"], row["n_words"]), _BEGIN >> _shift(bits))
        self.right = _unplanes(row["tokens"], row["n_tokens"], np.uint32)
        self.first = np.zeros(n + 1, np.int64)
        np.cumsum(self.metrics[0], out=self.first[1:])
        self.left = np.empty_like(self.right)
        self.left[1:] = self.right[:-1]
        self.left[self.first[:-1][np.diff(self.first) > 0]] = self.n_words
        with np.errstate(over="ignore"):
            h = T.mix(self.words[self.left] * _M + self.words[self.right]) >> _shift(bits)
        by = np.argsort(h, kind="stable")
        begin = _runs(h[by])
        self.keys = h[by[begin]]
        self.counts = np.diff(np.append(begin, len(by)))
        del h
        self.gram = np.empty(len(by), np.uint32)
        self.gram[by] = np.repeat(np.arange(len(begin), dtype=np.uint32), self.counts)
        self.gram_left, self.gram_right = self.left[by[begin]], self.right[by[begin]]


def _ranges(keys: int) -> int:
    """Ranges for so many keys; above a thousand they are twice as long, as every chunk sends a message to each."""
    return max(keys // (2 * _PART), min(keys // _PART, 1024)) + 1


def _send(chunk: int, keys: np.ndarray, values: np.ndarray, parts: int, bits: int) -> pa.RecordBatch:
    """A chunk's sorted keys and their values (rows x keys), cut at the ranges' edges."""
    width = np.uint64(-(-(1 << bits) // parts))
    part = keys // width
    edge = np.append(_runs(part), len(keys))
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(spans), pa.int64()), pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([_steps(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(np.ascontiguousarray(values[:, a:b]).ravel()) for a, b in spans], pa.binary())],
        ["chunk", "part", "n", "keys", "own"],
    )


_SENT = "chunk long, part long, n long, keys binary, own binary"
_ANSWER = "chunk long, step int, part long, n long, counts binary, owner binary, n1 long, n2 long, n3 long, n4 long, total long, types long"


def _merge(step: int, rows: int, number) -> object:
    """The task of a range: sums the values of equal keys over all chunks and answers each chunk's keys, with the range's counts in one of the rows.

    number: of the sums, the count that discounts come from.  owner: a bit for
    each key, set in one chunk of those that sent it.
    """

    def merge(table: pa.Table) -> pa.Table:
        got = table.sort_by("chunk").to_pylist()
        sizes = [r["n"] for r in got]
        keys = np.concatenate([_unsteps(r["keys"], r["n"]) for r in got])
        own = np.concatenate([_unplanes(r["own"], r["n"] * rows).reshape(rows, -1) for r in got], axis=1)
        by = np.argsort(keys, kind="stable")
        begin = _runs(keys[by])
        many = np.diff(np.append(begin, len(keys)))
        sums = np.add.reduceat(own[:, by], begin, axis=1)
        owner = np.zeros(len(keys), bool)
        owner[by[begin]] = True
        every = np.empty_like(own)
        every[:, by] = np.repeat(sums, many, axis=1)
        c = number(sums)
        stats = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int(c.sum()), int((c > 0).sum())]
        edge = np.cumsum([0, *sizes])
        spans = list(zip(edge[:-1], edge[1:]))
        columns = {"chunk": [r["chunk"] for r in got], "step": pa.array([step] * len(got), pa.int32()), "part": [r["part"] for r in got], "n": sizes, "counts": pa.array([_planes(np.ascontiguousarray(every[:, a:b]).ravel()) for a, b in spans], pa.binary()), "owner": pa.array([np.packbits(owner[a:b]).tobytes() for a, b in spans], pa.binary())}
        return pa.table(columns | {x: pa.array([v] + [0] * (len(got) - 1), pa.int64()) for x, v in zip(("n1", "n2", "n3", "n4", "total", "types"), stats)})

    return merge


def _sums(answers: list[dict], rows: int) -> np.ndarray:
    """The sums (rows x keys) of a chunk's keys, in their order."""
    parts = [_unplanes(r["counts"], r["n"] * rows).reshape(rows, -1) for r in sorted(answers, key=lambda r: r["part"])]
    return np.concatenate(parts, axis=1) if parts else np.zeros((rows, 0), np.int64)


def _owned(answers: list[dict]) -> np.ndarray:
    """Which of a chunk's keys are its own to count."""
    parts = [np.unpackbits(np.frombuffer(r["owner"], np.uint8), count=r["n"]).astype(bool) for r in sorted(answers, key=lambda r: r["part"])]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def count_grams(chunks: DataFrame, bits: int, parts: int) -> DataFrame:
    """Answers to all chunks: how often each of their distinct bigrams occurs in all documents, from `parts` ranges of hashes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, bits)
                yield _send(row["chunk"], c.keys, c.counts[None, :], parts, bits)

    sent = chunks.where("n_tokens > 0").drop("ids", "langs", "keys").mapInArrow(send, _SENT)
    return cut(sent.groupBy("part").applyInArrow(_merge(1, 1, lambda s: s[0]), _ANSWER))


def count_words(chunks: DataFrame, grams: DataFrame, bits: int, parts: int) -> DataFrame:
    """Answers to all chunks: for each of their words, and the start mark, its count as a left word, the numbers of bigrams that it begins occurring once, twice and more often, and the number of different words before it."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c = Chunk(row, bits)
            answers = right.to_pylist()
            (total,), owner = _sums(answers, 1), _owned(answers)
            size = len(c.words)
            mine, level = c.gram_left[owner], np.minimum(total[owner], 3)
            values = np.stack([np.bincount(c.left, minlength=size), *(np.bincount(mine[level == i], minlength=size) for i in (1, 2, 3)), np.bincount(c.gram_right[owner], minlength=size)])
            order = np.argsort(c.words, kind="stable")
            out.append(_send(row["chunk"], c.words[order], values[:, order], parts, bits))
        return pa.Table.from_batches(out)

    sent = chunks.where("n_tokens > 0").drop("ids", "langs", "keys").groupBy("chunk").cogroup(grams.select("chunk", "part", "n", "counts", "owner").groupBy("chunk")).applyInArrow(send, _SENT)
    return cut(sent.groupBy("part").applyInArrow(_merge(2, 5, lambda s: s[4]), _ANSWER))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts, from the numbers of grams seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    return tuple(min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d, 1))


def score_chunk(c: Chunk, gram_counts: np.ndarray, word_counts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log probability of a word of each document, by bigrams and by continuation unigrams alone (nan without words).

    Counts are those of all other documents: a bigram's is less by the
    document's own, a context's follower counts and a word's number of left
    neighbours by what these leave.  Only the discounts, the mass that they free
    for unseen words and the number of words are of all documents.
    """
    n_docs = len(c.first) - 1
    out = np.zeros((2, n_docs))
    at = 0
    while at < n_docs:
        end = min(max(at + 1, int(np.searchsorted(c.first, c.first[at] + _SCORED, "right")) - 1), n_docs)
        out[:, at:end] = _score_some(c, at, end, gram_counts, word_counts, model)
        at = end
    with np.errstate(invalid="ignore"):
        return tuple(out / np.where(c.metrics[0] > 0, c.metrics[0], np.nan))


def _score_some(c: Chunk, first: int, last: int, gram_counts: np.ndarray, word_counts: np.ndarray, model: dict) -> np.ndarray:
    """Sums of negative log probabilities, by both, of the documents `first` to `last`."""
    before, once, twice, more, lefts = word_counts
    d2, d1 = np.array([0.0, *model["d2"]]), np.array([0.0, *model["d1"]])
    n_docs = last - first
    both = (T.row_of(c.first[first : last + 1]) << 32) | c.gram[c.first[first] : c.first[last]]
    both.sort()
    begin = _runs(both)
    own = np.diff(np.append(begin, len(both)))
    doc, gram = both[begin] >> 32, both[begin] & 0xFFFFFFFF
    left, right = c.gram_left[gram].astype(np.int64), c.gram_right[gram].astype(np.int64)
    total = gram_counts[gram]
    rest = total - own
    was, now = np.minimum(total, 3), np.minimum(rest, 3)
    contexts, at = np.unique((doc << 32) | left, return_inverse=True)
    word = contexts & 0xFFFFFFFF
    context = before[word] - np.bincount(at, weights=own, minlength=len(word))
    mass = np.zeros(len(word))
    for i, n in ((1, once), (2, twice), (3, more)):
        mass += d2[i] * (n[word] + np.bincount(at, weights=(now == i) * 1.0 - (was == i), minlength=len(word)))
    gone = rest == 0
    pairs, to = np.unique((doc << 32) | right, return_inverse=True)
    seen = np.maximum(lefts[pairs & 0xFFFFFFFF] - np.bincount(to, weights=gone, minlength=len(pairs)), 0)
    every = np.maximum(model["total"] - np.bincount(doc, weights=gone, minlength=n_docs), 1)[pairs >> 32]
    p1 = ((seen - d1[np.minimum(seen, 3).astype(np.int64)]) / every + model["free"] / (model["types"] + 1))[to]
    # Only grams of one hash can break what these two lines see to.
    context, mass = np.maximum(context[at], rest), np.maximum(mass[at], d2[1])
    p2 = np.where(context > 0, (rest - d2[now] + mass * p1) / np.maximum(context, 1), p1)
    return np.stack([np.bincount(doc, weights=-np.log(p) * own, minlength=n_docs) for p in (p2, p1)])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, band (the language or "*"), base metrics, nll and unigram_nll of each row of `docs(doc_id, text, lang, text_key)`; the values are null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = hash_bits(size)
    chunks, drop = bucketed(word_chunks(docs, bits), "chunk", 4 * size // _CHUNK + 1)
    n = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    grams = count_grams(chunks, bits, _ranges(n["tokens"]))
    words = count_words(chunks, grams, bits, _ranges(n["words"]))

    def stats(answers: DataFrame) -> list[int]:
        return [x or 0 for x in answers.agg(*[F.sum(x) for x in ("n1", "n2", "n3", "n4", "total", "types")]).first()]

    g, w = stats(grams), stats(words)
    d1 = discounts(w[:4])
    free = (d1[0] * w[0] + d1[1] * w[1] + d1[2] * (w[5] - w[0] - w[1])) / max(1, w[4])
    model = {"d2": discounts(g[:4]), "d1": d1, "total": w[4], "types": w[5], "free": free}

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            c = Chunk(row, bits)
            got = right.to_pylist()
            (gram_counts,) = _sums([r for r in got if r["step"] == 1], 1)
            sums = _sums([r for r in got if r["step"] == 2], 5)
            word_counts = np.zeros((5, len(c.words)), np.int64)
            if len(gram_counts) != len(c.keys) or sums.shape[1] != (len(c.words) if len(c.keys) else 0):
                raise RuntimeError("answers don't fit their chunk")
            if len(c.keys):
                word_counts[:, np.argsort(c.words, kind="stable")] = sums
            nll, low = score_chunk(c, gram_counts, word_counts, model)
            ids = left.column("ids").combine_chunks().flatten() if left.num_rows == 1 else pa.array(row["ids"], left.schema.field("ids").type.value_type)
            columns = {"doc_id": ids, "text_key": _unplanes(row["keys"], row["n_docs"]), "band": pa.array([x if x is not None else "*" for x in row["langs"]], pa.string())}
            columns |= {x: v for x, v in zip(METRICS, c.metrics)}
            out.append(pa.table(columns | {"nll": pa.array(nll, from_pandas=True), "unigram_nll": pa.array(low, from_pandas=True)}))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, text_key long, band string, " + ", ".join(f"{x} long" for x in METRICS) + ", nll double, unigram_nll double"
    scored = cut(chunks.groupBy("chunk").cogroup(grams.unionByName(words).select("chunk", "step", "part", "n", "counts").groupBy("chunk")).applyInArrow(answer, schema))
    drop()
    return scored


def bands(scored: DataFrame, value: str = "nll") -> DataFrame:
    """(band, centre, spread): median and scaled median deviation of `value` for each band language, exact to 0.001; a row for each language and "*"."""
    rounded = scored.where(F.col(value).isNotNull()).select("band", F.round(value, 3).alias("x"))
    centre = bounded(cut(rounded.groupBy("band").agg(F.percentile("x", 0.5).alias("centre"))))
    spread = rounded.join(centre, "band").groupBy("band").agg(F.first("centre").alias("centre"), (1.4826 * F.percentile(F.round(F.abs(F.col("x") - F.col("centre")), 3), 0.5)).alias("spread"))
    return spread.select("band", "centre", F.greatest("spread", F.lit(0.01)).alias("spread"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 10, most_repeat: int = 20, lower: float = 4.5, upper: float = 4.5, short: float = 50.0) -> DataFrame:
    """One row for every row of `docs`: doc_id, text_key, base metrics, base_failed, kept, nll, perplexity, band_high, unigram_nll, unigram_low, unigram_high.

    base_failed: fewer than `least_words` words, or over `most_repeat` percent
    of them in repeated windows.  A null or blank text has no words, so it
    fails; a null lang uses the band of "*".  Repeated rows are judged each,
    alike: a row's own counts are taken off, its copies' stay.  kept: not
    base_failed, nll at most band_high and unigram_nll within its two bounds.  A
    document of n words has a band wider by sqrt(1 + short / n).  Values at a
    bound are inside.  An empty table gives an empty result; other columns of
    `docs` play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col), F.col(lang_col)).alias("text_key"))
    scored = score(rows)
    high = bands(scored).select("band", F.col("centre").alias("c2"), F.col("spread").alias("s2"))
    both = bands(scored, "unigram_nll").select("band", F.col("centre").alias("c1"), F.col("spread").alias("s1"))
    joined = scored.join(bounded(cut(high.join(both, "band"))), "band", "left")
    wide = F.sqrt(1 + F.lit(short) / F.greatest("n_words", F.lit(1)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    top = F.col("c2") + upper * F.col("s2") * wide
    low, up = F.col("c1") - lower * F.col("s1") * wide, F.col("c1") + upper * F.col("s1") * wide
    inside = (F.col("nll") <= top) & F.col("unigram_nll").between(low, up)
    return joined.select("doc_id", "text_key", *METRICS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "nll", F.exp("nll").alias("perplexity"), top.alias("band_high"), "unigram_nll", low.alias("unigram_low"), up.alias("unigram_high"))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that judge() keeps, with all their columns, whatever their names.

    Repeated rows stay or go together; rows of null or blank text go; an empty
    table gives an empty one.
    """
    good = judge(docs, **how).where("kept").select("doc_id", "text_key")
    id_col, text_col, lang_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("lang_col", "lang")
    return keep_rows(docs, id_col, F.xxhash64(F.col(text_col), F.col(lang_col)), good)
