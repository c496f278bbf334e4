"""Word-first language identification.

A word that training saw scores by its log frequency in each language.  Any
other word falls back to its character n-grams, longest first: the first length
of which the model knows a gram decides.  Words are runs of letters, lower
case.  A text's distinct words are scored once a batch; a document sums them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sparkops import cut, held_out, keep_rows

_M = np.uint64(0x9FB21C651E98DF25)
_FOLD: list[np.ndarray] = []
EDGE = 1


def _fold() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter or mark within a word."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha() or unicodedata.category(x) in ("Mn", "Mc"):
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
        _FOLD.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _FOLD[0]


class _Letters:
    """The letter words of a slice of rows: code points, starts, ends, first word of each row and hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        cp = T.code_points(data)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[off]
        self.cp = _fold()[np.minimum(cp, sys.maxunicode)]
        ink = self.cp > 0
        n = len(ink)
        start, end = ink.copy(), ink.copy()
        if n:
            start[1:] &= ~ink[:-1]
            end[:-1] &= ~ink[1:]
            edge = at[:-1][at[:-1] < n]
            start[edge] = ink[edge]
            last = (at[1:] - 1)[at[1:] > at[:-1]]
            end[last] = ink[last]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        # Marks alone, without a letter, are no word.
        letters = np.zeros(n + 1, np.int64)
        np.cumsum(_FOLD[1][np.minimum(cp, sys.maxunicode)], out=letters[1:])
        real = letters[self.ends] > letters[self.starts]
        self.starts, self.ends = self.starts[real], self.ends[real]
        self.first = np.searchsorted(self.starts, at)
        with np.errstate(over="ignore"):
            self.run = np.zeros(n + 1, np.uint64)
            np.cumsum(self.cp.astype(np.uint64) * T._powers(T._BASE, n), out=self.run[1:])
        self.hash = T.hash_slices(self.run, self.starts, self.ends)


def _gram_hashes(cp: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of code points that start at `at`."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _M + cp[at + k].astype(np.uint64)
        return T.mix(h * np.uint64(16) + np.uint64(n))


def _edged(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an edge mark on both sides, one after the other, and their offsets."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 2, out=off[1:])
    out = np.full(int(off[-1]), EDGE, np.uint32)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(off[:-1] + 1, size) + inner] = cp[np.repeat(starts, size) + inner]
    return out, off


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 20_000, longest: int = 5) -> dict:
    """Model of languages from the whole texts of at most `most_docs` labelled documents, chosen by a hash of the id.

    Only rows that aren't held out and have a lang are learned from.  Every
    word and gram of these is kept; the sample bounds their tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("_h")).distinct().orderBy("_h", "doc_id").limit(most_docs).select("doc_id")
    ids = [r[0] for r in chosen.collect()]
    if not ids:
        return {"languages": [], "longest": longest, "words": None, "grams": {}}
    sample = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], f"doc_id {docs.schema[id_col].dataType.simpleString()}")), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object).astype(str)
            names, code = np.unique(langs, return_inverse=True) if len(langs) else ([], np.zeros(0, np.int64))
            data, off = T.column(batch.column("text"))
            for i, j, d, o in T.slices(data, off, 1 << 21):
                w = _Letters(d, o)
                row = T.row_of(w.first)
                for k in np.unique(code[i:j]):
                    mine = np.flatnonzero(code[i:j][row] == k)
                    if not len(mine):
                        continue
                    h, at, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                    at = mine[at]
                    parts = [(0, h, n)]
                    cp, woff = _edged(w.cp, w.starts[at], w.ends[at])
                    word = np.repeat(np.arange(len(at)), np.diff(woff))
                    for g in range(1, longest + 1):
                        p = np.flatnonzero(np.arange(len(cp)) + g <= woff[word + 1])
                        if len(p):
                            keys, inv = np.unique(_gram_hashes(cp, g, p), return_inverse=True)
                            parts.append((g, keys, np.bincount(inv, weights=n[word[p]]).astype(np.int64)))
                    for g, keys, c in parts:
                        m = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * m), pa.array(np.full(m, g, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "key", "c"])

    counted = sample.mapInArrow(count, "lang string, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c"))
    counted = cut(counted)
    totals = {(r["lang"], r["n"]): r["t"] for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}
    languages = sorted({lang for lang, _ in totals})
    got = counted.select("lang", "n", "key", "c").toArrow()
    lang = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    n_of, key, c = (got.column(x).to_numpy() for x in ("n", "key", "c"))
    tables = {}
    for n in range(longest + 1):
        mine = n_of == n
        keys, inv = np.unique(key[mine].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(languages)), np.float64)
        np.add.at(counts, (inv, lang[mine]), c[mine])
        t = np.array([totals.get((x, n), 0) for x in languages], np.float64)
        tables[n] = (keys, np.log((counts + 0.05) / (t + 0.05 * (len(keys) + 1))).astype(np.float32))
    return {"languages": languages, "longest": longest, "words": tables[0], "grams": {n: tables[n] for n in range(1, longest + 1)}}


def word_scores(model: dict, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Log frequencies (words x languages): of the word if known, else the mean of its grams of the longest known length, weighed down by its distance from a word."""
    out = np.zeros((len(starts), len(model["languages"])), np.float64)
    keys, values = model["words"]
    at, found = T.lookup(keys, hashes)
    out[found] = values[at[found]]
    todo = np.flatnonzero(~found)
    for n in range(model["longest"], 0, -1):
        if not len(todo):
            break
        text, off = _edged(cp, starts[todo], ends[todo])
        word = np.repeat(np.arange(len(todo)), np.diff(off))
        p = np.flatnonzero(np.arange(len(text)) + n <= off[word + 1])
        keys, values = model["grams"][n]
        at, found = T.lookup(keys, _gram_hashes(text, n, p))
        owner = word[p[found]]
        hits = np.bincount(owner, minlength=len(todo))
        some = hits > 0
        for k in range(out.shape[1]):
            total = np.bincount(owner, weights=values[at[found], k], minlength=len(todo))
            out[todo[some], k] = total[some] / np.maximum(hits[some], 1)
        todo = todo[~some]
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", key_cols: list[str] | None = None) -> DataFrame:
    """For every row: doc_id, lang_pred, score (posterior of the prediction, from at most 50 words' worth of mean evidence), n_letter_words.

    A null text or one without letters gives `und` with score 0, and so does an
    untrained model.  Rows repeat as they come; equal texts give equal results;
    of languages that tie the first by name is taken.  `key_cols` pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = key_cols or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m["languages"], "und"], object)
        for batch in batches:
            data, off = T.column(batch.column("text"))
            pred, conf, n_words = [], [], []
            for _, _, d, o in T.slices(data, off, 1 << 21):
                w = _Letters(d, o)
                count = np.diff(w.first)
                if not len(m["languages"]) or not len(w.starts):
                    pred.append(np.full(len(count), len(names) - 1))
                    conf.append(np.zeros(len(count)))
                    n_words.append(count)
                    continue
                h, at, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                each = word_scores(m, w.cp, w.starts[at], w.ends[at], h)
                total = np.stack([T.sums(each[inv, k], w.first, np.float64) for k in range(each.shape[1])], axis=1)
                best = np.argmax(total, axis=1)
                scaled = total * (np.minimum(count, 50) / np.maximum(count, 1))[:, None]
                p = 1 / np.exp(scaled - scaled.max(axis=1, keepdims=True)).sum(axis=1)
                pred.append(np.where(count > 0, best, len(names) - 1))
                conf.append(np.where(count > 0, p, 0.0))
                n_words.append(count)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pred, conf, n_words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(x) for x in extra], pa.array(names[flat[0].astype(np.int64)], pa.string()), pa.array(flat[1].astype(np.float64)), pa.array(flat[2].astype(np.int64))], ["doc_id", *extra, "lang_pred", "score", "n_letter_words"])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra).mapInArrow(run, f"doc_id {kind}{kinds}, lang_pred string, score double, n_letter_words long")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is found with at least `least_score`, with all their columns, whatever their names; the others go.

    Null texts and texts without letters go, and all rows where there is nothing
    to learn from; repeated rows stay or go together; an empty table gives an
    empty one.
    """
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), key.alias("text_key"))
    found = identify(rows, fit(rows), key_cols=["text_key"])
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("doc_id", "text_key")
    return keep_rows(docs, id_col, key, good)
