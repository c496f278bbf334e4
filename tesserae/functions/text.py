"""Text functions.

Column expressions wherever Spark has the means.  Two things it lacks run on
Arrow batches: canonical decomposition beyond one-to-one cases, and positions
of regex matches.  Those work on each batch's distinct values, or on its code
points as arrays, never on one row at a time.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from . import kernels
from .scoring import custom_score

#: Code-point ranges that normalization removes, besides what decomposition leaves to them.
MARKS = ((0x0300, 0x036F), (0x0900, 0x097F), (0x0C00, 0x0C7F), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
#: Bytes of text in a segment of tokens that is sorted by term.
SEGMENT = 1 << 22
_MARK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in MARKS) + "]"


def _is_mark(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in MARKS)


def normalize_text(value: str) -> str:
    """Decomposed, without combining marks, lower case, white space as single spaces."""
    if not value.isascii():
        value = "".join(c for c in unicodedata.normalize("NFD", value) if not _is_mark(c))
    return " ".join(value.lower().split())


@lru_cache(maxsize=1)
def _translation() -> tuple[str, str]:
    """Characters whose decomposition is one base letter and marks, and those letters."""
    source, target = [], []
    for c in range(0x80, 0x30000):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1:
            base = [x for x in d if not _is_mark(x)]
            if len(base) == 1:
                source.append(chr(c))
                target.append(base[0])
    return "".join(source), "".join(target)


def normalize(c: Column) -> Column:
    """normalize_text() inside the JVM, for text whose letters decompose to one letter and marks (all Latin ones)."""
    source, target = _translation()
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.translate(c, source, target), _MARK_CLASS, "")), r"\s+", " "))


def normalize_light(c: Column) -> Column:
    """Lower case and white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


@F.pandas_udf(St.StringType())
def normalize_exact(s: pd.Series) -> pd.Series:
    """normalize_text() of a column, for any script."""
    values = s.tolist()
    distinct = {x: normalize_text(x) for x in set(values) if isinstance(x, str)}
    return pd.Series([distinct.get(x) for x in values], dtype=object)


@lru_cache(maxsize=32)
def stop_words(*languages: str) -> frozenset[str]:
    """Stop words of the packaged lists (all, or of some languages), as written and normalized."""
    lists = json.loads(resources.files("tesserae.functions").joinpath("stop_words.json").read_text("utf-8"))
    chosen = languages or tuple(lists)
    return frozenset(x for lang in chosen for w in lists[lang] for x in (w, normalize_text(w)))


def is_stop_word(c: Column, words: frozenset[str] | None = None) -> Column:
    return c.isin(sorted(stop_words() if words is None else words))


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For each code point, whether it is alphabetic or numeric."""
    import regex

    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))):
        table[m.start() : m.end()] = True
    return table


def tokenize(docs: DataFrame, stop: frozenset[str] | None = None, id_col: str = "doc_id", text_col: str = "text", boundaries_col: str | None = None, by_term: bool = False, score: Callable[[dict], float] | None = None, info: tuple[str, ...] = ()) -> DataFrame:
    """The tokens of every document: doc_id, term, offset (bytes), text_len (bytes), field_type, section_id, heading_level.

    A token is a maximal alphanumeric run, normalized; empty ones and stop words
    are left out.  Its field is that of the first boundary of the list that has
    its offset, else content without section at level 5.  Nothing is shuffled.
    A null text has no tokens.

    With `by_term` the tokens come in segments of whole documents, SEGMENT bytes
    of text long, each sorted by term, with column `first`: whether it is the
    term's first in its document.  `score` is a user's function (see
    scoring.custom_score) that gives column `score`; it is told the columns `info`
    of a token's document.
    """
    drop = stop_words() if stop is None else stop
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.buffers(batch.column("text"))
            for i, j in kernels.row_ranges(off, SEGMENT if by_term else 1 << 21):
                bounds = batch.column("bounds").slice(i, j - i) if boundaries_col else None
                ids = batch.column("doc_id").slice(i, j - i)
                found, row = _tokens(ids, data[off[i] : off[j]], off[i : j + 1] - off[i], bounds, drop, by_term)
                if score is not None:
                    docs_of = pa.RecordBatch.from_arrays([ids, *[batch.column(c).slice(i, j - i) for c in info]], ["doc_id", *info]).to_pylist()
                    found = found.append_column("score", custom_score(found, docs_of, row, score))
                yield found

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *info, *([F.col(boundaries_col).alias("bounds")] if boundaries_col else []))
    return source.mapInArrow(run, f"doc_id {kind}, term string, offset long, text_len long, field_type string, section_id string, heading_level int" + (", first boolean" if by_term else "") + (", score int" if score is not None else ""))


def _tokens(ids: pa.Array, data: np.ndarray, off: np.ndarray, bounds: pa.Array | None, drop: frozenset[str], by_term: bool = False) -> tuple[pa.RecordBatch, np.ndarray]:
    """Tokens of some rows, as arrays, and the row of each; only distinct words are normalized one by one."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.searchsorted(lead, off)
    starts, ends = kernels.runs(_letter_table()[cp], edges)
    _, one, inverse = np.unique(kernels.slice_hashes(cp, starts, ends), return_index=True, return_inverse=True)
    raw = cp.tobytes()
    distinct = [normalize_text(raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass")) for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    wanted = np.array([bool(t) and t not in drop for t in distinct], bool)
    keep = np.flatnonzero(wanted[inverse]) if len(wanted) else np.zeros(0, np.int64)
    if by_term:
        ordered = {t: n for n, t in enumerate(sorted(set(distinct)))}
        order = np.array([ordered[t] for t in distinct], np.int32)[inverse[keep]] if len(keep) else np.zeros(0, np.int32)
        sort = np.argsort(order, kind="stable")
        keep, order = keep[sort], order[sort]
    row = np.searchsorted(edges, starts[keep], "right") - 1
    offset = lead[starts[keep]] - off[row]
    place = np.full(len(keep), -1, np.int64)
    values = {"fieldType": pa.array([], pa.string()), "sectionId": pa.array([], pa.string()), "headingLevel": pa.array([], pa.int32())}
    if bounds is not None:
        if bounds.null_count:
            bounds = pa.array([x or [] for x in bounds.to_pylist()], bounds.type)
        flat, size = bounds.flatten(), bounds.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        low, high = (flat.field(x).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end"))
        values = {"fieldType": flat.field("fieldType"), "sectionId": flat.field("sectionId"), "headingLevel": flat.field("headingLevel").cast(pa.int32()).fill_null(0)}
        open_ = np.arange(len(keep))
        k = 0
        while len(open_):
            open_ = open_[size[row[open_]] > k]
            at = first[row[open_]] + k
            hit = (low[at] <= offset[open_]) & (offset[open_] < high[at])
            place[open_[hit]] = at[hit]
            open_ = open_[~hit]
            k += 1
    outside = place < 0
    pick = pa.array(np.where(outside, 0, place), mask=outside)
    take = lambda name: values[name].take(pick) if len(values[name]) else pa.nulls(len(keep), values[name].type)
    missing = pa.array(outside)
    field = pc.if_else(missing, "content", take("fieldType"))
    level = pc.if_else(missing, pa.scalar(5, pa.int32()), take("headingLevel"))
    terms = pa.array(distinct, pa.string()).take(pa.array(inverse[keep])) if distinct else pa.array([], pa.string())
    columns = [ids.take(pa.array(row)), terms, pa.array(offset, pa.int64()), pa.array(np.diff(off)[row], pa.int64()), field, take("sectionId"), level]
    names = ["doc_id", "term", "offset", "text_len", "field_type", "section_id", "heading_level"]
    if by_term:
        first = np.ones(len(keep), bool)
        first[1:] = (order[1:] != order[:-1]) | (row[1:] != row[:-1])
        columns, names = [*columns, pa.array(first)], [*names, "first"]
    return pa.RecordBatch.from_arrays(columns, names), row


def tokenize_native(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, offset) with built-in functions only; one shuffle by document puts the byte offsets together."""
    from pyspark.sql import Window

    chunks = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\p{IsAlphabetic}\p{N}]*[\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("i", "chunk"))
    word = F.regexp_extract("chunk", r"([\p{IsAlphabetic}\p{N}]+)$", 1)
    end = F.sum(F.octet_length("chunk")).over(Window.partitionBy("doc_id").orderBy("i"))
    return parts.select("doc_id", word.alias("word"), (end - F.octet_length(word)).alias("offset"))


def slugify(c: Column) -> Column:
    """Lower case, other than letters and digits as one hyphen, no hyphen at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(c: Column) -> Column:
    """The first 16 digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def excerpt(c: Column, most: int = 200) -> Column:
    """The first `most` characters, with dots if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def href_prefix(c: Column) -> Column:
    """The link up to its last slash, if the link has 8 bytes and that part 4; else null."""
    prefix = F.regexp_extract(c, "^(.*/)", 1)
    return F.when((F.octet_length(c) >= 8) & (F.octet_length(prefix) >= 4), prefix)


def is_word_boundary(c: Column) -> Column:
    return ~c.rlike(r"^[\p{IsAlphabetic}\p{N}]$")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that both strings begin with, by binary search in the JVM (a prefix test a step)."""
    low, high = F.lit(0), F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(1), F.lit(21))
    start = F.struct(low.alias("low"), high.alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
        same = F.left(a, mid) == F.left(b, mid)
        return F.struct(F.when(same, mid).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(F.greatest(mid - 1, acc["low"])).alias("high"))

    return F.aggregate(steps, start, step)["low"]


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    """Edit distance in characters (a transposition is two), or null above `most`."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def parse_library(query: str) -> list[str]:
    """Terms of a library query: normalized, split at white space."""
    return normalize_text(query).split()


def parse_tiered(query: str, normalize_query: bool = False) -> list[str]:
    """Terms of a tiered query: lower case (diacritics stay unless asked), split at white space."""
    return (normalize_text(query) if normalize_query else query.lower()).split()


def format_bytes(n: int) -> str:
    """A size for people: B, KB or MB."""
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.2f} MB"


TIER_LABELS = {1: "exact", 2: "prefix", 3: "fuzzy"}
MATCH_LABELS = ("title", "section", "subsection", "subsubsection", "content")
