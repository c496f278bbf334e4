"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once.  Byte-level tokens tile its bytes, so the running
sum of their lengths is each token's span; an interval join (binary search of
section bounds) attributes tokens to sections.  A token that crosses a boundary
is allocated by `rule`: "start" to the section of its first byte, "majority" to
that with most of its bytes (the earlier of equals), "share" to each in
proportion to its bytes there.  Under any rule a document's counts add up to
its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .packing import default_paths, encoder

RULES = ("start", "majority", "share")


def token_bytes(json_path: str) -> np.ndarray:
    """Bytes of each token id of a byte-level tokenizer file, where each character stands for one byte."""
    with open(json_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: `ends` are the tokens' end bytes, from 0 on without gaps; `bounds` the sections' start bytes and the last end."""
    starts = np.append(0, ends[:-1])
    n = len(bounds) - 1
    if rule == "start" or not len(ends):
        return np.bincount(np.searchsorted(bounds, starts, "right") - 1, minlength=n).astype(np.float64)[:n]
    if rule == "majority":
        first = np.searchsorted(bounds, starts, "right") - 1
        last = np.searchsorted(bounds, ends, "left") - 1
        best = first.copy()
        for k in np.flatnonzero(last > first).tolist():
            s = np.arange(first[k], last[k] + 1)
            part = np.minimum(bounds[s + 1], ends[k]) - np.maximum(bounds[s], starts[k])
            best[k] = s[int(np.argmax(part))]
        return np.bincount(best, minlength=n).astype(np.float64)
    # Tokens that end by each bound, counted with the covered share of the one in progress.
    k = np.searchsorted(ends, bounds, "right")
    inside = k < len(ends)
    done = k.astype(np.float64)
    at = np.minimum(k, len(ends) - 1)
    done += np.where(inside, (bounds - starts[at]) / np.maximum(ends[at] - starts[at], 1), 0.0)
    return np.diff(done)


def line_sections(data: np.ndarray) -> np.ndarray:
    """Section bounds of a text's bytes: each line with its line feed is a section."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.append(np.append(0, breaks[breaks < len(data)]), len(data))


def count_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections=line_sections, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row for each document and section: doc_id, section, field, start_char, end_char, n_tokens (double), doc_tokens.

    `sections` gives the byte bounds of a text's sections, which must tile it
    and fall between characters; by default each line is one.  Field is "title"
    for the first section and "body" for the others.  A null or empty text has
    one empty section without tokens.  Repeated rows are counted each; an empty
    table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<long>").alias("sizes"))
    counted = _count(rows, rule, sections, json_path, ranks_path)
    return counted.withColumn("field", F.when(F.col("section") == 0, "title").otherwise("body")).select("doc_id", "section", "field", "start_char", "end_char", "n_tokens", "doc_tokens")


def count_fields(docs: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n\n", rule: str = "start", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """count_sections() of the columns `fields`, joined by `separator` and encoded once: field is the column's name, section its place.

    A separator belongs to the field before it; a null field is an empty one
    and has its row.  Other columns are ignored.
    """
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    whole = [F.concat(t, F.lit(separator)) for t in texts[:-1]] + texts[-1:]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(*whole).alias("text"), F.array(*[F.octet_length(t).cast("long") for t in whole]).alias("sizes"))
    counted = _count(rows, rule, line_sections, json_path, ranks_path)
    name = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("section") + 1)
    return counted.withColumn("field", name).select("doc_id", "section", "field", "start_char", "end_char", "n_tokens", "doc_tokens")


def _count(rows: DataFrame, rule: str, sections, json_path: str | None, ranks_path: str | None) -> DataFrame:
    """Counts of rows(doc_id, text, sizes): the sections' bytes, or, where these are null, what `sections` finds."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if json_path is None:
        json_path, ranks_path = default_paths()
    kind = rows.schema["doc_id"].dataType.simpleString()
    cache: dict[str, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        size = cache.setdefault("size", token_bytes(json_path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                data, off = T.column(b.column("text"))
                lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                counts, starts, ends, section, docs_n, totals = [], [], [], [], [], []
                for k, ids in enumerate(encode([t or "" for t in b.column("text").to_pylist()])):
                    given = b.column("sizes")[k].as_py()
                    bounds = sections(data[off[k] : off[k + 1]]) if given is None else np.cumsum([0, *given])
                    end = np.cumsum(size[ids])
                    if len(ids) and end[-1] != bounds[-1]:
                        raise ValueError("tokens don't tile the text")
                    counts.append(attribute(end, bounds, rule))
                    chars = lead[off[k] + bounds] - lead[off[k]]
                    starts.append(chars[:-1])
                    ends.append(chars[1:])
                    section.append(np.arange(len(bounds) - 1))
                    docs_n.append(len(bounds) - 1)
                    totals.append(len(ids))
                row = np.repeat(np.arange(len(docs_n)), docs_n)
                number = np.concatenate(section) if section else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(row)),
                        pa.array(number.astype(np.int32)),
                        *[pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (starts, ends)],
                        pa.array(np.concatenate(counts) if counts else np.zeros(0)),
                        pa.array(np.array(totals, np.int64)[row] if len(row) else np.zeros(0, np.int64)),
                    ],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens double, doc_tokens long")
