"""I-Match fingerprints over randomised lexicon subsets.

The lexicon is the terms within a band of inverse document frequency, given as
the least and greatest share of documents.  A document's distinct lexicon terms
are sorted and hashed: all of them (the classical fingerprint), and those in
each of `subsets` random subsets of the lexicon at each of `levels` sampling
rates 1/2, 1/4, ...  Documents of any length so have subsets that a given edit
leaves alone.  A text without lexicon terms has zeros for its fingerprint and is
like no other text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms
from . import textops as T
from .sparkops import cut, written


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = 0.0002, most_share: float = 0.05) -> np.ndarray:
    """Sorted keys of the terms in `least_share` to `most_share` of all documents, and in two at least.

    They are at most the mean number of a document's distinct terms over
    `least_share`, however many documents there are; that bounds the broadcast.
    """
    rows = docs.select(F.col(text_col).alias("text"))
    n = rows.count()
    kept = terms.document_frequencies(rows).where((F.col("df") >= max(2.0, least_share * n)) & (F.col("df") <= most_share * n))
    return np.sort(cut(kept.select("key")).toArrow().column("key").to_numpy().view(np.uint64))


def signatures(texts: pa.Array, keys: np.ndarray, levels: int = 12, subsets: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Classical fingerprint (uint64) and subset hashes (rows x levels * subsets, uint16; 0 for an empty subset) by the lexicon `keys`."""
    data, off = T.column(texts)
    full, parts = [], []
    for _, _, d, o in T.slices(data, off, 1 << 22, terms.ROWS):
        rows = len(o) - 1
        c = terms.distinct_in_rows(*terms.word_hashes(d, o))
        row = (c & np.uint64(terms.ROWS - 1)).astype(np.int64)
        key = c & ~np.uint64(terms.ROWS - 1)
        use = T.lookup(keys, key)[1]
        order = np.argsort(row[use], kind="stable")
        row, key = row[use][order], T.mix(key[use][order] | np.uint64(1))
        first = np.searchsorted(row, np.arange(rows + 1))

        def digest(at: np.ndarray, salt: int) -> np.ndarray:
            f = np.searchsorted(at, first)
            with np.errstate(over="ignore"):
                h = T.mix(key[at] + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                s = T.sums(h, f, np.uint64)
            return np.where(np.diff(f) > 0, T.mix(s + np.diff(f).astype(np.uint64)), 0)

        every = np.arange(len(row))
        full.append(digest(every, 1))
        out = np.zeros((rows, levels * subsets), np.uint16)
        for j in range(subsets):
            with np.errstate(over="ignore"):
                r = T.mix(key ^ np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
            at = every
            for level in range(levels):
                at = at[(r[at] >> np.uint64(level)) & np.uint64(1) == 0]
                if not len(at):
                    break
                h = digest(at, 2 + level * subsets + j)
                out[:, level * subsets + j] = np.where(h != 0, (h % np.uint64(65535) + np.uint64(1)).astype(np.uint16), 0)
        parts.append(out)
    if not full:
        return np.zeros(0, np.uint64), np.zeros((0, levels * subsets), np.uint16)
    return np.concatenate(full), np.concatenate(parts)


def likeness(full_a: np.ndarray, a: np.ndarray, full_b: np.ndarray, b: np.ndarray, subsets: int = 8) -> np.ndarray:
    """Likeness (0 to 1) of two rows of signatures: 1 if all is equal and not empty, else the best level's share of equal subsets.

    A level counts its subsets that aren't empty in both, and only if these are
    half of them at least; where no level has so many, all levels count as one.
    """
    some = ((a != 0) | (b != 0)).reshape(len(a), -1, subsets)
    same = ((a == b) & (a != 0)).reshape(len(a), -1, subsets)
    n, k = some.sum(axis=2), same.sum(axis=2)
    ok = n * 2 >= subsets
    level = np.where(ok, k / np.maximum(n, 1), 0.0).max(axis=1) if len(a) else np.zeros(0)
    pooled = k.sum(axis=1) / np.maximum(n.sum(axis=1), 1)
    out = np.where(ok.any(axis=1), level, pooled)
    return np.where((full_a == full_b) & (full_a != 0) & (a == b).all(axis=1), 1.0, out)


def packed(full: np.ndarray, parts: np.ndarray) -> pa.Array:
    """Fingerprints as bytes: 8 of the classical one, then 2 for each subset."""
    if not len(full):
        return pa.array([], pa.binary())
    raw = np.concatenate([full.astype(">u8").view(np.uint8).reshape(-1, 8), np.ascontiguousarray(parts.astype(">u2")).view(np.uint8).reshape(len(full), -1)], axis=1)
    body, width = raw.tobytes(), raw.shape[1]
    return pa.array([body[i : i + width] for i in range(0, len(body), width)], pa.binary())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of every row, in hexadecimal; equal texts have equal fingerprints, a null text that of an empty one (zeros)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if keys is None else keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed(*signatures(batch.column("text"), shared.value))], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint binary")
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_Signed = tuple[np.ndarray, np.ndarray]


def _compare(ids: pa.Array, texts: list[str], nexts: list[str], own: _Signed, other: _Signed, keys: np.ndarray) -> list[pa.Array]:
    """Result columns of documents and their next ones, whose signatures are given."""
    edited = []
    for t, u in zip(texts, nexts):
        k = len(t) // 3
        edited.append(t[: len(t) - k] + u[:k])
    sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    new = signatures(pa.array(edited, pa.large_string()), keys)
    same = [np.array([a == b for a, b in zip(texts, x)], bool) for x in (edited, nexts)]
    near = [pa.array(np.where(s, 1.0, likeness(*own, *x))) for s, x in zip(same, (new, other))]
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), packed(*own), packed(*new), *near]


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: np.ndarray | None = None) -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and the likeness to that and to the next document.

    Documents are range-partitioned by descending id (nulls last; rows of one id
    by a hash of their text), so a task holds neighbours.  A task's last
    document is met with the next task's first by a join on the tasks' numbers;
    the last document's next is the first.  Null texts are empty.  Equal texts
    have likeness 1, different ones without lexicon terms 0.  A single document
    is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs, text_col) if keys is None else keys)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The results of all but a task's last document, and a row of the task's number with its last id, last text and first text."""
        from pyspark import TaskContext

        held = head = None
        for batch in batches:
            data, off = T.column(batch.column("text"))
            for i, j, _, _ in T.slices(data, off, 1 << 22, 2048):
                b = batch.slice(i, j - i)
                ids, texts = b.column("doc_id"), b.column("text").to_pylist()
                full, subsets = signatures(b.column("text"), shared.value)
                if held is not None:
                    ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                    full, subsets = np.concatenate([held[2], full]), np.concatenate([held[3], subsets])
                else:
                    head = texts[0]
                n = len(texts) - 1
                if n:
                    columns = _compare(ids[:-1], texts[:-1], texts[1:], (full[:-1], subsets[:-1]), (full[1:], subsets[1:]), shared.value)
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*_NAMES, "task", "text", "head"])
                held = ids[-1:], texts[-1], full[-1:], subsets[-1:]
        if held is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([held[0], *empty, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held[1]], pa.string()), pa.array([head], pa.string())], [*_NAMES, "task", "text", "head"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                texts, heads = one.column("text"), one.column("head")
                yield pa.RecordBatch.from_arrays(_compare(one.column("doc_id"), texts.to_pylist(), heads.to_pylist(), signatures(texts, shared.value), signatures(heads, shared.value), shared.value), _NAMES)

    found = written(ranged.mapInArrow(inner, f"{result}, task int, text string, head string"))
    ends = found.where("task is not null")
    tasks = sorted(r[0] for r in ends.select("task").collect())
    after = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, next int")
    heads = ends.select(F.col("task").alias("next"), "head")
    last = ends.select("task", "doc_id", "text").join(F.broadcast(after), "task").join(heads, "next").select("doc_id", "text", "head").mapInArrow(across, result)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.where("task is null").select(*_NAMES).unionByName(last).select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
