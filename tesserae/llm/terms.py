"""Document frequencies of terms, counted by Spark over all documents.

Tasks count the terms of their own documents and Spark adds the counts up; no
term is left out, and nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: A term's key is its hash without the lowest bits, which hold the row while sorting.
ROW_BITS = 12
ROWS = 1 << ROW_BITS
_LOW = np.uint64(ROWS - 1)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, and each row's first word."""
    starts, ends, first = T.words(data, off)
    return T.hash_slices(T.running(data), starts, ends), first


def distinct_in_rows(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted distinct (key, row) composites of at most 4096 rows' terms: key | row."""
    c = (h & ~_LOW) | T.row_of(first).astype(np.uint64)
    c.sort()
    return c[np.append(True, c[1:] != c[:-1])] if len(c) else c


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


class Counter:
    """Counts of 64-bit keys, merged now and then; in eight parts by key, so that a merge copies an eighth."""

    PARTS = 8

    def __init__(self, most: int = 1 << 18) -> None:
        self.keys: list[list[np.ndarray]] = [[] for _ in range(self.PARTS)]
        self.counts: list[list[np.ndarray]] = [[] for _ in range(self.PARTS)]
        self.size, self.most = [0] * self.PARTS, [most] * self.PARTS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        part = ((keys >> np.uint64(ROW_BITS)) & np.uint64(self.PARTS - 1)).astype(np.int8)
        for k in range(self.PARTS):
            mine = part == k
            self.keys[k].append(keys[mine])
            self.counts[k].append(counts[mine].astype(np.int32))
            self.size[k] += len(self.keys[k][-1])
            if self.size[k] > self.most[k]:
                self._merge(k)
                self.most[k] = max(self.most[k], self.size[k] + self.size[k] // 2)

    def _merge(self, k: int) -> None:
        if self.keys[k]:
            keys, counts = tally(np.concatenate(self.keys[k]), np.concatenate(self.counts[k]))
            self.keys[k], self.counts[k], self.size[k] = [keys], [counts], len(keys)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys, once each in no order, and their counts; the counter is empty then."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for k in range(self.PARTS):
            self._merge(k)
            for x, c in zip(self.keys[k], self.counts[k]):
                keys.append(x)
                counts.append(c)
            self.keys[k], self.counts[k], self.size[k] = [], [], 0
        return np.concatenate(keys), np.concatenate(counts)


def key_counts(composites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document counts of the keys of sorted distinct composites."""
    k = composites & ~_LOW
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.diff(np.append(at, len(k)))


def sized(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "df"])


#: Keys that a task's counter may hold before it hands them on.
_HELD = 1 << 22


def document_frequencies(docs: DataFrame, hashes: Callable = word_hashes) -> DataFrame:
    """(key, df): in how many rows of `docs(text)` each term occurs, by the key of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            data, off = T.column(batch.column("text"))
            for _, _, d, o in T.slices(data, off, 1_000_000, ROWS):
                found.add(*key_counts(distinct_in_rows(*hashes(d, o))))
                if sum(found.size) > _HELD:
                    yield sized(*found.taken())
        yield sized(*found.taken())

    return docs.select("text").mapInArrow(run, "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))
