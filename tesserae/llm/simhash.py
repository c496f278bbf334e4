"""SimHash near-duplicate detection with a segment-popcount embedding.

Fingerprints come from numpy kernels over whole texts.  Links (Hamming distance
`radius` or less) are found among distinct fingerprints only: each fingerprint
is mapped to the bit counts of its `segments` segments, whose Manhattan
distance never exceeds the Hamming distance.  Coordinates are dealt into
`groups` grid blocks; two points within `radius` differ in at most `radius` of
these, so they share the grid cell made of the other `groups - radius` blocks.
Joining on those cells gives the candidates, which are then verified exactly.
Cells of more than `cell_rows` fingerprints (families of near copies) pass to a
finer grid, of segments of one bit; there a cell leaves only `radius` of
`groups` + 2 blocks of bits free.  Cells that are crowded even so aren't joined
with themselves: each of their fingerprints looks up its neighbours in the free
bits, 137 for radius 2, so that no group's pairs are ever all formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .sparkops import cut, keep_rows, with_info

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPREAD = np.zeros(256, np.uint64)
for _b in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def _fingerprints(data: np.ndarray, off: np.ndarray, width: int, seed: int) -> np.ndarray:
    starts, ends, first = T.words(data, off)
    rows = len(off) - 1
    out = np.zeros(rows, np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    body = np.full(int(at[-1]), 0x20, np.uint8)
    index = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    body[np.repeat(at[:-1], size) + index] = _LOWER[data[np.repeat(starts, size) + index]]
    count = np.diff(first)
    n_shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(n_shingles, out=begin[1:])
    row = np.repeat(np.arange(rows), n_shingles)
    word = first[row] + np.arange(int(begin[-1])) - begin[row]
    last = np.minimum(word + width, first[row + 1]) - 1
    h = T.xxh64_slices(body, at[word], at[last] + size[last], seed)
    # Bits are added up 8 lanes at a time, in runs of at most 255 shingles.
    runs = (n_shingles + 254) // 255
    run_row = np.repeat(np.arange(rows), runs)
    edge = np.zeros(rows + 1, np.int64)
    np.cumsum(runs, out=edge[1:])
    run_start = begin[run_row] + 255 * (np.arange(int(edge[-1])) - edge[run_row])
    has = np.flatnonzero(n_shingles)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[((h >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)], run_start)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), edge[has], axis=0)
        bits = (2 * counts > n_shingles[has, None]).astype(np.uint64)
        out[has] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, text_key long) for every row of `docs`; repeated rows stay.

    A null or blank text has fingerprint 0; a text of fewer than `width` words
    has one shingle.  text_key is a hash of the text that tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.column(batch.column("text"))
            parts = [_fingerprints(d, o, width, seed) for _, _, d, o in T.slices(data, off)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("text_key")], ["doc_id", "fp", "text_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key")).mapInArrow(run, f"doc_id {kind}, fp long, text_key long")


def embedding(fp: Column, segments: int) -> list[Column]:
    """Bit counts of the `segments` equal segments of a 64-bit fingerprint."""
    width = 64 // segments
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long"))) for i in range(segments)]


def _cells(points: DataFrame, segments: int, groups: int, radius: int) -> DataFrame:
    """One row for each point and choice of groups - radius blocks: (choice, cell long, fp)."""
    coords = embedding(F.col("fp"), segments)
    blocks = [coords[i::groups] for i in range(groups)]
    keys = [F.xxhash64(F.lit(n), *[c for g in chosen for c in blocks[g]]) for n, chosen in enumerate(combinations(range(groups), groups - radius))]
    return points.select("fp", F.posexplode(F.array(*keys)).alias("choice", "cell"))


def _close(cells: DataFrame, radius: int) -> DataFrame:
    a = cells.select("cell", F.col("fp").alias("a"))
    b = cells.select("cell", F.col("fp").alias("b"))
    return a.join(b, "cell").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")


def _masks(groups: int, radius: int) -> list[tuple[int, int]]:
    """(choice, mask): for each choice of blocks of the finest grid, the up to `radius` bits, not none, that two points of one of its cells may differ in."""
    out = []
    for n, chosen in enumerate(combinations(range(groups), groups - radius)):
        free = [bit for bit in range(64) if bit % groups not in chosen]
        out += [(n, sum(1 << b for b in bits)) for k in range(1, radius + 1) for bits in combinations(free, k)]
    return [(n, m - (1 << 64) if m >> 63 else m) for n, m in out]


def _crowded(cells: DataFrame, most: int) -> DataFrame:
    return cut(cells.groupBy("cell").count().where(F.col("count") > most).select("cell"))


def links(points: DataFrame, radius: int = 2, segments: int = 32, groups: int = 6, cell_rows: int = 512) -> DataFrame:
    """Every pair (a < b) of the distinct fingerprints `points(fp)` within `radius` bits, once.

    An empty table gives no pairs.  No cell is capped: those of over `cell_rows`
    points pass to the finer grid, and those crowded there to its free bits'
    neighbours; all pairs are verified and kept.
    """
    cells = cut(_cells(points, segments, groups, radius))
    crowded = _crowded(cells, cell_rows)
    pairs = _close(cells.join(crowded, "cell", "left_anti"), radius)
    if not crowded.isEmpty():
        fine = cut(_cells(cells.join(crowded, "cell", "left_semi").select("fp").distinct(), 64, groups + 2, radius))
        full = _crowded(fine, cell_rows)
        pairs = pairs.unionByName(_close(fine.join(full, "cell", "left_anti"), radius))
        if not full.isEmpty():
            deep = fine.join(full, "cell", "left_semi")
            masks = points.sparkSession.createDataFrame(_masks(groups + 2, radius), "choice int, mask long")
            other = deep.join(F.broadcast(masks), "choice").select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("mask")).alias("b")).where("a < b").distinct()
            pairs = pairs.unionByName(other.join(points.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    return pairs.distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(fp, root): connected components by alternating large-star and small-star steps.

    Every round is two partially aggregated shuffles; nothing is gathered by
    node.  It ends when a round changes no edge; were that not reached in
    `most_rounds` rounds, an error is raised.
    """
    now = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if now.isEmpty():
        return nodes.select("fp", F.col("fp").alias("root"))
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            return nodes.join(now.groupBy("u").agg(F.min("v").alias("root")), F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
        before = mark
    raise RuntimeError(f"components aren't stable after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, segments: int = 32, groups: int = 6, cell_rows: int = 512) -> DataFrame:
    """One row for every row of `docs`: doc_id, fp, text_key, root (of the component), n_near, component_id.

    n_near counts the other rows whose fingerprint is within `radius` bits;
    component_id is the smallest id of the component (null if all are null).
    Empty and null texts share fingerprint 0 and link like any others; equal
    rows count each; an empty table gives an empty result; other columns of
    `docs` play no part.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    pairs = cut(links(classes.select("fp"), radius, segments, groups, cell_rows))
    n = classes.select(F.col("fp").alias("b"), "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(n, "b").groupBy("a").agg(F.sum("n").alias("others"))
    rooted = components(classes.select("fp"), pairs)
    info = classes.join(near, F.col("fp") == F.col("a"), "left").join(rooted.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"))
    lows = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = cut(info.join(lows, "root").select("fp", "n", "root", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id"))
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return with_info(prints, info, "fp", "n", total).select("doc_id", "fp", "text_key", "root", "n_near", "component_id")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each near-duplicate component, that of the smallest id (nulls last; of its texts that of the least hash), and all its columns, whatever their names.

    Of rows with one id and one text any stays.  Empty and null texts are one
    component; an empty table gives an empty one.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    each = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    keep = cut(each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n")).alias("k")).select("k.doc_id", "k.text_key", "k.n"))
    key = F.xxhash64(F.col(text_col))
    if keep.where("n > 1").isEmpty():
        return keep_rows(docs, id_col, key, keep.drop("n"))
    name = f"_{uuid.uuid4().hex}"
    kept = keep_rows(docs.withColumn(name, key), id_col, F.col(name), keep.drop("n"))
    return kept.dropDuplicates([id_col, name]).drop(name)
