"""Sharding by Karmarkar-Karp differencing.

Equal texts form groups that stay together.  Every task partitions its groups
by multi-way differencing: the two partial partitions of largest spread are
combined, oppositely ordered, until one is left.  The tasks' partial partitions
are then combined in the same way; there are as many as tasks, however large
the table.  Groups too large for any task to balance are differenced first, and
each task fills up around its part of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparkops import cut, with_info


def difference(nodes: list[tuple[int, ...]], shards: int) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp on partial partitions given as `shards` sums each: the shard of each node's every slot, and the shards' sums.

    Ties go to the node that came first.
    """
    if not nodes:
        return [], [0] * shards
    slots = [sorted(range(shards), key=lambda s, n=n: -n[s]) for n in nodes]
    sums = [[n[s] for s in o] for n, o in zip(nodes, slots)]
    heap = [(x[-1] - x[0], i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    tree: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        total = [p + q for p, q in zip(x, reversed(y))]
        perm = sorted(range(shards), key=total.__getitem__, reverse=True)
        sums.append([total[k] for k in perm])
        sums[a] = sums[b] = []
        tree.append((a, b, perm))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    top = heap[0][1]
    place: dict[int, list[int]] = {top: list(range(shards))}
    for k in range(len(tree) - 1, -1, -1):
        a, b, perm = tree[k]
        mine = place.pop(len(nodes) + k)
        left, right = [0] * shards, [0] * shards
        for slot, source in enumerate(perm):
            left[source] = mine[slot]
            right[shards - 1 - source] = mine[slot]
        place[a], place[b] = left, right
    out = []
    for i in range(len(nodes)):
        back = [0] * shards
        for rank, slot in enumerate(slots[i]):
            back[slot] = place[i][rank]
        out.append(back)
    return out, sums[top]


def _item(size: int, shards: int) -> tuple[int, ...]:
    return (size, *[0] * (shards - 1))


def shard_groups(groups: DataFrame, shards: int, large: int = 64) -> DataFrame:
    """(key, shard) of `groups(key, bytes)`, which has each key once.

    Groups of over 1 / (shards * large) of all bytes, fewer than shards * large
    of them by arithmetic, are differenced on the driver.
    """
    spark = groups.sparkSession
    total = int(groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    limit = F.lit(total) / (shards * large)
    big = sorted(((r["bytes"], bytes(r["key"])) for r in groups.where(F.col("bytes") > limit).collect()), key=lambda r: (-r[0], r[1]))
    placed, loads = difference([_item(int(n), shards) for n, _ in big], shards)
    base = [0] * shards
    for (n, _), p in zip(big, placed):
        base[p[0]] += int(n)
    rest = total - sum(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        sizes = t.column("bytes").to_pylist()
        part = sum(sizes) / max(1, rest)
        places, _ = difference([tuple(int(x * part) for x in base), *[_item(s, shards) for s in sizes]], shards)
        home = {s: slot for slot, s in enumerate(places[0])}
        yield from pa.table({"key": t.column("key"), "bytes": t.column("bytes"), "p": pa.array([TaskContext.get().partitionId()] * len(sizes), pa.int32()), "slot": pa.array([home[p[0]] for p in places[1:]], pa.int32())}).to_batches(max_chunksize=65536)

    local = cut(groups.where(F.col("bytes") <= limit).mapInArrow(run, "key binary, bytes long, p int, slot int"))
    sums = local.groupBy("p", "slot").agg(F.sum("bytes").alias("b")).collect()
    partial: dict[int, list[int]] = {}
    for r in sums:
        partial.setdefault(r["p"], [0] * shards)[r["slot"]] = int(r["b"])
    alike: dict[int, list[int]] = {}
    for s in range(shards):
        alike.setdefault(base[s], []).append(s)
    rows = []
    for same in alike.values():
        order = sorted(partial)
        places, _ = difference([tuple(partial[p][s] for s in same) for p in order], len(same))
        rows += [(p, s, same[places[i][j]]) for i, p in enumerate(order) for j, s in enumerate(same)]
    names = spark.createDataFrame(rows or [(-1, -1, -1)], "p int, slot int, shard int")
    out = local.join(F.broadcast(names), ["p", "slot"]).select("key", "shard")
    if big:
        out = out.unionByName(spark.createDataFrame([(bytearray(k), p[0]) for (_, k), p in zip(big, placed)], "key binary, shard int"))
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Every row of `docs` in a shard, by byte balance: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and one; a null text is an empty one.  Equal
    texts share a shard, so one group of over 1 / shards of all bytes bounds the
    balance.  slot numbers each shard's rows from 0 without gaps.  An empty
    table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    info = cut(groups.join(shard_groups(groups.select("key", "bytes"), shards), "key").select("key", "n", "shard"))
    placed = cut(with_info(rows, info, "key", "n", rows.count()).select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("p")))
    # A row for each task and shard: the slots that the tasks before it fill.
    before = Window.partitionBy("shard").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("p", "shard").count().select("p", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            key = b.column("p").to_numpy().astype(np.int64) * shards + b.column("shard").to_numpy()
            slot = b.column("start").to_numpy().copy()
            for k in np.unique(key).tolist():
                mine = np.flatnonzero(key == k)
                first = at.get(k, 0)
                slot[mine] += first + np.arange(len(mine))
                at[k] = first + len(mine)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = placed.join(F.broadcast(starts), ["p", "shard"])
    numbered = placed.mapInArrow(number, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
