"""Best-fit packing of token sequences, hierarchically.

Every task cuts and packs its own documents by best fit decreasing and gives
out the bins that are full but for `slack` tokens.  The bins left over become
items of a next round of fewer, larger tasks, and so on up a tree.  Bins carry
their members, at most `capacity` of them, so nothing is joined afterwards.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkops import cut

_ENCODERS: dict[str, object] = {}
#: Text of these code points is split alike by both tokenizer libraries; any other text goes to the slower one.
_PLAIN = r"^[\t\n\r -~\x{00A1}-\x{00AC}\x{00AE}-\x{017F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]*$"


def encoder(json_path: str, ranks_path: str | None = None):
    """A function from a list of texts to their token ids (uint32 arrays).

    With `ranks_path`, the same vocabulary as ranks, texts of Latin letters take
    the faster library, which gives the same ids.  Strings of special tokens in
    a text are ordinary text.
    """
    key = f"{json_path}\n{ranks_path}"
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        slow.encode_special_tokens = True
        fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[np.ndarray]:
            if fast is None:
                return [np.array(e.ids, np.uint32) for e in slow.encode_batch(texts, add_special_tokens=False)]
            plain = pc.match_substring_regex(pa.array(texts, pa.large_string()), _PLAIN).to_pylist()
            return [np.array(fast.encode_ordinary(t) if ok else slow.encode(t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, plain)]

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def default_paths() -> tuple[str, str]:
    """Places of the public byte-level vocabulary, as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit decreasing: the bin of each item, and each bin's fill.

    Bins are kept by free space, so that an item takes the fullest bin that
    still holds it; equal sizes keep their order.
    """
    where = np.zeros(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_free: list[int] = []
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(open_free, s)
        if k == len(open_free):
            b, free = len(fill), capacity
            fill.append(0)
        else:
            free = open_free[k]
            b = by_free[free].pop()
            if not by_free[free]:
                del open_free[k]
        fill[b] += s
        free -= s
        if free:
            if not by_free[free]:
                bisect.insort(open_free, free)
            by_free[free].append(b)
        where[i] = b
    return where, np.array(fill, np.int64)


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _bins_schema(kind: str, with_ids: bool) -> str:
    ids = ", ids: array<int>" if with_ids else ""
    return f"bin long, fill int, done boolean, members array<struct<doc_id: {kind}, piece: int, start: long, length: int, ids_crc32: long, offset: int{ids}>>"


def _pack(items: pa.Table, sizes: np.ndarray, capacity: int, slack: int, base: int, member_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Bins of `items`, whose column `members` has lists; ids from `base`."""
    where, fill = best_fit(sizes, capacity)
    order = np.argsort(where, kind="stable")
    lists = items.column("members").combine_chunks().take(pa.array(order))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    per_bin = np.bincount(where[order], weights=counts, minlength=len(fill)).astype(np.int64)
    off = np.zeros(len(fill) + 1, np.int32)
    np.cumsum(per_bin, out=off[1:])
    flat = lists.flatten()
    length = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(length) - length
    offset = run - np.repeat(run[off[:-1]], per_bin)
    columns = [pa.array(offset.astype(np.int32)) if f.name == "offset" else flat.field(f.name) for f in member_type]
    members = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(columns, fields=list(member_type)))
    out = pa.table({"bin": pa.array(base + np.arange(len(fill))), "fill": pa.array(fill.astype(np.int32)), "done": pa.array(fill >= capacity - slack), "members": members})
    yield from out.to_batches(max_chunksize=4096)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, slack: int = 2, fan_in: int = 8, task_rows: int = 500_000, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    One row a piece: doc_id, piece, start, length, ids_crc32 (and `ids` if
    `with_ids`), sequence_id, offset.  A document is its tokens and `end_id`; a
    null or empty text is `end_id` alone.  Only documents of over `capacity`
    tokens are cut, the remainder being the first piece.  Repeated rows are
    packed each; an empty table gives no row; other columns are ignored.
    Merging ends when one task held all that was left, or when a round, dealt
    anew, joined nothing, at any size: no task ever holds more than `fan_in`
    others' leftovers or, on the mean, `task_rows` bins.
    """
    if json_path is None:
        json_path, ranks_path = default_paths()
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    member = pa.struct([f if f.name != "doc_id" else pa.field("doc_id", id_type) for f in _MEMBER if with_ids or f.name != "ids"])
    kind = kind if kind in ("bigint", "int") else "string"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(json_path, ranks_path)
        cols: dict[str, list] = {f.name: [] for f in member}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 256):
                texts = [t or "" for t in batch.column("text")[at : at + 256].to_pylist()]
                for doc, tokens in zip(ids[at : at + 256], encode(texts)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens), capacity)] if len(tokens) > capacity else [0]
                    for piece, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(tokens)])):
                        cols["doc_id"].append(doc)
                        cols["piece"].append(piece)
                        cols["start"].append(a)
                        cols["length"].append(b - a)
                        cols["ids_crc32"].append(zlib.crc32(tokens[a:b].tobytes()))
                        cols["offset"].append(0)
                        if with_ids:
                            cols["ids"].append(tokens[a:b].astype(np.int32))
        n = len(cols["length"])
        if not n:
            return
        flat = pa.StructArray.from_arrays([pa.array(cols[f.name], f.type) for f in member], fields=list(member))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), flat)
        sizes = np.array(cols["length"], np.int64)
        yield from _pack(pa.table({"members": lists}), sizes, capacity, slack, TaskContext.get().partitionId() << 32, member)

    def again(level: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            got = [b for b in batches if b.num_rows]
            if got:
                items = pa.Table.from_batches(got)
                yield from _pack(items, items.column("fill").to_numpy().astype(np.int64), capacity, slack, (level << 58) | (TaskContext.get().partitionId() << 32), member)

        return merge

    schema = _bins_schema(kind, with_ids)
    source = docs.select((F.col(id_col) if kind != "string" else F.col(id_col).cast("string")).alias("doc_id"), F.col(text_col).alias("text"))
    bins = cut(source.mapInArrow(first, schema))
    result = bins.where("done")
    left = bins.where("not done")
    tasks, many, level = max(1, bins.rdd.getNumPartitions()), left.count(), 1
    while many > 1 and level < 31:
        tasks = max(1, -(-tasks // fan_in), -(-many // task_rows))
        packed = cut(left.select("bin", "fill", "members").repartition(tasks, "bin").mapInArrow(again(level), schema))
        result = result.unionByName(packed.where("done"))
        left = packed.where("not done")
        made = packed.count()
        if tasks == 1 or made == many:
            break
        many, level = left.count(), level + 1
    result = result.unionByName(left)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return result.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(*[F.col("m")[c].alias(c) for c in names], "sequence_id", F.col("m")["offset"].cast("long").alias("offset"))
