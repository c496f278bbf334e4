"""Spark helpers of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, freed_shuffles, remove, shared_folder, ship, spread

__all__ = ["bounded", "bucketed", "cut", "held_out", "keep_rows", "remove", "shared_folder", "ship", "spread", "with_info", "written"]


def bounded(df: DataFrame, most: int = 50_000) -> DataFrame:
    """`df`, a table that is cheap to count, marked for broadcast if it has at most `most` rows; a join with more shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bucketed(df: DataFrame, by: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """`df` written to the shared folder in buckets of `by`, and a function that deletes it.

    Grouping by `by` or joining on it then moves only the other side.  It is
    written without a shuffle.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with freed_shuffles(spark):
        df.write.bucketBy(min(int(buckets), 50_000), by).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return spark.table(name), drop


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, id_col: str, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and `key` are a row of `kept` (two columns); no column name of `docs` can clash."""
    k, left, right = (f"_{uuid.uuid4().hex}" for _ in range(3))
    keyed = docs.withColumn(k, key)
    return keyed.join(kept.toDF(left, right).distinct(), F.col(f"`{id_col}`").eqNullSafe(F.col(left)) & (F.col(k) == F.col(right)), "left_semi").drop(k)


def with_info(rows: DataFrame, info: DataFrame, key: str, count: str, total: int, most: int = 1000) -> DataFrame:
    """Inner join of `rows` to one `info` row for each key, safe against hot keys.

    `info` has how many rows bear each key.  Keys of more than 1 / `most` of
    all rows, fewer than `most` keys by arithmetic, are joined by broadcast and
    so never meet in one task; the others by a shuffle join.  Null keys match.
    """
    hot = info.where(F.col(count) * most > F.lit(total))
    cold = info.where(~(F.col(count) * most > F.lit(total)))
    names = hot.select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = rows.join(F.broadcast(names), F.col(key).eqNullSafe(F.col("_hot")), "left")

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed(key, "_key")
        return left.drop("_hot", "_is_hot").join(right, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

    a = join(marked.where("_is_hot"), F.broadcast(hot))
    b = join(marked.where("_is_hot is null"), cold)
    return a.unionByName(b)


def held_out(doc_id: str = "doc_id"):
    """The rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
