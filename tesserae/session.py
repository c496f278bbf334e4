"""What the package needs of a Spark session."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors this package's source, once for each Spark application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for f in sorted([*root.rglob("*.py"), *root.rglob("*.json")]):
            z.write(f, f.relative_to(root.parent))
    place = Path(tempfile.mkdtemp(prefix="source-")) / f"{root.name}.zip"
    place.write_bytes(body.getvalue())
    sc.addPyFile(str(place))
    sc._tesserae_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names; where it names none, one of this machine in local mode, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the execution that wrote them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it from there: it is computed once, and a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        # A query takes the setting as it is when the query is made.
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, where it comes in fewer parts than there are cores and is small.

    Tables of one small file, which one task would read, are dealt out anew;
    anything of over 64 MB for each core stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    return df.repartition(cores) if parts <= cores and _bytes(df) <= cores << 26 else df


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
