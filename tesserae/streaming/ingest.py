"""Incremental indexing with Structured Streaming: new documents become postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import by_term, hot_terms, postings
from ..session import ship, shuffle_parts


def append_postings(documents: DataFrame, path: str, checkpoint: str, stop: frozenset[str] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that indexes a stream of docs(doc_id, text, boundaries) into postings at `path`.

    Each micro-batch is a folder of its own, overwritten if the batch is run
    again, so a restart repeats no posting.
    """
    ship(documents.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        parts = shuffle_parts(batch.sparkSession)
        by_term(postings(batch, stop), hot_terms(batch, parts, stop), parts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def document_frequency(postings_stream: DataFrame) -> DataFrame:
    """Running postings a term of a stream of postings(term, ...)."""
    return postings_stream.groupBy("term").agg(F.count("*").alias("postings"))
