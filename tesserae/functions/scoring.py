"""Scores: field types, match types, position, tiers, and custom scoring functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONTENT, HEADING, LIBRARY, STORED, TITLE


def match_type(level: Column) -> Column:
    """Bucket of a heading level: 0 title, 1 section (levels 1-2), 2 subsection, 3 subsubsection, 4 content."""
    return F.when(level == 0, 0).when(level.isin(1, 2), 1).when(level == 3, 2).when(level == 4, 3).otherwise(4).cast("int")


def _by_field(field: Column, values: dict) -> Column:
    return F.when(field == TITLE, F.lit(values[TITLE])).when(field == HEADING, F.lit(values[HEADING])).otherwise(F.lit(values[CONTENT]))


def field_score(field: Column) -> Column:
    """Library score of a field type: 100, 10 or 1."""
    return _by_field(field, LIBRARY)


def position_bonus(offset: Column, length: Column) -> Column:
    """0.5 at the start of a text, falling to 0 at its end; 0 for an empty text."""
    return F.when(length == 0, F.lit(0.0)).otherwise(0.5 * (1.0 - offset / length))


def final_score(field: Column, offset: Column, length: Column) -> Column:
    return field_score(field) + position_bonus(offset, length)


def stored_score(field: Column, offset: Column, length: Column) -> Column:
    """Default score of a posting: 1000, 100 or 10 and up to 5 for an early place."""
    ratio = F.when(length == 0, F.lit(1.0)).otherwise((length - offset) / length)
    return (_by_field(field, STORED) + F.floor(5 * ratio)).cast("int")


def prefix_penalty(score: Column, query: Column, term: Column) -> Column:
    """Score of a prefix match: by the share of the term's bytes that the query covers."""
    return score * (F.octet_length(query) / F.greatest(F.octet_length(term), F.lit(1)))


def fuzzy_penalty(score: Column, distance: Column) -> Column:
    return score * (1.0 / (1.0 + distance))


#: What a user's function is told of a document, besides its id, where the corpus has it.
DOC_COLUMNS = ("title", "excerpt", "href", "kind", "category", "author", "tags")


def custom_score(tokens: pa.RecordBatch, docs: list[dict], row: np.ndarray, function: Callable[[dict], float]) -> pa.Array:
    """Scores of tokens by a user's function of each match; docs[row[i]] is the document of token i.

    The function gets a dict {"term", "doc": {...}, "match": {"fieldType",
    "headingLevel", "sectionId", "offset", "textLength"}} and returns a number;
    it is floored, negative numbers count as 0, and a result that isn't finite
    ends the job.  Functions are called where the tokens are made, so a document
    goes to Python once and nothing is exchanged.
    """
    columns = [tokens.column(c).to_pylist() for c in ("term", "field_type", "heading_level", "section_id", "offset", "text_len")]
    values = [
        function({"term": term, "doc": dict(docs[r]), "match": {"fieldType": field, "headingLevel": level, "sectionId": section, "offset": offset, "textLength": length}})
        for r, term, field, level, section, offset, length in zip(row.tolist(), *columns)
    ]
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        raise ValueError("the scoring function gave a number that isn't finite")
    return pa.array(np.floor(np.maximum(x, 0)).astype(np.int64)).cast(pa.int32())


def default_function(context: dict) -> float:
    """The default score as a custom function."""
    m = context["match"]
    base = STORED.get(m["fieldType"], STORED[CONTENT])
    ratio = (m["textLength"] - m["offset"]) / m["textLength"] if m["textLength"] else 1.0
    return base + np.floor(5 * ratio)
