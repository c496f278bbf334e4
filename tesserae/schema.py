"""Schemas and constants of the search engine."""

from __future__ import annotations

from pyspark.sql import types as T

BOUNDARY = T.StructType(
    [
        T.StructField("docId", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("fieldType", T.StringType()),
        T.StructField("sectionId", T.StringType()),
        T.StructField("headingLevel", T.IntegerType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("slug", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("fieldBoundaries", T.ArrayType(BOUNDARY)),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("documents", T.ArrayType(T.StringType())),
        T.StructField("indexes", T.MapType(T.StringType(), T.StructType([T.StructField("include", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))]))),
    ]
)
#: Required document fields; the others have defaults.
REQUIRED = ("id", "slug", "title", "excerpt", "href", "type", "text", "fieldBoundaries")

TITLE, HEADING, CONTENT = "title", "heading", "content"
#: Stored scores and library scores of the field types.
STORED = {TITLE: 1000, HEADING: 100, CONTENT: 10}
LIBRARY = {TITLE: 100.0, HEADING: 10.0, CONTENT: 1.0}
UNBOUNDED_LEVEL = 5
FORMAT_VERSION = 1
FUZZY_DISTANCE = 2
MOST_RESULTS, CUT_RESULTS = 200, 100
