"""Schemas shared by the sources, operators and the chunk table."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
    ]
)

CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# One candidate or finished chunk before it is joined to its file's columns.
PIECE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)

CHUNK_COLUMNS = [
    "path",
    "lang",
    "symbol",
    "kind",
    "start_line",
    "end_line",
    "content",
    "content_hash",
]

VECTOR_TYPE = T.ArrayType(T.FloatType(), True)

STORED_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("vector", VECTOR_TYPE),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)
STORED_COLUMNS = [f.name for f in STORED_SCHEMA.fields]

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("change", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

HIT_COLUMNS = [
    "path",
    "symbol",
    "kind",
    "lang",
    "start_line",
    "end_line",
    "content",
    "score",
    "rerank_score",
]
