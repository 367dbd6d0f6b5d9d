"""Fixed schemas: store tables, extraction envelope and the nested paper record."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

STORE_DOCUMENTS = T.StructType([
    T.StructField("id", S), T.StructField("content", S), T.StructField("source", S),
    T.StructField("embedding_type", S), T.StructField("prompt", S)])

STORE_VECTORS = T.StructType([
    T.StructField("id", S), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

# the vector table: typed and with its source, so that a filter needs no join with the documents
VECTOR_TABLE = T.StructType([
    T.StructField("id", S), T.StructField("source", S), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("embedding_type", S)])

STORE_SOURCES = T.StructType([T.StructField("source", S)])

PROGRESS = T.StructType([T.StructField("source", S), T.StructField("chunks_processed", T.LongType())])

MESSAGE = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", S), T.StructField("text", S)])

# a message with its time, in seconds as text
TIMED_MESSAGE = T.StructType([*MESSAGE.fields, T.StructField("ts", S)])

# Extraction envelope: one JSON line per processed source file. ``content`` is itself a
# JSON string (the paper record); prompt and summary_type are optional on read.
ENVELOPE = T.StructType([
    T.StructField("content", S),
    T.StructField("metadata", T.StructType([
        T.StructField("source_file", S), T.StructField("processed_at", S),
        T.StructField("summary_type", S), T.StructField("prompt", S)])),
    T.StructField("_corrupt", S)])

_AUTHOR = T.StructType([T.StructField("name", S), T.StructField("affiliation", S)])
_JOURNAL = T.StructType([T.StructField("name", S), T.StructField("volume", S), T.StructField("pages", S)])
_METHOD = T.StructType([T.StructField("name", S), T.StructField("type", S), T.StructField("description", S),
                        T.StructField("tools", T.ArrayType(S))])
# value and uncertainty may be a number or a string in the source JSON; a string field
# accepts both.
_DATA = T.StructType([T.StructField("parameter", S), T.StructField("value", S), T.StructField("units", S),
                      T.StructField("uncertainty", S)])
_FINDING = T.StructType([T.StructField("statement", S), T.StructField("type", S), T.StructField("data", _DATA),
                         T.StructField("evidence", S), T.StructField("confidence", S)])
_RELATIONSHIP = T.StructType([T.StructField("type", S), T.StructField("description", S),
                              T.StructField("evidence", S), T.StructField("strength", S)])

PAPER = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("title", S), T.StructField("authors", T.ArrayType(_AUTHOR)), T.StructField("year", S),
        T.StructField("journal", _JOURNAL), T.StructField("doi", S), T.StructField("keywords", T.ArrayType(S))])),
    T.StructField("study", T.StructType([
        T.StructField("location", T.StructType([
            T.StructField("name", S),
            T.StructField("coordinates", T.StructType([T.StructField("lat", T.DoubleType()),
                                                       T.StructField("lon", T.DoubleType())])),
            T.StructField("scale", S),
            T.StructField("time_period", T.StructType([T.StructField("start", S), T.StructField("end", S)]))])),
        T.StructField("objectives", T.ArrayType(S)),
        T.StructField("methods", T.ArrayType(_METHOD))])),
    T.StructField("findings", T.ArrayType(_FINDING)),
    T.StructField("relationships", T.ArrayType(_RELATIONSHIP))])
