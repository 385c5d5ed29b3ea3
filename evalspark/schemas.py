"""Explicit schemas — nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

BANK = T.StructType([
    T.StructField("question_ref", S),
    T.StructField("question_text", S),
    T.StructField("expected_answer", S),
    T.StructField("image_urls", T.ArrayType(S)),
    T.StructField("map_count", S),
    T.StructField("spatial_relationship", S),
    T.StructField("answer_type", S),
    T.StructField("contextual_urls", T.ArrayType(S)),
])

# The annotation export: every column read as text, then typed (schema
# evolution is handled after the read, see sources.annotations).
ANNOTATION_COLUMNS = [
    "question_ref", "id", "answer", "timestamp", "user_id", "necessary", "validity",
    "map_count", "question_text", "spatial_relationship", "noinfo_reason",
    "expected_answer", "count",
]

ANNOTATION = T.StructType([
    T.StructField("question_ref", S), T.StructField("id", T.LongType()),
    T.StructField("answer", S), T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", S), T.StructField("necessary", S),
    T.StructField("validity", S), T.StructField("map_count", S),
    T.StructField("question_text", S), T.StructField("spatial_relationship", S),
    T.StructField("noinfo_reason", S), T.StructField("expected_answer", S),
    T.StructField("count", T.IntegerType()),
])

# One form post (the streaming source of R1).
SUBMISSION = T.StructType([
    T.StructField("user", S), T.StructField("question_ref", S),
    T.StructField("question_text", S), T.StructField("map_count", S),
    T.StructField("spatial_relationship", S), T.StructField("answer", S),
    T.StructField("validity", S), T.StructField("necessary", S),
    T.StructField("noinfo_reason", S), T.StructField("timestamp", T.TimestampType()),
])

ROSTER = T.StructType([T.StructField("user_id", S), T.StructField("user_name", S)])

BATCH_REQUEST = T.StructType([
    T.StructField("key", S),
    T.StructField("request", T.StructType([
        T.StructField("system_instruction", T.StructType([
            T.StructField("parts", T.ArrayType(T.StructType([T.StructField("text", S)])))])),
        T.StructField("contents", T.ArrayType(T.StructType([
            T.StructField("text", S),
            T.StructField("file_data", T.StructType([
                T.StructField("file_uri", S), T.StructField("mime_type", S)])),
        ]))),
    ])),
])

BATCH_RESULT = T.StructType([
    T.StructField("key", S),
    T.StructField("response", T.StructType([T.StructField("text", S)])),
    T.StructField("error", S),
])
