"""The fixed log-record schema and the page record (M3)."""

from pyspark.sql import types as T

NAME_CHARS = NAME_BYTES = 63
EVENT_CHARS = EVENT_BYTES = 15
PAGE_BYTES = 4096
PAGE_HEADER_BYTES = 16

LOG_SCHEMA = T.StructType(
    [
        T.StructField("epoch_ms", T.LongType()),
        T.StructField("resource_id", T.LongType()),
        T.StructField("resource_name", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ts_bad", T.BooleanType()),
    ]
)

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.IntegerType()),
        T.StructField("creation_version", T.IntegerType()),
        T.StructField("key_count", T.LongType()),
        T.StructField("is_leaf", T.BooleanType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
