"""Table schemas and default values.

All times are integer Unix seconds (BIGINT), so results never depend on a time
zone.  A *state* table holds one row per (topic, partition) plus, for topics that
must be known even without partitions, one **marker row** with a null partition.
Markers carry ``last_update``; the roll-up by topic then needs no join to a topic
list, and a topic with zero partitions does not vanish.
"""

from pyspark.sql import types as T

# Fixed values of the report surface.
DEFAULT_STALE_DAYS = 7
DEFAULT_UNUSED_DAYS = 30
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
DEFAULT_SHARDS = 6
DEFAULT_HEARTBEAT_INTERVAL_SEC = 30
HEARTBEAT_KEY_PREFIX = "tracker-instance:"
SECONDS_PER_DAY = 86400

# Recommended configuration of the changelog topic.
EXPECTED_CHANGELOG_CONFIG = {
    "cleanup.policy": "compact",
    "segment.ms": "104857600",
    "min.cleanable.dirty.ratio": "0.1",
    "retention.ms": "-1",
    "retention.bytes": "-1",
}

OBSERVATION = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("scan_time", T.LongType()),
    T.StructField("latest", T.LongType()),
    T.StructField("earliest", T.LongType()),
])

LISTING = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("scan_time", T.LongType()),
])

STATE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("is_empty", T.BooleanType()),
    T.StructField("scanned_at", T.LongType()),
    T.StructField("message_count", T.LongType()),
    T.StructField("last_update", T.LongType()),
])
STATE_COLUMNS = STATE.fieldNames()
# What one partition contributes, without its key and the topic-level time.
PARTITION_FIELDS = ["offset", "timestamp", "is_empty", "scanned_at", "message_count"]

CHANGELOG = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

TOPIC_CONFIG = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

CORRUPT = "_corrupt"

# JSON value of a topic record.  ``slice``, ``slices``, ``slice_width`` and ``ranges`` are
# only present on the records of a topic too wide for one record (see operators.codec).
TOPIC_RECORD = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("partitions", T.MapType(T.StringType(), T.StructType([
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("is_empty", T.BooleanType()),
        T.StructField("scanned_at", T.LongType()),
        T.StructField("message_count", T.LongType()),
    ]))),
    T.StructField("slice", T.IntegerType()),
    T.StructField("slices", T.IntegerType()),
    T.StructField("slice_width", T.IntegerType()),
    T.StructField("ranges", T.ArrayType(T.IntegerType())),
    T.StructField(CORRUPT, T.StringType()),
])

HEARTBEAT_RECORD = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("last_heartbeat_at", T.LongType()),
    T.StructField("heartbeat_interval_sec", T.IntegerType()),
    T.StructField("scan_interval_sec", T.IntegerType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("assigned_shards", T.IntegerType()),
    T.StructField(CORRUPT, T.StringType()),
])
HEARTBEAT = T.StructType([f for f in HEARTBEAT_RECORD if f.name not in ("version", CORRUPT)])
