"""Stable shard of a (topic, partition) pair."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 32 bit.
FNV_OFFSET_BASIS = 2166136261
FNV_PRIME = 16777619
UINT32_MASK = 4294967295


def fnv1a_32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as BIGINT in 0 .. 2^32-1."""
    # ISO-8859-1 maps each byte to one character, so the array holds the bytes.
    byte_text = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    digest = F.aggregate(
        F.split(byte_text, ""),
        F.lit(FNV_OFFSET_BASIS).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(UINT32_MASK)),
    )
    return F.when(text == "", F.lit(FNV_OFFSET_BASIS).cast("bigint")).otherwise(digest)


def shard(topic: Column, partition: Column, shard_count: int) -> Column:
    """Shard number, the same one every writer of the log computes (F8)."""
    if shard_count <= 1:
        return F.lit(0)
    identity = F.concat(topic, F.lit("#"), partition.cast("string"))
    return (fnv1a_32(identity) % F.lit(shard_count)).cast("int")


def fast_shard(topic: Column, partition: Column, shard_count: int) -> Column:
    """Faster shard number for jobs that need no agreement with other writers."""
    if shard_count <= 1:
        return F.lit(0)
    return F.pmod(F.xxhash64(topic, partition), F.lit(shard_count)).cast("int")
