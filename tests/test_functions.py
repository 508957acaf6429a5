"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from quietlog.arguments import Page, Thresholds, positive_int, sort_arguments
from quietlog.functions import ages, liveness, names, offsets, policies, sharding, status

DAY = 86400


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("elapsed,text", [
    (0, "0 seconds"), (1, "1 second"), (86405, "1 day 5 seconds"), (93784, "1 day 2 hours"), (-5, "0 seconds"),
    (-100000, "0 seconds"), (3600, "1 hour"), (7260, "2 hours 1 minute"), (2 * DAY, "2 days"), (61, "1 minute 1 second"),
])
def test_age_text(spark, elapsed, text):
    assert one(spark, ages.age_text(F.lit(elapsed).cast("bigint"))) == text


@pytest.mark.parametrize("elapsed,parts", [
    (93784, (1, 2, 3, 4)), (0, (0, 0, 0, 0)), (-90061, (-1, -1, -1, -1)), (86399, (0, 23, 59, 59)),
])
def test_age_parts(spark, elapsed, parts):
    assert tuple(one(spark, ages.age_parts(F.lit(elapsed).cast("bigint")))) == parts


def test_utc_text_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, ages.utc_text(F.lit(1706659200))) == "2024-01-31T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("newest,oldest,expected,bucket", [
    (30, 30, "unused", 2), (29, 7, "stale", 1), (29, 29, "stale", 1), (6, 6, "active", 0), (0, 6, "active", 0),
])
def test_status(spark, newest, oldest, expected, bucket):
    now = 1_700_000_000
    old, new = (F.lit(now - d * DAY).cast("bigint") for d in (oldest, newest))
    assert one(spark, status.topic_status(old, new, now, 7, 30)) == expected
    assert one(spark, status.status_bucket(old, new, now, 7, 30)) == bucket


def test_status_of_unset_timestamp(spark):
    zero = F.lit(0).cast("bigint")
    assert one(spark, status.topic_status(zero, zero, 1_700_000_000, 7, 30)) == "active"
    assert one(spark, status.status_bucket(zero, zero, 1_700_000_000, 7, 30)) == 2


def test_status_bucket_thresholds(spark):
    now = 1_700_000_000
    stamp = F.lit(now - 12 * DAY).cast("bigint")
    assert one(spark, status.status_bucket(stamp, stamp, now, 7, 30)) == 1
    assert one(spark, status.status_bucket(stamp, stamp, now, 15, 30)) == 0


@pytest.mark.parametrize("latest,earliest,empty,count", [(42, 42, True, 0), (42, 0, False, 42), (5, 9, False, 0), (0, 0, True, 0)])
def test_offsets(spark, latest, earliest, empty, count):
    high, low = F.lit(latest).cast("bigint"), F.lit(earliest).cast("bigint")
    assert one(spark, offsets.is_empty(high, low)) is empty
    assert one(spark, offsets.message_count(high, low)) == count


@pytest.mark.parametrize("age,interval,active", [(0, 30, True), (90, 30, True), (91, 30, False), (90, 0, True), (91, 0, False), (91, -4, False)])
def test_liveness(spark, age, interval, active):
    now = 1_700_000_000
    assert one(spark, liveness.is_active(F.lit(now - age).cast("bigint"), F.lit(interval), now)) is active


def test_never_seen_is_inactive(spark):
    assert one(spark, liveness.is_active(F.lit(0).cast("bigint"), F.lit(2_000_000_000), 5)) is False


@pytest.mark.parametrize("value,expected", [
    ("compact", True), ("compact,delete", True), (" delete, COMPACT ", True), ("delete", False), ("", False), ("\tCompact\n", True)])
def test_has_compact(spark, value, expected):
    assert one(spark, policies.has_compact(F.lit(value))) is expected


def fnv(text):
    digest = 2166136261
    for byte in text.encode():
        digest = ((digest ^ byte) * 16777619) & 0xFFFFFFFF
    return digest


def test_shards(spark):
    assert [one(spark, sharding.shard(F.lit("orders"), F.lit(p), 6)) for p in range(6)] == [3, 4, 1, 2, 1, 2]
    words = ["", "a", "orders#0", "größe", "日本語", "x" * 249, "𝄞"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.h for r in frame.select("w", sharding.fnv1a_32(F.col("w")).alias("h")).collect()} == {w: fnv(w) for w in words}
    assert one(spark, sharding.shard(F.lit("orders"), F.lit(3), 1)) == 0
    spread = spark.range(32).select(sharding.shard(F.lit("orders"), F.col("id").cast("int"), 6).alias("s"))
    assert spread.distinct().count() > 1
    fast = spark.range(100).select(sharding.fast_shard(F.lit("t"), F.col("id"), 6).alias("s")).distinct().collect()
    assert {r.s for r in fast} <= set(range(6))


def matched(spark, predicate, values):
    frame = spark.createDataFrame([(v,) for v in values], "name string")
    return {r.name for r in (frame if predicate is None else frame.where(predicate)).collect()}


def test_name_matcher(spark):
    name, values = F.col("name"), ["orders", "payments", "Orders-x"]
    def match(**args):
        return matched(spark, names.name_matcher(name, **args), values)
    assert match(prefix="Or") == {"Orders-x"}
    assert match(search="ORD") == {"orders", "Orders-x"}
    assert match(search="ORD", regex=True) == set()
    assert match(search="^o.*s$", regex=True) == {"orders"}
    assert match(prefix="  ", search="  ") == set(values)
    assert match(prefix=" pay ", search=" MENT ") == {"payments"}
    assert match(search="a.m") == set()
    with pytest.raises(names.InvalidSearch):
        match(search="(", regex=True)


def test_search_predicate(spark):
    name = F.col("name")
    assert names.search_predicate(name, "   ") is None
    assert matched(spark, names.search_predicate(name, "ÄPF"), ["äpfel", "birne"]) == {"äpfel"}
    assert matched(spark, names.search_predicate(name, "^(?P<kind>ord)"), ["orders", "x-ord"]) == {"orders"}
    assert matched(spark, names.search_predicate(name, "[[:digit:]]$"), ["a1", "b"]) == {"a1"}
    assert matched(spark, names.search_predicate(name, "[a&&b]"), ["&", "b", "c"]) == {"&", "b"}
    assert matched(spark, names.search_predicate(name, "^[*+]$"), ["*", "+", "c"]) == {"*", "+"}
    assert matched(spark, names.search_predicate(name, "^[[x]$"), ["[", "x", "c"]) == {"[", "x"}
    assert matched(spark, names.name_matcher(name, search="(?i)^ä", regex=True), ["Äpfel", "birne"]) == {"Äpfel"}
    assert matched(spark, names.name_matcher(name, search=r"^\Qa.b\E{2}$|[^\d[:alpha:]]{3}", regex=True), ["a.bb", "a.b", "--.", "x"]) == {"a.bb", "--."}
    for bad in ("(", "a(?=b)", "(?<!x)y", r"(a)\1", "a++", "a**", "a{2}{3}", "(?U)a", "(?x)a", r"\R", r"\h", r"\Z", "[a", "\\", "[[:foo:]]"):
        with pytest.raises(names.InvalidSearch):
            names.search_predicate(name, bad)


def test_system_topics(spark):
    assert matched(spark, names.is_system_topic(F.col("name")), ["_a", "__b", "c_", ""]) == {"_a", "__b"}


def test_page_arguments():
    assert (Page.of().number, Page.of().limit, Page.of().offset) == (1, 50, 0)
    assert (Page.of("2", "900").limit, Page.of(2, 900).offset) == (500, 500)
    for page, limit in [(0, None), ("x", None), (None, 0), (None, "abc"), (None, "")]:
        with pytest.raises(ValueError):
            Page.of(page, limit)


def test_threshold_arguments():
    assert Thresholds.of() == Thresholds(7, 30)
    assert Thresholds.of("3", 3) == Thresholds(3, 3)
    with pytest.raises(ValueError, match="unused_days"):
        Thresholds.of(20, 10)
    with pytest.raises(ValueError, match="stale_days"):
        Thresholds.of("bad")
    with pytest.raises(ValueError, match="stale_days"):
        Thresholds.of(0)
    with pytest.raises(ValueError):
        positive_int(1.5, "x")


def test_sort_arguments():
    assert sort_arguments("age", "desc") == ("age", True)
    assert sort_arguments("nothing", "sideways") == ("name", False)
    assert sort_arguments(None, None) == ("name", False)
