"""Stored validity intervals and stored profiles."""

import random

import pytest
from pyspark.sql import functions as F

from quietlog.operators import profile, validity
from tests.folds import fold_scans, of_state
from tests.test_changelog import log, random_records
from tests.test_scans import listing, observations, random_scans


@pytest.mark.parametrize("seed,period", [(51, 1), (52, 7)])
def test_state_at_any_scan(spark, tmp_path, seed, period):
    series, path = random_scans(seed, 9), str(tmp_path / "intervals")
    validity.write_intervals(validity.validity_intervals(observations(spark, series), listing(spark, series)), path, period, series[-1][0])
    for n, (time, _, _) in enumerate(series, 1):
        rows = validity.read_as_of(spark, path, time, period)
        expected = {t: p for t, (_, p) in fold_scans(series[:n]).items() if p}
        assert of_state(rows.withColumn("last_update", F.lit(0))) == expected
    plan = validity.read_as_of(spark, path, series[0][0], period)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan  # only the files of one period are read


def test_profiles_add_up(spark, tmp_path):
    records, path = random_records(17, 300), str(tmp_path / "profiles")
    rng = random.Random(1)
    marks = sorted(rng.sample(range(1, 300), 4))
    for a, b in zip([0, *marks], [*marks, 300]):
        profile.batch_profile(log(spark, records[a:b])).write.mode("append").parquet(path)
    merged = profile.merged_profile(spark.read.parquet(path)).first().asDict()
    exact = profile.changelog_profile(log(spark, records)).first().asDict()
    assert {k: v for k, v in merged.items() if k != "unique_keys"} == {k: exact[k] for k in merged if k != "unique_keys"}
    assert abs(merged["unique_keys"] - exact["unique_keys"]) <= 1
    empty = profile.merged_profile(spark.read.parquet(path).where("false")).first()
    assert empty["total_records"] == 0 and empty["unique_keys"] == 0
