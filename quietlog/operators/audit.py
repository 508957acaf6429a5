"""Comparison of topic configurations with the recommended ones."""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.functions.policies import has_compact
from quietlog.schema import EXPECTED_CHANGELOG_CONFIG

_POLICY = "cleanup.policy"


def config_findings(configs: DataFrame, expected: Mapping[str, str] = EXPECTED_CHANGELOG_CONFIG,
                    topics: DataFrame | None = None) -> DataFrame:
    """(topic, name, severity, problem, actual, recommended), one row per finding.

    A clean-up policy that is missing or lacks ``compact`` is an error, and a topic with
    the error gets no warnings.  The expected keys are pivoted to columns by one
    aggregation.  ``topics`` lists all topics, so that those without any configuration are
    reported too; without it only the topics of ``configs`` are seen.
    """
    names = [_POLICY, *sorted(name for name in expected if name != _POLICY)]
    if topics is not None:
        configs = configs.select("topic", "name", "value").unionByName(topics.select("topic"), allowMissingColumns=True)
    by_topic = configs.groupBy("topic").agg(*[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(f"c{i}") for i, name in enumerate(names)])
    policy = F.col("c0")

    def finding(name, severity, problem, actual):
        return F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), problem.alias("problem"),
                        actual.alias("actual"), F.lit(expected.get(name, "compact")).alias("recommended"))

    error = F.when(policy.isNull(), finding(_POLICY, "error", F.lit("not set"), policy)).when(
        ~has_compact(policy), finding(_POLICY, "error", F.lit("not compacted"), policy))
    warnings = []
    for i, name in enumerate(names[1:], start=1):
        actual = F.col(f"c{i}")
        problem = F.when(actual.isNull(), F.lit("not set")).otherwise(F.lit("mismatch"))
        warnings.append(F.when(actual.isNull() | (actual != expected[name]),
                               finding(name, "warning", problem, actual)))
    findings = F.when(error.isNotNull(), F.array(error)).otherwise(F.array_compact(F.array(*warnings)))
    return by_topic.select("topic", F.explode(findings).alias("finding")).select("topic", "finding.*")
