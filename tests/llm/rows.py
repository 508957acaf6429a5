"""Small tables for the corpus tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, extra=None):
    """A documents table; ``extra`` adds string columns of these names, as clashing ones do."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in zip(ids, texts)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in extra or ():
        from pyspark.sql import functions as F
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def by_id(frame, key="doc_id"):
    found = {}
    for row in frame.collect():
        found.setdefault(row[key], []).append(row)
    return found


def jobs(spark, parts, run):
    """What ``run`` returns and how many jobs it takes with so many shuffle partitions, none of them put together."""
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        result = run()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        spark.sparkContext._jsc.clearJobGroup()
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
