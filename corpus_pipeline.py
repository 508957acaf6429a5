"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read
again as the docs of the next one.  All but the last return the columns of documents.
Texts are long, so a stage sets the session to Arrow batches of few rows: what a task holds of them follows their size.
"""

from pyspark.sql import DataFrame, SparkSession

from quietlog.llm import decontamination, fingerprints, packing, pii, quality
from quietlog.llm.encoding import default_file
from quietlog.session import scratch_dir

END_ID = 2
#: Rows of an Arrow batch; Spark's 10,000 are some 30 MB of documents on either side of each worker.
BATCH_ROWS = 2000
#: Pieces of text that a worker keeps while packing; all workers of the stages before take part in it.
PACKING_PIECES = 100_000


def _few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    _few_rows(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash on the popcount grid proposes, a prefix filter finds the rest, whole sets decide."""
    _few_rows(spark)
    return fingerprints.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    _few_rows(spark)
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    _few_rows(spark)
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences."""
    _few_rows(spark)
    packed = packing.packed(docs, default_file("byte_bpe_50k.json"), END_ID, kept=PACKING_PIECES)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("simhash", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A classifier, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
