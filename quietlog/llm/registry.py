"""Registered queries of the corpus operators, each over a whole table."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quietlog.llm import (
    chat, conversation_repair, decontamination, embeddings, fingerprints, language_model, lexical_search, oracles, packing, pii, quality,
    repeated_passages, token_files, url_rules)
from quietlog.llm.encoding import default_file

Query = Callable[[SparkSession, str], DataFrame]

#: The fixed rules of the url query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return token_files.summary(table(spark, sf_dir, "documents"), default_file("word_bpe_49k.json"), END_ID)


def op3_decontamination(spark, sf_dir):
    found = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_katz(spark, sf_dir):
    return language_model.scores(table(spark, sf_dir, "documents"))


def op5_url_rules(spark, sf_dir):
    index = url_rules.build(url_rules.rule_frame(spark, URL_RULES))
    return url_rules.judge(table(spark, sf_dir, "pages"), index).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark, sf_dir):
    packed = packing.packed(table(spark, sf_dir, "documents"), default_file("byte_bpe_50k.json"), END_ID)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.formatted(rows, default_file("byte_bpe_50k.json")))


def op8_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_pii(spark, sf_dir):
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(rows), rows)


def op12_repeated_passages(spark, sf_dir):
    return repeated_passages.report(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [op1_simhash, op2_token_files, op3_decontamination, op4_katz, op5_url_rules, op6_packing, op7_chat, op8_embeddings, op9_pii, op10_quality,
             op11_conversation_repair, op12_repeated_passages, op13_lexical_search, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
