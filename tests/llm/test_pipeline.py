import ast
import os

import corpus_pipeline
from quietlog.llm import pii
from tests.llm.test_near_copies import slow_groups

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in frame.collect()}
        path = str(tmp_path / name)
        stage(spark, frame, SF).write.parquet(path)
        frame = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in frame.collect()}
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "simhash":
            ids = sorted(before)
            assert set(after) == {ids[k] for k in slow_groups([before[i]["text"] for i in ids])}
        if name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                base = pii.base_spans(before[i]["text"])
                assert (r["text"] != before[i]["text"]) >= bool(base)
                assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert all(after[i] == before[i] for i in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    assert {r["doc_id"] for r in packed} == set(after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "quietlog")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name)) as file:
                    for node in ast.walk(ast.parse(file.read())):
                        imported = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                        assert not any("llm" in x or "corpus_pipeline" in x for x in imported), name


