"""The registered queries over a whole small table, column by column as the contract has them."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from quietlog.llm import registry
from quietlog.llm.encoding import default_file
from tests import compare
from tests.llm import test_embeddings, test_language_model, test_pii
from tests.llm.test_fingerprints import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in registry.queries()[name](spark, SF).collect()}


def ids_of(text, file):
    from tokenizers import Tokenizer
    return [*Tokenizer.from_file(default_file(file)).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    parts = slow_components(prints)
    got = rows(spark, "op1_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_op2(spark, texts):
    got, start = rows(spark, "op2_token_files"), 0
    for i in sorted(texts):
        own = ids_of(texts[i], "word_bpe_49k.json")
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(own), crc(own))
        start += len(own)


def test_op4(spark, texts):
    slow = test_language_model.Slow(list(texts.items()))
    held = 0
    for i, r in rows(spark, "op4_katz").items():
        own = test_language_model.words(texts[i])
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in slow.one for w in own), slow.words.total)
        assert r["base_score"] == pytest.approx(sum(math.log10((slow.one[w] + 1) / (slow.words.total + slow.words.distinct + 1)) for w in own))
        assert r["score"] == pytest.approx(sum(math.log10(slow.chance(h, w)) for h, w in zip([b"\n", *own], own)))
        held += r["held_out"] * (r["score"] - r["base_score"])
    assert held > 0  # better than the base on texts it has not seen


def test_op6(spark, texts):
    found = {}
    for r in registry.queries()["op6_packing"](spark, SF).collect():
        found.setdefault(r["doc_id"], []).append(r)
    sequences = {}
    for i, text in texts.items():
        own = ids_of(text, "byte_bpe_50k.json")
        at = 0
        for k, r in enumerate(sorted(found[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(own[at:at + r["length"]]))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert at == len(own)
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) <= 1024
    total = sum(n for spans in sequences.values() for _, n in spans)
    assert len(sequences) <= 1.02 * math.ceil(total / 1024)


def test_op8(spark):
    source = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert test_embeddings.got(registry.queries()["op8_embeddings"](spark, SF)) == test_embeddings.slow(source)


def test_op9(spark, texts):
    for i, r in rows(spark, "op9_pii").items():
        base = test_pii.slow(texts[i] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_op10(spark, texts):
    got = rows(spark, "op10_quality")
    assert set(got) == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert compare.differences(registry.queries()[name](spark, SF), compare.connect(SF), registry.oracle_sql()[name]) == ""
