import random
import zlib

import numpy as np
import pytest

from quietlog.llm import encoding, packing, token_files
from quietlog.llm.url_rules import open_store
from tests.llm.rows import by_id, docs

FILES = [encoding.default_file(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")]
ODD = ["", " ", "a  b", "a \n b", "x\t y", "it's 5 o'clock  ", "|", "a | b|c", "e\u0301\u0301 \u0301x", "<|endoftext|> a", " lead", "trail ",
       "a\u00a0 b", "a\u3000b c", "!\x1c? x", "'s t 's", "x 's\n\n y", " \nfoo\nbar baz", "İstanbul ΣΣ xΣ", "1234 5", "x\u200b y", "w" * 50_000]


@pytest.mark.parametrize("file", FILES)
def test_encoder_equals_the_library(file):
    rng = random.Random(1)
    texts = ODD + [rng.choice(["", " ", "\n"]).join(rng.choices(ODD[:-1], k=5)) for _ in range(300)]
    code = encoding.Encoder(file)
    for _ in range(2):
        ids, counts = code.encode(texts)
        parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        assert parts == [e.ids for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(code.encode([])[0]) == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, 1000) == ids).all()
    assert len(token_files.pack_bits(np.zeros(0, np.int64), bits)) == 0


def expected_ids(text, file):
    return [*encoding.Encoder(file).tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 3_000)
    rng = random.Random(2)
    texts = [None, *ODD, *(" ".join(rng.choices(["the", "of", "Thanor", "x1"], k=rng.randint(0, 900))) for _ in range(60))]
    ids = [None, *rng.sample(range(-50, 10_000), len(texts) - 2), 3]
    frame = docs(spark, texts, ids, extra=["start", "ids"])
    got = token_files.summary(frame, FILES[0], 2).collect()
    start = 0
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: (r["start"])), sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0]))):
        own = expected_ids(text, FILES[0])
        assert tuple(row) == (doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(got) == len(texts)
    folder, manifest = token_files.write(frame, FILES[0], 2)
    store, base = open_store(folder)
    row = manifest.orderBy("file").first()
    source = token_files.TokenFile(store, f"{base}/{row['file']}")
    everything = source.ids(0, source.tokens)
    assert source.bits == 16 and source.tokens == row["tokens"]
    for k in rng.sample(range(source.documents), min(5, source.documents)):
        begin = int(source.ends[k - 1]) if k else 0
        assert (source.document(k) == everything[begin:source.ends[k]]).all()
    assert token_files.summary(docs(spark, []), FILES[0], 2).count() == 0


def test_one_doc_id_may_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2_000)
    frame = docs(spark, ["the of the of " * 10] * 200, [7] * 190 + list(range(10)))
    folder, manifest = token_files.write(frame, FILES[0], 2)
    assert manifest.count() > 5 and max(r["documents"] for r in manifest.collect()) < 100
    rows = sorted(token_files.read(spark, folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_repeated_doc_ids_lie_together(spark):
    rows = token_files.summary(docs(spark, ["a b", "c", "d e f", "c"], [4, 1, 4, 1]), FILES[0], 2).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [1, 1, 4, 4]


def check_plan(histogram, planned, size):
    used = {}
    for lengths, times in planned:
        assert sum(lengths) <= size and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in histogram.items() if v}


def test_plans_use_up_every_histogram():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([4, 8, 16, 32])
        histogram = {k: rng.choice([0, 0, 1, 7, 1000]) for k in range(1, size + 1)}
        for most in (0, 1, 2, 3):
            check_plan(histogram, packing.plan_with(histogram, size, most), size)
        check_plan(histogram, packing.plan(histogram, size), size)
    exact = {1000: 5, 24: 5, 600: 4, 300: 4, 124: 4, 512: 6}
    assert sum(times for _, times in packing.plan(exact)) == 12
    assert packing.plan({}) == []


def test_packed_documents(spark):
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choices(["the", "of", "Thanor", "x1"], k=rng.choice([0, 3, 50, 400, 1023, 3000]))) for _ in range(80)), "the " * 20_000]
    ids = [*range(len(texts) - 2), None, 0]
    frame = docs(spark, texts, ids, extra=["row", "length", "piece"])
    got = packing.packed(frame, FILES[1], 2).collect()
    sequences, owners = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4096
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        owners.setdefault(r["doc_id"], []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 1024 + 1
    for doc_id, text in list(zip(ids, texts))[1:-2]:
        own = sorted(owners[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == expected_ids(text, FILES[1])
    assert packing.packed(docs(spark, []), FILES[1], 2).count() == 0
