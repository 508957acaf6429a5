"""Removal of byte strings that occur more than once, by prefix-free parsing (operator 12).

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Texts are parsed into
phrases at the places where a rolling hash of eight bytes is small (triggers), so equal strings are parsed alike
wherever they stand.  A string is then a suffix of one phrase, whole phrases, and a prefix of another.  What is
compared is the parse: all strings with the same first and last trigger form one member (its phrases and its
text are one digest each), and equal members are found by grouping.  A count of the whole phrases alone comes first,
as most of them occur once and their strings are settled by that.  Only where the same whole
phrases stand beside different ones are the suffixes and prefixes themselves compared, string by string.
As equality up to ``length`` bytes is all that counts, positions are put into classes by digests of
128 bits instead of into one sorted order.

Most text is never parsed: the eight bytes of least hash in every string, with the bytes around them
(a quarter of the string), must occur twice for the string to be repeated, which one count over the corpus tells.

Texts that occur more than once as a whole are parsed once and removed whole.  What one task holds is a batch of
texts and the spans of one text; counts are summed in the map tasks, and equal keys meet only as sums.

Cases: a null text is empty; every row is a text of its own, repeated rows and null ids included; texts
shorter than ``length`` lose nothing; empty tables give empty results; other columns are not looked at.
Matches never cross texts.  Cuts go by bytes and may split a character.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import column, ranges, slices
from quietlog.sources.tables import materialise

LENGTH = 400
#: A trigger every so many bytes on average.
PHRASE = 40
_HASHED = 8
_STEP_BYTES = 1 << 20
_SPAN = np.dtype([("first", "<i8"), ("last", "<i8")])


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the eight bytes from every position on, as 64-bit numbers."""
    if len(data) < _HASHED:
        return np.zeros(0, np.uint64)
    held = data.astype(np.uint64)
    for shift in (1, 2, 4):
        held = held[:-shift] | (held[shift:] << np.uint64(8 * shift))
    held *= np.uint64(0x9E3779B97F4A7C15)
    held ^= held >> np.uint64(32)
    held *= np.uint64(0xD6E8FEB86659FD93)
    return held >> np.uint64(32)


def _least(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = size - width
    return np.minimum(keys[:len(keys) - rest], keys[rest:]) if rest else keys


def anchors(texts: list[bytes], length: int):
    """For runs of strings with the same eight bytes of least hash: (text number, first, last string, digest of their surroundings)."""
    gram = max(_HASHED, length // 4)
    left = (gram - _HASHED) // 2
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return [np.zeros(0, np.int64)] * 4
    whole = b"".join(texts)
    hashes = rolling(np.frombuffer(whole, np.uint8))
    keys = (hashes << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    least = _least(keys, length - gram + 1)
    starts = ranges(base, counts)
    own = np.repeat(np.arange(len(texts)), counts)
    places = (least[starts + left] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (own[1:] != own[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    own = own[new]
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(whole[p - left:p - left + gram]) for p in places[new].tolist()), np.uint64, len(new)).view(np.int64)
    return own, starts[new] - base[own], starts[last] - base[own], digests


def _columns(names: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(names.values()), list(names))


def _digests(pieces) -> np.ndarray:
    """128-bit digests as rows of two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)


def _batches(batches, name="text"):
    for batch in slices(batches, _STEP_BYTES, name):
        yield batch, column(batch, name)


def _prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, body, digest): the bytes of each text and their digest, which stands for the text from here on."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body")).withColumn("digest", F.unhex(F.md5("body")))


def _candidates(texts: DataFrame, length: int) -> DataFrame:
    """(c, digest, packed, strings): one row per distinct text with strings that may be repeated, and these as spans."""
    def count(batches):
        for _, own in _batches(batches, "body"):
            found, many = np.unique(anchors(own, length)[3], return_counts=True)
            yield _columns({"anchor": pa.array(found), "n": pa.array(many.astype(np.int64))})

    def place(batches):
        for batch, own in _batches(batches, "body"):
            number, _, _, found = anchors(own, length)
            pairs = np.unique(np.stack([number, found]), axis=1)
            keys = np.asarray(batch.column(1))
            yield _columns({"anchor": pa.array(pairs[1]), "text_key": pa.array(keys[pairs[0]] if len(keys) else keys)})

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch, own in _batches(batches, "body"):
            yield _columns({"doc_id": batch.column(0), "digest": batch.column(1), "packed": pa.array([packer.compress(x) for x in own], pa.binary())})

    def choose(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            packed, known = column(batch, "packed"), column(batch, "anchors")
            kept, spans = [], []
            for i, (data, wanted) in enumerate(zip(packed, known)):
                _, first, last, found = anchors([unpacker.decompress(data)], length)
                hit = np.isin(found, np.array(wanted, np.int64))
                if hit.any():
                    first, last = first[hit], last[hit]
                    gap = np.flatnonzero(first[1:] != last[:-1] + 1)
                    both = np.empty(len(gap) + 1, _SPAN)
                    both["first"], both["last"] = first[np.concatenate([[0], gap + 1])], last[np.concatenate([gap, [len(last) - 1]])]
                    kept.append(i)
                    spans.append(both.tobytes())
            held = batch.take(pa.array(kept, pa.int64()))
            yield _columns({"digest": held.column(0), "copies": held.column(1), "packed": held.column(2), "strings": pa.array(spans, pa.binary())})

    # Texts too short for a string are not looked at again.
    texts = texts.where(F.length("body") >= length)
    twice = materialise(
        texts.select("body").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"),
        "passages-anchors")
    # These keys of 64 bits only choose what is looked at; two texts with the same key get each other's anchors too.
    placed = texts.select("body", F.xxhash64("digest").alias("text_key")).mapInArrow(place, "anchor long, text_key long")
    lists = placed.join(twice, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))
    distinct = texts.select("digest", "doc_id").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one")).withColumn("text_key", F.xxhash64("digest"))
    wanted = distinct.join(lists, "text_key").select("digest", "copies", "one", "anchors")
    packed = texts.select("doc_id", "digest", "body").mapInArrow(pack, "doc_id long, digest binary, packed binary")
    chosen = packed.join(wanted, "digest").where(F.col("doc_id").eqNullSafe(F.col("one"))).select("digest", "copies", "packed", "anchors")
    found = chosen.mapInArrow(choose, "digest binary, copies long, packed binary, strings binary")
    return materialise(found.withColumn("c", F.monotonically_increasing_id()), "passages-texts")


def _runs(data: bytes, strings: bytes, length: int, phrase: int):
    """(first, last, inner): runs of the given strings with the same first and last trigger.

    ``inner`` is a digest of the bytes from the first to the last trigger.  A string without a trigger is a run of its
    own, with its own digest.
    """
    spans = np.frombuffer(strings, _SPAN)
    at = ranges(spans["first"], spans["last"] - spans["first"] + 1)
    triggers = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) < np.uint64((1 << 32) // phrase))
    low = np.searchsorted(triggers, at)
    high = np.searchsorted(triggers, at + length - _HASHED, "right") - 1
    bare = low > high
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | bare[1:]])
    begin = np.flatnonzero(new)
    first, last = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1]
    start, end = first.copy(), first + length
    phrased = begin[~bare[begin]]
    start[~bare[begin]], end[~bare[begin]] = triggers[low[phrased]], triggers[high[phrased]] + _HASHED
    digest = xxhash.xxh3_64_intdigest
    inner = np.fromiter((digest(data[x:y]) for x, y in zip(start.tolist(), end.tolist())), np.uint64, len(first)).view(np.int64)
    return first, last, inner


def _shared_phrases(candidates: DataFrame, length: int) -> DataFrame:
    """(c, inners): for each text the ``inner`` digests of its runs that occur more than once in the corpus.

    Any other run holds no repeated string, and its bytes need no digest.
    """
    def parse(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, packed, strings in zip(*(column(batch, n) for n in ("c", "packed", "strings"))):
                inner, many = np.unique(_runs(unpacker.decompress(packed), strings, length, PHRASE)[2], return_counts=True)
                yield _columns({"inner": pa.array(inner), "weight": pa.array(np.minimum(many, 2)), "c": pa.array(np.full(len(inner), c))})
    found = materialise(candidates.select("c", "packed", "strings").mapInArrow(parse, "inner long, weight long, c long"), "passages-phrases")
    twice = materialise(found.groupBy("inner").agg(F.sum("weight").alias("n")).where("n > 1").select("inner"), "passages-shared")
    return found.select("inner", "c").join(twice, "inner").groupBy("c").agg(F.collect_list("inner").alias("inners"))


def _members(candidates: DataFrame, length: int) -> DataFrame:
    """(inner, hi, lo, weight, c, first, last): runs of strings whose phrases occur more than once.

    ``hi`` and ``lo`` are a digest of all bytes of the run.  Where a text repeats a run itself, one row
    stands for it and rows without digests tell the other places.
    """
    def parse(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, packed, strings, inners in zip(*(column(batch, n) for n in ("c", "packed", "strings", "inners"))):
                data = unpacker.decompress(packed)
                first, last, inner = _runs(data, strings, length, PHRASE)
                shared = np.isin(inner, np.array(inners, np.int64))
                first, last, inner = first[shared], last[shared], inner[shared]
                whole = _digests([data[a:b + length] for a, b in zip(first.tolist(), last.tolist())])
                # Equal runs stand side by side in this order, the first of the text at their head.
                order = np.lexsort((last - first, whole[:, 1], whole[:, 0]))
                kinds = np.column_stack([whole, last - first])[order]
                ahead = np.concatenate([[True], (kinds[1:] != kinds[:-1]).any(axis=1)])
                head, twin = np.zeros(len(first), bool), np.zeros(len(first), bool)
                head[order[ahead]] = True
                twin[order] = ~(ahead & np.append(ahead[1:], True))
                yield _columns({
                    "inner": pa.array(inner[head]), "hi": pa.array(whole[head, 0]), "lo": pa.array(whole[head, 1]),
                    "weight": pa.array(1 + twin[head].astype(np.int64)), "c": pa.array(np.full(head.sum(), c)),
                    "first": pa.array(first[head]), "last": pa.array(last[head])})
                first, last = first[twin & ~head], last[twin & ~head]
                if len(first):
                    gap = np.flatnonzero(first[1:] != last[:-1] + 1)
                    first, last = first[np.concatenate([[0], gap + 1])], last[np.concatenate([gap, [len(last) - 1]])]
                    none = pa.nulls(len(first), pa.int64())
                    yield _columns({"inner": none, "hi": none, "lo": none, "weight": none, "c": pa.array(np.full(len(first), c)),
                                    "first": pa.array(first), "last": pa.array(last)})
    found = candidates.select("c", "packed", "strings").join(_shared_phrases(candidates, length), "c").mapInArrow(
        parse, "inner long, hi long, lo long, weight long, c long, first long, last long")
    return materialise(found, "passages-members")


def _single_strings(candidates: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(hi, lo, weight, c, at) of every string of the given runs, without c where it is known to be repeated."""
    def compare(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, packed, own in zip(*(column(batch, n) for n in ("c", "packed", "runs"))):
                data = unpacker.decompress(packed)
                first, last, known = (np.array([r[n] for r in own]) for n in ("first", "last", "known"))
                sizes = last - first + 1
                at, known = ranges(first, sizes), np.repeat(known, sizes)
                found = _digests([data[a:a + length] for a in at.tolist()])
                yield _columns({"hi": pa.array(found[:, 0]), "lo": pa.array(found[:, 1]), "weight": pa.array(1 + known.astype(np.int64)),
                                "c": pa.array(np.full(len(at), c), mask=known), "at": pa.array(at)})
    lists = runs.groupBy("c").agg(F.collect_list(F.struct("first", "last", "known")).alias("runs"))
    found = candidates.select("c", "packed").join(lists, "c").mapInArrow(compare, "hi long, lo long, weight long, c long, at long")
    return materialise(found, "passages-strings")


def _repeated(candidates: DataFrame, length: int) -> DataFrame:
    """(c, first, last): all strings that are repeated, as spans of their first bytes."""
    members = _members(candidates, length)
    whole = members.where("inner is not null")
    key = ["inner", "hi", "lo"]
    distinct = materialise(whole.groupBy(*key).agg(
        F.sum("weight").alias("n"), F.min(F.struct("c", "first", "last")).alias("one")), "passages-distinct")
    alike = whole.select(*key, "c", "first", "last").join(distinct.where("n > 1").select(*key), key)
    # The same whole phrases beside different ones: here the ends of the strings decide.
    mixed = distinct.groupBy("inner").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("inner")
    open_runs = distinct.join(mixed, "inner").select("one.*", (F.col("n") > 1).alias("known"))
    strings = _single_strings(candidates, open_runs, length)
    twice = strings.groupBy("hi", "lo").agg(F.sum("weight").alias("n")).where("n > 1").select("hi", "lo")
    single = strings.where("c is not null").join(twice, ["hi", "lo"])
    spans = ["c", "first", "last"]
    return members.where("inner is null").select(*spans).unionByName(alike.select(*spans)).unionByName(
        single.select("c", F.col("at").alias("first"), F.col("at").alias("last")))


def _cut(candidates: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(digest, n_removed, n_spans, kept) of texts that lose something."""
    def remove(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for digest, packed, own in zip(*(column(batch, n) for n in ("digest", "packed", "spans"))):
                data = np.frombuffer(unpacker.decompress(packed), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in own], 1)
                np.add.at(edge, [s["last"] + length for s in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                yield _columns({"digest": pa.array([digest], pa.binary()), "n_removed": pa.array([int(gone.sum())]),
                                "n_spans": pa.array([runs]), "kept": pa.array([data[~gone].tobytes()], pa.binary())})
    lists = spans.groupBy("c").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return candidates.where("copies = 1").select("c", "digest", "packed").join(lists, "c").mapInArrow(
        remove, "digest binary, n_removed long, n_spans long, kept binary")


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, n_removed, n_spans, kept): what is left of each distinct text that loses something; ``digest`` is its md5."""
    texts = _prepared(docs)
    candidates = _candidates(texts, length)
    copied = texts.where(F.length("body") >= length).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.length("body")).cast("bigint").alias("n_removed")).where("copies > 1")
    whole = copied.select("digest", "n_removed", F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    return _cut(candidates, _repeated(candidates, length), length).unionByName(whole)


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    own = _prepared(docs).select("doc_id", "digest", F.length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("sha256"))
    cuts = cut_texts(docs, length).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return own.join(materialise(cuts, "passages-cuts"), "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
