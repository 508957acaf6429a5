"""Benchmark decontamination with an FM-index per shard of documents.

A task reads its documents in shards of bounded size, builds the index of a shard in memory,
and searches all benchmark windows in it at once: backward search over the ranks of a
wavelet matrix, positions from sampled suffixes.  Nothing is shuffled and no document is
compared with another.
"""

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import ranges, slices, texts

WINDOW = 13
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: A row whose text position is a multiple of this keeps the position.
SAMPLE = 8
#: Benchmarks are held by every task; a larger table is refused.
BENCHMARK_BYTES = 256 << 20
#: Word bytes keep their value (A-Z lower-cased), all others become a space.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Wavelet:
    """Ranks of symbols by bit vectors, the highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[:len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(len(bit) - int(ones.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before position ``at``."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & below).astype(np.int64)

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``at``."""
        return self._descend(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order, by doubling; each zero is an end of its own, in text order."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + int(zero.sum()))
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ranked = rank[order]
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        place = np.cumsum(new)  # from 1: 0 stands for the end of the text
        rank = np.empty(n, np.int64)
        rank[order] = place
        if n == 0 or place[-1] == n:
            return order
        # only suffixes that still tie are ordered anew, each inside its group
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        suffixes = order[where]
        ahead = suffixes + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        again = np.argsort(rank[suffixes] * (n + 1) + second, kind="stable")
        order[where] = suffixes[again]
        key = rank * (n + 1)
        key[suffixes] += second
        rank, width = key, 2 * width


class FmIndex:
    """Index of word numbers 1.. with 0 for any word that no phrase has."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        before = symbols[order - 1]  # of the first suffix: the last symbol, a zero by construction
        self.size = len(symbols)
        self.wavelet = Wavelet(before.astype(np.int64), max(1, int(top).bit_length()))
        counts = np.bincount(symbols, minlength=(1 << self.wavelet.bits) + 1)
        self.before = np.cumsum(counts) - counts  # symbols smaller than each
        # The walk to a sampled row never passes a zero: what follows one is sampled too.
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.index = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (rows of ``phrases``, padded behind ``lengths``), last word first."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled one and add the steps."""
        found = np.zeros(len(rows), np.int64)
        open_ones, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_ones):
            done = self.sampled[at]
            found[open_ones[done]] = self.positions[self.index[at[done]]] + steps
            open_ones, at = open_ones[~done], at[~done]
            if len(at):
                symbol, rank = self.wavelet.access(at)
                at = self.before[symbol] + rank
                steps += 1
        return found


class Phrases:
    """All windows of a benchmark, with the items that each belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        listed = [(item, words(text or "")) for item, text in items]
        self.numbers = {w: k for k, w in enumerate(sorted({w for _, ws in listed for w in ws}), 1)}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, ws in listed:
            ids = [self.numbers[w] for w in ws]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i:i + window])].add(item)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.matrix = np.zeros((len(owners), window), np.int64)
        for row, phrase in enumerate(owners):
            self.matrix[row, :len(phrase)] = phrase
        self.owners = [list(x) for x in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0


def _shard(phrases: Phrases, counts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """(which words are hit, items that occur by document) of the documents with ``counts`` words."""
    hit = np.zeros(len(symbols), bool)
    items: dict[int, set] = defaultdict(set)
    if not len(phrases.owners):
        return hit, items
    # Zeros end phrases, and so do document ends; runs that are too short for any phrase are left out.
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = symbols > 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (owner[1:] != owner[:-1])])) if len(symbols) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & np.concatenate([~inside[1:] | (owner[1:] != owner[:-1]), [True]])) + 1 if len(symbols) else starts
    long = stops - starts >= phrases.shortest
    starts, sizes = starts[long], (stops - starts)[long]
    if not len(starts):
        return hit, items
    places = ranges(starts, sizes)
    text = np.zeros(len(places) + len(starts), np.int64)
    origin = np.zeros(len(text), np.int64)
    kept = np.arange(len(places)) + np.repeat(np.arange(len(starts)), sizes)  # a zero behind each run
    text[kept], origin[kept] = symbols[places], places
    index = FmIndex(text, len(phrases.numbers))
    low, high = index.search(phrases.matrix, phrases.lengths)
    found = np.repeat(np.arange(len(low)), high - low)
    at = origin[index.locate(ranges(low, high - low))]
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.lengths[found], -1)
    hit = np.cumsum(edges[:-1]) > 0
    for pair in np.unique(owner[at] * len(low) + found):
        doc, phrase = divmod(int(pair), len(low))
        items[doc].update(phrases.owners[phrase])
    return hit, items


SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items array<long>, spans array<struct<start:long,end:long>>, "
          "items_sha256 string, contaminated boolean")


def held_phrases(benchmark: DataFrame, window: int) -> Phrases:
    """The benchmark's windows on the driver; its size is checked first."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes is too large to be held by every task")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).collect()
    return Phrases([(r[0], r[1]) for r in rows], window)


def _search(phrases: Phrases, batch: pa.RecordBatch):
    """(words, hit words, hit flags of all words, items by document) of one batch."""
    get = phrases.numbers.get
    parts = []
    for text in texts(batch):
        own = words(text)
        parts.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    hit, items = _shard(phrases, counts, np.concatenate(parts) if parts else np.zeros(0, np.int64))
    hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(counts)])])
    return counts, hits, hit, items


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: hit words, items that occur, merged removal spans (in words).

    ``contaminated``: some word is hit, and the hit words are a twentieth of all or more.  A null or
    empty text has no words and is clean.  Items without words have no window; items with a null
    item_id count as hits but are not listed.  Equal item_ids count as one item.  Documents come out
    one by one as they come in, repeated rows included.
    """
    phrases = held_phrases(benchmark, window)

    def run(batches):
        for batch in slices(batches, SHARD_BYTES):
            counts, hits, hit, items = _search(phrases, batch)
            ends = np.cumsum(counts)
            spans, listed = [], []
            for i, n in enumerate(hits):
                if n:
                    own = np.concatenate([[False], hit[ends[i] - counts[i]:ends[i]], [False]])
                    turns = np.flatnonzero(own[1:] != own[:-1])
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])])
                else:
                    spans.append([])
                listed.append(sorted((x for x in items.get(i, ()) if x is not None), key=str))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts), pa.array(hits),
                pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.int64())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in listed]),
                pa.array((hits > 0) & (20 * hits >= counts)),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that ``judge`` calls contaminated, all columns as they are.

    Documents are dropped whole; one whose hit words are fewer than a twentieth stays
    unchanged.  Each row is judged by its own text, whatever its doc_id.
    """
    phrases = held_phrases(benchmark, window)

    def run(batches):
        for batch in slices(batches, SHARD_BYTES):
            counts, hits, _, _ = _search(phrases, batch)
            yield batch.filter(pa.array((hits == 0) | (20 * hits < counts)))

    return docs.mapInArrow(run, docs.schema)
