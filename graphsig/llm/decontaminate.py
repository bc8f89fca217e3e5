"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming, exact check.

Words are lower-cased and split at ASCII white space and punctuation; in scripts written without
spaces each character is a word. Each item of the benchmark gets
its multiset of five-word shingles and a SimHash in which a shingle weighs log(1 + items / items that
hold it), so text that many items share counts less. A document is cut into windows as long as the
item, at every position. Their SimHashes come from running sums of the shingles' weighted bits.
A window is a candidate of an item at ``radius`` or fewer differing bits. The index has 16 blocks of 4
bits: two fingerprints within 31 bits differ by at most one bit in some block, so looking up each
block with its one-bit neighbours finds all in reach. Candidates are verified by the exact weighted
similarity of the two multisets (twice the shared weight over the sum of both weights).

Windows without any shingle of the benchmark have similarity zero, so they need no fingerprint: a bit
table of the items' shingles skips them. Documents stream through Arrow batches without a shuffle.
The benchmark is read in blocks of at most ``block_words`` words, each broadcast by itself.

Items of fewer than five words have no such shingle: their whole word sequence is one shingle of its own
length, and a document holds them where it has the same words in a row.

Edge cases: null and empty texts match nothing; a document shorter than an item is one window; repeated items and rows are reported
each; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
BLOCK_WORDS = 2_000_000
#: Windows whose sums are held at once, and pairs of a window and an item compared at once.
STRETCH, LOOKUPS = 1 << 13, 1 << 21
#: Bits of the table of shingles that some item of the block holds, and of the table of how many
#: items of the whole benchmark hold a shingle (a fixed size, shared by all blocks).
TABLE_BITS, SHARE_BITS = 20, 22
MATCH_SCHEMA = "doc_id long, item_id long, start long, n_words long, distance int, similarity double"
#: ASCII punctuation, control characters and white space separate words.
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
#: Letters of scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
#: Their punctuation and wide space.
_WIDE = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: Bytes hashed at a time; an odd factor and its inverse modulo 2**64, and their powers.
SEGMENT, FACTOR = 1 << 18, 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            steps = np.full(SEGMENT + 1, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: polynomials of their bytes from running sums, then mixed, so no
    word becomes an object. Long texts go by segments that end between words."""
    text = (text or "").lower()
    if not text.isascii():
        text = _WIDE.sub(" ", _UNSPACED.sub(r" \1 ", text))
    raw = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    if len(raw) <= SEGMENT:
        return _segment_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SEGMENT else raw.rfind(b" ", at, at + SEGMENT) + 1
        if end <= at:  # one word longer than a segment is hashed by itself
            end = raw.find(b" ", at)
            end = len(raw) if end < 0 else end
            parts.append(np.array([xxhash.xxh64_intdigest(raw[at:end])], dtype=np.uint64))
        else:
            parts.append(_segment_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _segment_hashes(raw: bytes) -> np.ndarray:
    letters = np.frombuffer(raw, dtype=np.uint8)
    inside = np.empty(len(letters) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(letters, 32, out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverse = _powers()
    sums = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(letters * powers[: len(letters)], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * inverse[begin])


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of ``size`` words in a row: a polynomial of word hashes, then mixed."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(FACTOR) + words[i : i + n]
    return _mix(h)


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, 64): a shingle's weight where its bit is one, else the weight less than nothing. Sums of a stretch
    stay far below 32 bits."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    bits *= 2
    bits -= 1
    bits *= weights.astype(np.int32)[:, None]
    return bits


def to_fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).reshape(-1)


class Benchmark:
    """The index of one block of items; ``items`` has (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], shares: np.ndarray, total: int, radius: int = RADIUS, similarity: float = SIMILARITY):
        if radius > 31:
            raise ValueError("the index finds all fingerprints within 31 bits")
        self.radius, self.similarity = radius, similarity
        self.shares, self.total = shares, total
        words = [(i, word_hashes(t)) for i, t in items]
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: items by their one shingle
        for i, w in words:
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(shingle_hashes(w, len(w))[0]), []).append(i)
        hashes = [(i, shingle_hashes(w)) for i, w in words if len(w) >= SHINGLE]
        self.ids = [i for i, _ in hashes]
        self.bags = [Counter(h.tolist()) for _, h in hashes]
        self.sets = [np.unique(h) for _, h in hashes]
        self.totals = [int(self.weights(h).sum()) for _, h in hashes]
        self.known = np.unique(np.concatenate([h for _, h in hashes])) if hashes else np.empty(0, dtype=np.uint64)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.known >> np.uint64(64 - TABLE_BITS)] = True
        self.holders: dict[int, set[int]] = {}
        for k, (_, h) in enumerate(hashes):
            for x in set(h.tolist()):
                self.holders.setdefault(x, set()).add(len(h))
        fps = [to_fingerprints(signs(h, self.weights(h)).sum(axis=0)[None, :])[0] for _, h in hashes]
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by number of shingles
        for n in {sum(b.values()) for b in self.bags}:
            own = np.array([k for k, b in enumerate(self.bags) if sum(b.values()) == n])
            own_fps = np.array([fps[k] for k in own], dtype=np.uint64)
            self.groups[n] = own, own_fps, self._block_index(own_fps)

    def weight(self, shingle: int) -> int:
        return int(self.weights(np.array([shingle], dtype=np.uint64))[0])

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """In thousandths; a shingle of no item weighs as if one item held it."""
        held = np.maximum(1, self.shares[hashes >> np.uint64(64 - SHARE_BITS)])
        return np.round(1000 * np.log1p(self.total / held)).astype(np.int64)

    @staticmethod
    def _block_index(fps: np.ndarray) -> np.ndarray:
        """(16, 16, items): items whose block has the value, or one that differs by one bit."""
        blocks = (fps[None, :] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))[:, None]) & np.uint64(15)
        values = np.arange(16, dtype=np.uint64)[None, :, None]
        return np.bitwise_count(blocks[:, None, :] ^ values) <= 1

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item holds."""
        if not len(self.known):
            return np.empty(0, dtype=np.int64)
        near = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        at = np.minimum(np.searchsorted(self.known, hashes[near]), len(self.known) - 1)
        return near[self.known[at] == hashes[near]]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, n_words, distance, similarity): the best window of each item found."""
        words = word_hashes(text)
        exact = self.short_matches(words)
        hashes = shingle_hashes(words)
        hits = self.hits(hashes)
        if not len(hits):
            return exact
        best: dict[int, tuple] = {}
        sizes = set().union(*(self.holders[x] for x in set(hashes[hits].tolist())))
        # stretches of the text with windows that hold a hit, for the longest window
        reach, starts = max(sizes), []
        for cut in np.split(hits, np.flatnonzero(np.diff(hits) >= 2 * reach) + 1):
            low, high = max(0, int(cut[0]) - reach + 1), min(len(hashes), int(cut[-1]) + reach)
            for a in range(low, high, STRETCH):  # bounded sums for a very long stretch
                starts.append((a, min(a + STRETCH, high), min(a + STRETCH + reach, high)))
        for a, until, b in starts:
            own = hashes[a:b]
            weights = self.weights(own)
            sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signs(own, weights), axis=0, dtype=np.int32)])
            total = np.r_[0, np.cumsum(weights)]
            shared: dict[int, np.ndarray] = {}
            for n in sizes:
                size = min(n, len(hashes))
                at = np.arange(0, max(0, min(until - a, len(own) - size + 1)))
                if not len(at):
                    continue
                items, fps, index = self.groups[n]
                prints = to_fingerprints(sums[at + size] - sums[at])
                w, k, distance = self.near(prints, fps, index)
                for item in np.unique(items[k]).tolist():
                    if item not in shared:
                        shared[item] = np.r_[0, np.cumsum(weights * np.isin(own, self.sets[item]))]
                own_total, possible = total[at + size] - total[at], np.zeros(len(w), dtype=bool)
                for j in range(len(w)):
                    s, item = at[w[j]], items[k[j]]
                    # no more weight can be shared than lies on the item's shingles
                    possible[j] = 2 * (shared[item][s + size] - shared[item][s]) >= self.similarity * (own_total[w[j]] + self.totals[item])
                for j in np.flatnonzero(possible).tolist():
                    s, item, d = int(at[w[j]]), int(items[k[j]]), int(distance[j])
                    sim = self.compare(own[s : s + size], self.bags[item])
                    if sim >= self.similarity and (item not in best or sim > best[item][3]):
                        best[item] = (a + s, size + SHINGLE - 1, d, sim)
        return exact + [(self.ids[k], *v) for k, v in sorted(best.items())]

    def short_matches(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """The first window with just the words of each item that has no shingle."""
        out = []
        for n, items in sorted(self.short.items()):
            hashes = shingle_hashes(words, n)
            at = np.flatnonzero(np.isin(hashes, np.fromiter(items, dtype=np.uint64, count=len(items))))
            found, first = np.unique(hashes[at], return_index=True)
            out += [(i, int(at[k]), n, 0, 1.0) for h, k in zip(found.tolist(), first.tolist(), strict=True) for i in items[h]]
        return out

    def near(self, prints: np.ndarray, fps: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(window, item, distance)`` of the fingerprints within the radius, found by their blocks. Some
        windows at a time, so that what is held stays bounded however many items there are."""
        out = []
        step = max(1, LOOKUPS // max(1, len(fps)))
        for low in range(0, len(prints), step):
            some = prints[low : low + step]
            blocks = (some[None, :] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))[:, None]) & np.uint64(15)
            found = np.zeros((len(some), len(fps)), dtype=bool)
            for block in range(16):
                found |= index[block, blocks[block]]
            w, k = np.nonzero(found)
            distance = np.bitwise_count(some[w] ^ fps[k])
            close = distance <= self.radius
            out.append((w[close] + low, k[close], distance[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def compare(self, window: np.ndarray, bag: Counter) -> float:
        """Twice the shared weight over the weight of both multisets."""
        own = Counter(window.tolist())

        def weigh(bag: Counter) -> int:
            keys = np.fromiter(bag.keys(), dtype=np.uint64, count=len(bag))
            return int((self.weights(keys) * np.fromiter(bag.values(), dtype=np.int64, count=len(bag))).sum())

        return 2 * weigh(own & bag) / (weigh(own) + weigh(bag))


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, **options) -> Iterator[Benchmark]:
    """Indexes of the items, of at most about ``block_words`` words each, one at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\\s+"))).alias("words")).first()
    blocks = 1 + (size["words"] or 0) // block_words
    parts = [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items for k in range(blocks)]
    shares = np.zeros(1 << SHARE_BITS, dtype=np.int32)
    rows: list = []
    for part in parts:
        rows = part.collect()
        for r in rows:
            shares[np.unique(shingle_hashes(word_hashes(r["text"]))) >> np.uint64(64 - SHARE_BITS)] += 1
    for part in parts:
        rows = rows if blocks == 1 else part.collect()
        own = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Benchmark(own, shares, size["n"], **options)


def find_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``MATCH_SCHEMA``: the best window for each document and each item that it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in benchmark_blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in shared.value.matches(t.as_py())]
                columns = list(zip(*found, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start", "n_words", "distance", "similarity"])

        part = rows.mapInArrow(run, MATCH_SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns, in one pass for each block."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in benchmark_blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.matches(t.as_py()) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    base = sf_dir.rstrip("/")
    return find_matches(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet"))
