"""Best-fit packing of token sequences under several capacities at once.

Documents become pieces of at most ``capacity`` tokens. An item's demand is the vector (tokens, 1
document, attention cost = tokens squared); a bin's residual starts at the capacities. Items of one
length are alike, so the plan is made from the histogram of lengths, which has at most ``capacity``
rows whatever the corpus. Longest first, each length goes to the bins that score best among those
that hold it under every constraint: the largest weighted dot product of demand and residual, or the
smallest weighted residual norm that is left. Alike bins are kept as one group with a count, and a
bin takes as many items of the length as still fit before the next one.

The plan is a table of runs: items number ``first`` to ``last`` of a length go to bins from ``bin``
on, ``per_bin`` in each, from ``offset``. Pieces get their number within their length from sorted
buckets and running totals of bucket sizes. No task or driver ever sees all pieces.

Edge cases: null and empty texts have only the end id; texts that share a doc_id are packed each by
itself; repeated rows are packed each; a piece longer than a capacity allows is an error; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphsig.llm.common import fresh, text_key
from graphsig.session import cut_lineage

CAPACITY, END_ID = 2048, 0
#: Words whose ids a Python worker keeps; at most twice as many are held.
CACHE_WORDS = 200_000
#: Characters of texts that are looked up together, and the most words of a part of a long text.
TOGETHER, PART_WORDS = 1 << 18, 100_000
#: Rows of one bucket, within which pieces are numbered by a sort.
BUCKET_ROWS = 20_000
RUN_LIMIT = 200_000

#: Words of letters that lower-case and normalise each by itself.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
#: ASCII marks; an apostrophe may belong to letters after it.
_MARK = np.array([32 < c < 127 and not chr(c).isalnum() and chr(c) != "'" for c in range(256)])


def split_words(text: str) -> list[bytes]:
    """The text's words, each mark or run of marks after letters apart from them, as the tokenizer's
    rules have it too. Texts that may hold a special token are split at white space alone."""
    raw = text.encode()  # bytes split at ASCII white space
    if b"<|" in raw:
        return raw.split()
    letters = np.frombuffer(raw := raw.lower(), dtype=np.uint8)
    after = _LETTER[letters[:-1]]
    after[1:] |= (letters[:-2] == 0xC3) & (letters[1:-1] & 0x1F != 0x17) & (letters[1:-1] < 0xC0)
    cuts = np.flatnonzero(after & _MARK[letters[1:]]) + 1
    return (np.insert(letters, cuts, 32).tobytes() if len(cuts) else raw).split()


class WordIds:
    """Ids of white-space separated words as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer's rules never cross white space, so a text's ids are its words' ids in order. Words
    repeat, so their ids are cached; words of letters skip the tokenizer's pattern matching and go to
    the same vocabulary and merges directly, by a faster coder of the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        # bytes as the vocabulary spells them: printable ones as themselves, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in printable}
        spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        # ids are in the order of merges, so they serve as ranks; a zero byte stands for a word's end
        ranks = {}
        for entry, i in json.loads(self.full.to_str())["model"]["vocab"].items():
            word = entry.removesuffix("</w>")
            if all(c in spelled for c in word):
                ranks[bytes(map(spelled.get, word)) + (b"" if word == entry else b"\0")] = i
        self.letters = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(1 + max(ranks.values()), dtype=bool)
        self.ends[[i for word, i in ranks.items() if word.endswith(b"\0") and word != b"\0"]] = True
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn_letters(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            # words of texts that may hold a special token come as they are
            ids = np.array(self.letters.encode_ordinary((b"\0".join(some) + b"\0").decode().lower()), dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.words.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def learn(self, words: set[bytes]) -> None:
        """Looks words up that are not cached. A full cache becomes the one before; words found there
        move back, so words in use stay and others are forgotten."""
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
        letters, other = [], []
        for w in words.difference(self.words):
            if w in self.before:
                self.words[w] = self.before[w]
            elif w.isalpha() and w.islower() or _LETTERS.fullmatch(w.decode()):
                letters.append(w)
            else:
                other.append(w)
        self._learn_letters(letters)
        if other:
            for w, coded in zip(other, self.full.encode_batch([w.decode() for w in other], add_special_tokens=False), strict=True):
                self.words[w] = np.array(coded.ids, dtype="<u4").tobytes()

    def rest(self) -> None:
        """Forgets the words not used lately."""
        self.before = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of some texts at once, so that the tokenizer sees many new words in a call. A text of many words goes
        in parts, so that a very long one never fills the cache."""
        split = [split_words(t) for t in texts]
        if sum(map(len, split)) <= PART_WORDS:
            self.learn(set().union(*split))
            return [b"".join(map(self.words.__getitem__, words)) for words in split]
        out = []
        for words in split:
            parts = []
            for at in range(0, len(words), PART_WORDS):
                some = words[at : at + PART_WORDS]
                self.learn(set(some))
                parts.append(b"".join(map(self.words.__getitem__, some)))
            out.append(b"".join(parts))
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def ids_of(coder: WordIds, column: pa.Array) -> Iterator[bytes]:
    """Ids of each text of the column, some texts at a time."""
    some, size = [], 0
    for text in column:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= TOGETHER:
            yield from coder.ids(some)
            some, size = [], 0
    yield from coder.ids(some)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, row, piece, start, length, ids_crc32)`` of each whole text; ``row`` is a hash of the
    text. ``tokenizer`` is the vocabulary file's path on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_of(coder, batch.column(2)), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, row, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        coder.rest()  # the worker process may serve other stages next

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Limits:
    """Capacities of a bin and the weights of their dimensions in the score."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    score: str = "norm"  # or "dot"

    def __post_init__(self):
        if self.score not in ("norm", "dot"):
            raise ValueError("score is norm or dot")


def plan_runs(histogram: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first, last, bin, per_bin, offset)`` for ``{length: items}``; last is exclusive."""
    full = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.int64)
    weights = np.array(limits.weights)
    residual = np.empty((64, 3), dtype=np.int64)  # by group of alike bins
    where = np.empty((64, 2), dtype=np.int64)  # first bin, number of bins
    groups, bins, runs = 0, 0, []

    def add(rest: np.ndarray, at: int, n: int) -> None:
        nonlocal groups, residual, where
        if groups == len(residual):
            residual, where = np.concatenate([residual, residual]), np.concatenate([where, where])
        residual[groups], where[groups] = rest, (at, n)
        groups += 1

    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > full).any():
            raise ValueError(f"an item of {length} tokens does not fit an empty bin")
        left, first = histogram[length], 0
        while left:
            fits = np.flatnonzero((residual[:groups] >= demand).all(axis=1))
            if len(fits):
                share = residual[fits] / full
                if limits.score == "dot":
                    g = fits[np.argmax((share * demand / full) @ weights)]
                else:
                    g = fits[np.argmin(((share - demand / full) ** 2) @ weights)]
                rest, (at, n) = residual[g].copy(), where[g].tolist()
            else:
                g, rest, at, n = -1, full, bins, left
            per = int((rest // demand).min())
            # whole bins first, then one that gets the remainder
            whole, extra = (min(n, left // per), 0) if left >= per else (1, left)
            count = whole * per if not extra else extra
            runs.append((length, first, first + count, at, per, limits.tokens - int(rest[0])))
            after = rest - demand * (extra or per)
            if g < 0:
                bins += whole
                add(after, at, whole)
            elif whole == n:
                residual[g] = after
            else:
                where[g] = (at + whole, n - whole)
                add(after, at, whole)
            left, first = left - count, first + count
        spent = (residual[:groups, 0] <= 0) | (residual[:groups, 1] <= 0)
        if spent.any():
            kept = np.flatnonzero(~spent)
            residual[: len(kept)], where[: len(kept)] = residual[kept], where[kept]
            groups = len(kept)
    return runs


def pack(items: DataFrame, limits: Limits = Limits(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``items`` (with a ``length``) with ``sequence_id`` and ``offset``; a column of one of these names
    is replaced, others may have any name."""
    spark = items.sparkSession
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = cut_lineage(items.select(*columns))
    counted = items.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # at most limits.tokens rows
    of, bucket, n, before, inside, rank, first, last, bin_, per, offset = fresh(items, "of", "bucket", "n", "before", "inside", "rank", "first", "last", "bin", "per", "start_at")
    # each length has buckets of about as many rows
    buckets = spark.createDataFrame([(k, 1 + v // bucket_rows) for k, v in histogram.items()], f"length long, {of} long")
    dealt = items.join(F.broadcast(buckets), "length").withColumn(bucket, F.pmod(F.xxhash64(*columns), F.col(of))).drop(of)
    sizes = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n))
    upto = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.select("length", bucket, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before)))
    order = Window.partitionBy("length", bucket).orderBy(*columns)
    numbered = dealt.withColumn(inside, F.row_number().over(order) - 1).join(offsets, ["length", bucket])
    runs = plan_runs(histogram, limits)
    table = spark.createDataFrame(runs or [], f"length long, {first} long, {last} long, {bin_} long, {per} long, {offset} long")
    table = F.broadcast(table) if len(runs) <= RUN_LIMIT else table
    placed = numbered.withColumn(rank, F.col(before) + F.col(inside)).join(table, "length").filter((F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(last)))
    k = F.col(rank) - F.col(first)
    return placed.select(
        *columns,
        (F.col(bin_) + F.expr(f"({rank} - {first}) div {per}")).alias("sequence_id"),
        (F.col(offset) + F.pmod(k, F.col(per)) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their place: tokenised whole, cut only where longer than a bin."""
    return pack(pieces(docs, tokenizer, limits.tokens, end_id), limits)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    packed = pack_documents(docs, default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
