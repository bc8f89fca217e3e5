"""Alignment of two tokenizers' output over one text, by merge-path partitioning.

Tokenizer A is a byte-level BPE, B a piece model. Both turn the same bytes (a space and the text) into
tokens, so every token has a byte range. Where tokens of A and B end together, the text is cut; what
lies between two cuts is a group, and the two tokens that end at a cut are linked.

The sorted token ends of A and B are merged like two sorted lists. The merge path is divided at
diagonals ``i + j = k * work``; a binary search on each diagonal, all diagonals at once, tells how many
ends of A and of B lie before it. Every piece between two diagonals has the same number of ends, is
independent of the others and emits its overlaps (ends that both lists have). Where a piece starts
with the partner of the last end before it, the boundary is stitched: the link belongs to both pieces'
edge, and the tokens around it become one group. The texts of an Arrow batch are laid end to end, so
pieces are equal whatever the lengths of the texts; very long texts go through in stretches.

How often an id pair is linked counts over the corpus. Two tokens that end together end in the same
bytes, so one of them is a suffix of the other: the number of different pairs is bounded by the two
vocabularies (:func:`pair_bound`; a few hundred thousand), never by the corpus. That is why the counts may be broadcast.

Edge cases: texts that are null, empty, or that one tokenizer changes (its joined token bytes differ
from a space and the text) have no tokens: zeros and an empty groups column. Repeated rows are aligned
each, and each counts in the corpus counts. An empty table gives an empty result. Only ``doc_id``
and ``text`` are read; other columns may have any name and are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.session import scratch_path

#: Ends in one piece of the merge.
WORK = 1 << 16
#: Characters that one step holds; a longer text is cut before single spaces, where both tokenizers cut.
STRETCH = 1 << 20
#: No token of either vocabulary goes on across a space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Code points whose classes no Unicode version has changed: here the rank file gives the same ids.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*")


class Coders:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.fast = _ranked(a_ranks) if a_ranks else None
        spelled = _byte_letters()
        vocab = json.loads(self.a.to_str())["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(spelled[c] for c in entry) if all(c in spelled for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        if len(self.a_bytes) * len(self.b_bytes) > 2**32:
            raise ValueError("id pairs of these vocabularies need more than 32 bits")

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B for a space and the text, or None if one of them does not give its bytes back."""
        if self.fast is not None and _PLAIN.fullmatch(text):
            a = self.fast.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return a, b


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves,
    the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters, without the spaces between them. A text with no
    place to cut is one part."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending arrays crosses each diagonal: ``(i, j)`` with ``i + j`` a multiple
    of ``work`` (and the end), so that the pieces between are independent. Of equal values, A's is first."""
    n, m = len(a), len(b)
    diagonal = np.append(np.arange(0, n + m, work), n + m)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = np.zeros(len(mid), dtype=bool)
        first[open_] = a[mid[open_]] <= b[diagonal[open_] - 1 - mid[open_]]
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low, diagonal - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that both ascending arrays have, within one piece."""
    at = np.searchsorted(b, a)
    same = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.empty(0, dtype=np.int64)
    return same, at[same]


def align_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of tokens that end together: each piece's overlaps, and those stitched at the
    boundaries, where the partner of one piece's last end of A opens the next piece."""
    i, j = merge_path(a, b, work)
    links_a, links_b = [], []
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:
            links_a.append(np.array([i0 - 1]))
            links_b.append(np.array([j0]))
        x, y = overlaps(a[i0:i1], b[j0:j1])
        links_a.append(x + i0)
        links_b.append(y + j0)
    if not links_a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(links_a), np.concatenate(links_b)


def spell_groups(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,`` and so on with one mark after each id, and the place after each group's mark.
    ``cut_a`` and ``cut_b`` are the numbers of ids up to each group's end."""
    before_a, before_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
    group_a = np.repeat(np.arange(len(cut_a)), cut_a - before_a)
    group_b = np.repeat(np.arange(len(cut_b)), cut_b - before_b)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[np.arange(len(a)) + before_b[group_a]] = a
    ids[np.arange(len(b)) + cut_a[group_b]] = b
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    mark[cut_a - 1 + before_b] = ord("|")
    mark[cut_a + cut_b - 1] = ord(";")
    most = len(str(int(ids.max(initial=0))))
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, most))
    after = np.cumsum(digits + 1)
    out = np.empty(int(after[-1]) if len(after) else 0, dtype=np.uint8)
    out[after - 1] = mark
    for k in range(most):
        has = digits > k
        out[after[has] - 2 - k] = 48 + ids[has] // 10**k % 10
    return out.tobytes(), after[cut_a + cut_b - 1]


@dataclass
class _Text:
    """What one text has gathered so far."""

    sound: bool = True
    n_a: int = 0
    n_b: int = 0
    n_links: int = 0
    groups: list[bytes] | None = None
    links: list[np.ndarray] | None = None


def _align_parts(coders: Coders, parts: list[tuple[_Text, str]], work: int) -> None:
    """Aligns some stretches, laid end to end, and adds what they give to their texts."""
    coded = [(t, coders.encode(part)) for t, part in parts if t.sound]
    for t, ids in coded:
        t.sound &= ids is not None
    coded = [(t, ids) for t, ids in coded if t.sound]
    if not coded:
        return
    a = np.concatenate([np.array(ids[0], dtype=np.int64) for _, ids in coded])
    b = np.concatenate([np.array(ids[1], dtype=np.int64) for _, ids in coded])
    to_a, to_b = np.cumsum([len(ids[0]) for _, ids in coded]), np.cumsum([len(ids[1]) for _, ids in coded])
    la, lb = align_ends(np.cumsum(coders.a_size[a]), np.cumsum(coders.b_size[b]), work)
    spelled, after = spell_groups(a, b, la + 1, lb + 1)
    to_link = np.searchsorted(la, to_a - 1, side="right")  # a stretch ends in a link
    pairs = (a[la] * len(coders.b_bytes) + b[lb]).astype(np.int64)
    ga = gb = gl = 0
    for (t, _), ea, eb, el in zip(coded, to_a.tolist(), to_b.tolist(), to_link.tolist(), strict=True):
        t.n_a, t.n_b, t.n_links = t.n_a + ea - ga, t.n_b + eb - gb, t.n_links + el - gl
        t.groups.append(spelled[int(after[gl - 1]) if gl else 0 : int(after[el - 1]) - 1])
        t.links.append(np.stack(np.unique(pairs[gl:el], return_counts=True)))
        ga, gb, gl = ea, eb, el


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _merged(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in ascending order, and how often each occurs."""
    if not links:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    both = np.concatenate(links, axis=1)
    pairs, where = np.unique(both[0], return_inverse=True)
    return pairs, np.bincount(where, weights=both[1], minlength=len(pairs)).astype(np.int64)


def _row(doc: int | None, t: _Text) -> tuple:
    if not t.sound or not t.links:
        return doc, 0, 0, 0, 0, "", b"", b""
    pairs, times = _merged(t.links)
    return doc, t.n_a, t.n_b, t.n_links, t.n_links, b";".join(t.groups).decode(), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()


@dataclass(frozen=True)
class Files:
    """The two vocabularies' files on the executors. ``a_ranks`` is A's vocabulary as a rank file, read
    by a faster coder with the same ids; without it A's own file does all the work."""

    a: str
    b: str
    a_ranks: str | None = None


_LOADED: dict[Files, Coders] = {}


def _coders(files: Files) -> Coders:
    """One pair for each worker process."""
    if files not in _LOADED:
        _LOADED.clear()
        _LOADED[files] = Coders(files.a, files.b, files.a_ranks)
    return _LOADED[files]


def align(docs: DataFrame, files: Files, work: int = WORK, stretch: int = STRETCH) -> DataFrame:
    """For every text its numbers of tokens, groups and links, the groups spelled out, and its linked id
    pairs: ``pairs`` holds the different ones in ascending order as ``a * size of B + b`` and ``times`` how
    often each is linked, both little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(files)
        rows: list[tuple[int | None, _Text]] = []
        parts: list[tuple[_Text, str]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            _align_parts(coders, parts, work)
            columns = list(zip(*(_row(*r) for r in rows), strict=True)) or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t, text = _Text(groups=[], links=[]), text.as_py()
                for part in stretches(text, stretch) if text else ():
                    if held + len(part) > stretch and parts:
                        _align_parts(coders, parts, work)
                        parts, held = [], 0
                        if rows:
                            yield flush()
                            rows = []
                    parts.append((t, part))
                    held += len(part)
                rows.append((doc, t))
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: how often the corpus links each id pair. A task adds up its rows before it sends
    them, at most one row for each pair that the vocabularies allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            columns = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").astype(np.int64) for k in (0, 1))
            pairs, times = _merged([np.stack([pairs, times]), np.stack(list(columns))])
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_bound(coders: Coders) -> int:
    """The most id pairs that can be linked at all: tokens of which one's bytes end in the other's."""
    in_a, in_b = set(filter(None, coders.a_bytes)), set(filter(None, coders.b_bytes))
    longer = lambda xs, ys: sum(x[k:] in ys for x in xs for k in range(1, len(x)))
    return longer(in_a, in_b) + longer(in_b, in_a) + sum(x in in_b for x in in_a)


def score_links(aligned: DataFrame, counts: DataFrame, b_size: int) -> DataFrame:
    """``aligned`` with ``n_best``, its links whose count is the highest of their B id, and ``count_sum``,
    the counts of all its links added up. ``counts`` has one row for each linked pair of the vocabularies."""
    table = counts.orderBy("pair").toPandas()  # bounded by the vocabularies
    pairs, n = table["pair"].to_numpy(dtype=np.int64), table["n"].to_numpy(dtype=np.int64)
    most = np.zeros(b_size, dtype=np.int64)
    np.maximum.at(most, pairs % b_size, n)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs.astype("<u4"), n, n == most[pairs % b_size]))
    names = [f.name for f in aligned.schema.fields]
    at_pairs, at_times = names.index("pairs"), names.index("times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            for i, (p, t) in enumerate(zip(batch.column(at_pairs), batch.column(at_times), strict=True)):
                where = np.searchsorted(known, np.frombuffer(p.as_py(), dtype="<u4"))
                times = np.frombuffer(t.as_py(), dtype="<u4").astype(np.int64)
                sums[:, i] = times[best[where]].sum(), (times * count[where]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[0]), pa.array(sums[1])], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields)
    return aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def default_files() -> Files:
    import public_tokenizers as p

    return Files(p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.tiktoken"))


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """The alignment is written once to the shared folder, without the spelled groups; counting and
    scoring read it there, so no text is tokenised twice and a lost executor repeats only its tasks."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    files = default_files()
    aligned = align(docs, files)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    path = scratch_path(spark, "aligned")
    aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times").write.parquet(path)
    aligned = spark.read.parquet(path)
    scored = score_links(aligned, pair_counts(aligned), vocabulary_size(files.b))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
