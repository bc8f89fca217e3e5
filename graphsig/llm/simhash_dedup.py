"""SimHash near-dedup by segment popcounts: a grid range-join under a lower bound, then exact bits.

Fingerprints of words (64 bits, majority of XXH64 shingle hashes) link at ``radius`` or fewer
differing bits. Each fingerprint is embedded by the number of ones in each 2-bit segment. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so it bounds it from below.
The counts 0, 1, 2 are kept in unary (00, 01, 11), so that one XOR and popcount give the Manhattan
distance.

Grid: the 32 segments form ``blocks`` blocks. Two embeddings within Manhattan distance ``radius``
differ in at most ``radius`` blocks, so they agree in ``blocks - radius`` of them; a fingerprint
takes one cell for each choice of so many blocks, with their counts as coordinates. All pairs in
reach share a cell. Only distinct fingerprints enter the grid, and inside a cell a search gives a
spanning forest of the links instead of all pairs. A cell with more than ``cell_rows``
fingerprints is dealt out anew as pairs of chunks.

Edge cases: null and empty texts have fingerprint zero and link like any other; null ids never are
the smallest of a component unless it has no other; repeated rows share their component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.llm.common import doc_key, fresh, text_key
from graphsig.operators.components import connected_components
from graphsig.session import cut_lineage

SHINGLE, RADIUS, SEED = 4, 4, 42
CELL_ROWS, SMALL_GROUP = 4096, 24
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
#: Ones by byte value and bit, most significant bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE, block: int = 1 << 16) -> int:
    """Majority bits of the shingles' hashes; hashes are counted block by block."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins, ends = np.r_[0, ends[:-1]].tolist(), (ends - 1).tolist()
    last = max(len(words) - size + 1, 1)
    counts = np.zeros(64, dtype=np.int64)
    hash64, step = xxhash.xxh64_intdigest, min(size, len(words)) - 1
    for at in range(0, last, block):
        upto = min(last, at + block)
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(begins[at:upto], ends[at + step : upto + step], strict=True)]
        columns = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[8 * i : 8 * i + 8] += np.bincount(columns[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, __text, fp)`` of every whole text, fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "__text", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("__text"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, __text long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """Segment popcounts in unary: the low bit of a segment says one or more, the high bit two."""
    high = (fps >> _ONE) & _LOW
    low = fps & _LOW
    return (high | low) | ((high & low) << _ONE)


def block_masks(blocks: int) -> list[int]:
    """Bit masks of the blocks, each of whole 2-bit segments."""
    edges = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grid_cells(fps: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """``(cell, fp)``: one row for each choice of ``blocks - radius`` blocks. Two cells that happen to
    share a hash only meet in one group; every link is verified."""
    masks = block_masks(blocks)
    chosen = [sum(masks[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            code = embed(own.view(np.uint64))
            for i, mask in enumerate(chosen):
                cell = _mix((code & np.uint64(mask)) ^ _mix(np.full(len(code), i + 1, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column(0)], names=["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def in_reach(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Positions of pairs within the radius: the lower bound first, the exact distance of the rest."""
    near = np.flatnonzero(np.bitwise_count(embed(a) ^ embed(b)) <= radius)
    if len(near):
        near = near[np.bitwise_count((a[near] if a.ndim else a) ^ b[near]) <= radius]
    return near


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``, all runs at once: rows against rows ``d`` later."""
    left, right = [], []
    at, d = np.arange(len(fps)), 1
    while len(at):
        at = at[at + d < len(fps)]
        at = at[group[at] == group[at + d]]
        if len(at):
            near = at[in_reach(fps[at], fps[at + d], radius)]
            left.append(fps[near])
            right.append(fps[near + d])
        d += 1
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: each is expanded once, against those not yet
    reached, so a dense group costs little more than its size."""
    left, right = [], []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = in_reach(x, rest, radius)
            if len(near):
                found = rest[near]
                left.append(np.full(len(found), x, dtype=np.uint64))
                right.append(found)
                queue.extend(found)
                rest = np.delete(rest, near)
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


LINK_SCHEMA = "src long, dst long, cell long, chunk int"


def _link_batch(a: np.ndarray, b: np.ndarray, cell: np.ndarray | None = None, chunk: int | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    arrays = [
        pa.array(a.view(np.int64)),
        none if b is None else pa.array(b.view(np.int64)),
        none if cell is None else pa.array(cell),
        pa.nulls(len(a), pa.int32()) if chunk is None else pa.array(np.full(len(a), chunk, dtype=np.int32)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["src", "dst", "cell", "chunk"])


def cell_linker(radius: int, cell_rows: int):
    """A scan of rows sorted by cell: links of cells up to ``cell_rows`` rows; a larger cell's rows
    come out again in numbered chunks. At most one cell's chunk and one batch are held."""

    def settle(cell: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        a, b = small_links(fps[small], cell[small], radius)
        if len(a):
            yield _link_batch(a, b)
        for at, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
            a, b = forest(fps[at : at + n], radius)
            if len(a):
                yield _link_batch(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        chunk = 0  # of the cell that is held, if it is large
        for batch in batches:
            cell = np.concatenate([held_cell, batch.column(0).to_numpy()])
            fps = np.concatenate([held_fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cell):
                continue
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            done = starts[-1]  # the last cell may go on in the next batch
            plain = np.ones(len(cell), dtype=bool)
            plain[done:] = False
            for k, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                large = n > cell_rows or (k == 0 and chunk)
                if not large:
                    continue
                plain[at : at + n] = False
                final = k < len(starts) - 1
                while n >= cell_rows or (n and final):
                    m = min(n, cell_rows)
                    yield _link_batch(fps[at : at + m], None, cell[at : at + m], chunk)
                    chunk, at, n = chunk + 1, at + m, n - m
                if final:
                    chunk = 0
                else:
                    done = at
            yield from settle(cell[plain], fps[plain]) if plain.any() else ()
            held_cell, held_fps = cell[done:].copy(), fps[done:].copy()
            if not len(held_cell) and chunk:  # the cell may go on: its number of chunks must be kept
                held_cell, held_fps = cell[-1:][:0], fps[-1:][:0]
        if chunk and len(held_cell):
            yield _link_batch(held_fps, None, held_cell, chunk)
        elif len(held_cell):
            yield from settle(held_cell, held_fps)

    return run


def grid_links(fps: DataFrame, radius: int = RADIUS, blocks: int = 6, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(src, dst)``: links between distinct fingerprints whose components are those of all links."""
    cells = grid_cells(fps, blocks, radius).repartition("cell").sortWithinPartitions("cell", "fp")
    found = cut_lineage(cells.mapInArrow(cell_linker(radius, cell_rows), LINK_SCHEMA))
    links = found.filter("dst is not null").select("src", "dst")
    large = found.filter("cell is not null").select("cell", "chunk", F.col("src").alias("fp"))
    # chunk pairs (i, j), i <= j, of large cells: every chunk goes to all pairs it is part of
    chunks = large.groupBy("cell").agg((F.max("chunk") + 1).alias("chunks"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = large.join(chunks, "cell").withColumn("other", other).select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")

    def pair(table: pa.Table) -> pa.Table:
        a, b = forest(np.unique(table.column("fp").to_numpy()).view(np.uint64), radius)
        return pa.table({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return links.unionAll(dealt.groupBy("cell", "i", "j").applyInArrow(pair, "src long, dst long")).distinct()


def blocks_for(n: int) -> int:
    """More blocks (more, finer cells) as fingerprints grow; links are the same for any number."""
    return 6 if n < 1 << 20 else 7 if n < 1 << 27 else 8


def components(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc_id, __text, fp, component_id, __group)`` of each row; ``__group`` names the component
    also where it has no id."""
    rows = cut_lineage(fingerprints(docs, size))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = grid_links(distinct, radius, blocks or blocks_for(distinct.count()), cell_rows)
    found = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("g"))
    grouped = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("g", "fp").alias("__group"))
    smallest = grouped.groupBy("__group").agg(F.min("first").alias("component_id"))
    labels = cut_lineage(grouped.select("fp", "__group").join(smallest, "__group"))
    return rows.join(labels, "fp").select("doc_id", "__text", "fp", "component_id", "__group")


def dedup_documents(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, and one row of it."""
    kept = components(docs, size, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = kept.groupBy(doc_key().alias("__doc"), "__group").agg(F.min("__text").alias("__text"))
    doc, text, copy = fresh(docs, "d_doc", "d_text", "copy")
    one = cut_lineage(one.select(F.col("__doc").alias(doc), F.col("__text").alias(text)))
    match = (doc_key() == F.col(doc)) & (text_key() == F.col(text))
    left = docs.join(one, match, "left_semi")
    # only a table with repeated rows needs a second look at its texts
    repeated = docs.groupBy(doc_key().alias("d"), text_key().alias("t")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        left = left.withColumn(copy, text_key()).dropDuplicates(["doc_id", copy]).drop(copy)
    return left


def simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
