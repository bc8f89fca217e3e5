"""A graph as block files in the shared checkpoint folder, for jobs that follow neighbours again and again.

Nodes get dense ids in the order of their names and are cut into blocks of ids. For each block there are raw
files: where each node's neighbours start (``off``), the neighbours' ids (``nb``) and the names (``names``). A task maps the
blocks it needs into memory, so many tasks of a machine share one copy that the system may drop again, and nothing
that a walk or a round of PageRank looks up goes through a shuffle. Files are written under another name and moved,
so a task may be run twice. Folders that are no local path are read whole, a few blocks at a time.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsig.functions.mixing import node_key
from graphsig.operators.graph import canonical_edges, global_index, nodes
from graphsig.session import scratch_path

#: Nodes of a block, and blocks of a small graph; edges whose sums are made at once, and numbers of a strip of them.
BLOCK, LEAST_BLOCKS = 16_384, 32
EDGES, NUMBERS = 1 << 20, 1 << 18
#: Blocks that a task keeps open where files cannot be mapped.
OPEN = 16


def _place(folder: str) -> tuple[pafs.FileSystem, str, bool]:
    if folder.startswith("file:") or "://" not in folder:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", folder), True
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path, False


def write_file(folder: str, name: str, parts: Iterator[np.ndarray] | list[np.ndarray]) -> None:
    fs, path, _ = _place(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(np.ascontiguousarray(part).view(np.uint8).reshape(-1).data)
    fs.move(draft, f"{path}/{name}")


def read_file(folder: str, name: str, dtype) -> np.ndarray:
    fs, path, local = _place(folder)
    if local:
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def drop_file(folder: str, name: str) -> None:
    fs, path, _ = _place(folder)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
        fs.delete_file(f"{path}/{name}")


@dataclass
class GraphFiles:
    folder: str
    nodes: int
    block: int
    _open: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": OrderedDict()}

    @property
    def blocks(self) -> int:
        return -(-self.nodes // self.block)

    @property
    def dtype(self):
        return np.int32 if self.nodes < 2**31 else np.int64

    def rows(self, b: int) -> int:
        return min(self.block, self.nodes - b * self.block)

    def _kept(self, key: tuple, read: Callable):
        if key not in self._open:
            if len(self._open) >= (2048 if _place(self.folder)[2] else OPEN):
                self._open.popitem(last=False)
            self._open[key] = read()
        return self._open[key]

    def adjacency(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (one more than nodes) and neighbours of the block's nodes, in the order of their numbers."""
        return self._kept(("adj", b), lambda: (read_file(self.folder, f"off-{b}", np.int64), read_file(self.folder, f"nb-{b}", self.dtype)))

    def names(self, b: int) -> pa.Array:
        def read() -> pa.Array:
            starts, text = read_file(self.folder, f"nameoff-{b}", np.int64), read_file(self.folder, f"names-{b}", np.uint8)
            return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.asarray(starts)), pa.py_buffer(np.asarray(text))).cast(pa.string())

        return self._kept(("names", b), read)

    def names_of(self, ids: np.ndarray) -> pa.Array:
        """Names of ascending ids."""
        cuts = np.searchsorted(ids, np.arange(self.blocks + 1, dtype=np.int64) * self.block)
        found = [self.names(b).take(pa.array(ids[lo:hi] - b * self.block)) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    def _by_block(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that brings the ids of a block together, and ``(block, from, to)`` in it."""
        at = ids // self.block
        at = at.astype(np.uint16) if self.blocks <= 1 << 16 else at
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=self.blocks))
        starts = np.r_[0, ends[:-1]]
        return order, [(int(b), int(starts[b]), int(ends[b])) for b in np.flatnonzero(ends > starts)]

    def step(self, at: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Of each node ``at`` the neighbour with number ``choice mod degree``."""
        order, groups = self._by_block(at)
        out = np.empty(len(at), dtype=np.int64)
        for b, lo, hi in groups:
            rows = order[lo:hi]
            start, nb = self.adjacency(b)
            local = at[rows] - b * self.block
            first = start[local]
            out[rows] = nb[first + choice[rows] % (start[local + 1] - first)]
        return out

    def sums(self, b: int, read: Callable[[int], np.ndarray], width: int) -> np.ndarray:
        """For each of the block's nodes the sum of its neighbours' first ``width`` numbers and, of the numbers behind them,
        the bits that any neighbour has. ``read`` gives the numbers of a block's nodes."""
        start, nb = self.adjacency(b)
        total, out = len(nb), None
        for lo in range(0, total, EDGES):
            some = np.asarray(nb[lo : lo + EDGES])
            owner = np.searchsorted(start, np.arange(lo, lo + len(some)), side="right") - 1
            order, groups = self._by_block(some)
            for other, first, last in groups:
                x = read(other)
                if out is None:
                    out = np.zeros((len(start) - 1, x.shape[1]), dtype=np.int64)
                strip = max(64, NUMBERS // x.shape[1])
                for at in range(first, last, strip):
                    rows = order[at : min(at + strip, last)]
                    own, values = owner[rows], x[some[rows] - other * self.block]
                    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    out[own[heads], :width] += np.add.reduceat(values[:, :width], heads, axis=0)
                    if x.shape[1] > width:
                        out[own[heads], width:] |= np.bitwise_or.reduceat(values[:, width:], heads, axis=0)
        return out


def numbered(spark: SparkSession, count: int) -> DataFrame:
    """``id`` from 0 to ``count - 1``, for jobs of one block an id. A task costs more than a small block, so some go
    one after the other once every core has work."""
    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, count, 1, max(1, min(count, max(cores, count // 4))))


def write_graph(
    edges: DataFrame, extra: DataFrame | None = None, bucket_size: int | None = None, adjacency: DataFrame | None = None
) -> tuple[GraphFiles, DataFrame]:
    """Closed neighbourhoods of the graph as files, and ``(node, id)``. ``extra(node)`` adds nodes without edges.

    Neighbours are numbered by name; those of a node with more than ``bucket_size`` by bucket and name, as
    :func:`graphsig.operators.graph.adjacency_index` does, or as ``adjacency(node, idx, nb)`` says.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if adjacency is None:
        # read twice; columns take a fraction of a checkpoint's rows on disk
        path = scratch_path(spark, "edges")
        canonical_edges(edges).write.parquet(path)
        e = spark.read.parquet(path)
        every = nodes(e).select("node")
    else:
        every = adjacency.select("node").distinct()
    if extra is not None:
        every = every.unionByName(extra.select("node").filter("node IS NOT NULL")).distinct()
    path = scratch_path(spark, "ids")
    global_index(every, ["node"], out="id").select("node", "id").write.parquet(path)
    ids = spark.read.schema("node string, id long").parquet(path)
    count = ids.count()
    graph = GraphFiles(scratch_path(spark, "graph"), count, max(1, min(BLOCK, -(-count // LEAST_BLOCKS))))
    if count == 0:
        return graph, ids
    here, there = ids.select(F.col("node").alias("src"), F.col("id").alias("u")), ids.select(F.col("node").alias("dst"), F.col("id").alias("v"))
    loops = ids.select("id", F.col("id").alias("nb"))
    if adjacency is None:
        pairs = e.join(here, "src").join(there, "dst").select("u", "v")
        both = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("nb")), F.struct(F.col("v").alias("id"), F.col("u").alias("nb")))
        half = pairs.select(F.explode(both).alias("h")).select("h.id", "h.nb").unionByName(loops)
        half = half.withColumn("rank", F.lit(0).cast("long"))
    else:
        half = adjacency.select(F.col("node").alias("src"), F.col("nb").alias("dst"), F.col("idx").cast("long").alias("rank"))
        half = half.join(here, "src").join(there, "dst").select(F.col("u").alias("id"), F.col("v").alias("nb"), "rank")
        if extra is not None:
            alone = ids.join(adjacency.select("node").distinct(), "node", "left_anti")
            half = half.unionByName(alone.select("id", F.col("id").alias("nb"), F.lit(0).cast("long").alias("rank")))
    most = _write_neighbours(half, graph, parts)
    if adjacency is None and bucket_size is not None and most > bucket_size:
        size = half.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
        keys = ids.select(F.col("id").alias("nb"), node_key(F.col("node")).alias("key"))
        rank = F.pmod("key", F.ceil(F.col("deg") / F.lit(bucket_size)).cast("long"))
        _write_neighbours(half.drop("rank").join(size, "id").join(keys, "nb").select("id", "nb", rank.alias("rank")), graph, parts)

    def names(b: int, batches: Iterator[list[pa.Array]]) -> None:
        whole = pa.concat_arrays([columns[1] for columns in batches]).cast(pa.large_string())
        _, starts, text = whole.buffers()
        starts = np.frombuffer(starts, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        write_file(graph.folder, f"names-{b}", [np.frombuffer(text, dtype=np.uint8)[starts[0] : starts[-1]] if starts[-1] > starts[0] else np.zeros(1, np.uint8)])
        write_file(graph.folder, f"nameoff-{b}", [starts - starts[0]])

    write_blocks(ids.select("id", "node"), graph.block, parts, names, ["id"])
    return graph, ids


def write_blocks(rows: DataFrame, block: int, parts: int, write: Callable, order: list[str]) -> int:
    """Calls ``write(b, batches)`` in tasks, for each block of ``id`` with its rows in order, as batches of columns, the id first.
    Returns the greatest number that it gave."""
    dealt = rows.repartition(parts, F.expr(f"id div {block}")).sortWithinPartitions(F.expr(f"id div {block}"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, list[pa.Array]]]:
            for batch in batches:
                at = batch.column(0).to_numpy() // block
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    yield int(at[lo]), batch.slice(lo, hi - lo).columns

        ahead, todo = None, pieces()

        def of_block(b: int) -> Iterator[list[pa.Array]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == b:
                yield ahead[1]
                ahead = next(todo, None)

        ahead = next(todo, None)
        while ahead is not None:
            most = write(ahead[0], of_block(ahead[0])) or 0
            yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], names=["most"])

    return dealt.mapInArrow(run, "most long").agg(F.max("most")).first()[0] or 0


def _write_neighbours(half: DataFrame, graph: GraphFiles, parts: int) -> int:
    """Writes the neighbours and returns the highest degree. Neighbours are written as they come, however many a hub has."""

    def write(b: int, batches: Iterator[list[pa.Array]]) -> int:
        count = np.zeros(graph.rows(b), dtype=np.int64)

        def neighbours() -> Iterator[np.ndarray]:
            for columns in batches:
                np.add(count, np.bincount(columns[0].to_numpy() - b * graph.block, minlength=len(count)), out=count)
                yield columns[1].to_numpy().astype(graph.dtype)

        write_file(graph.folder, f"nb-{b}", neighbours())
        write_file(graph.folder, f"off-{b}", [np.r_[0, np.cumsum(count)]])
        return int(count.max())

    return write_blocks(half.select("id", "nb", "rank"), graph.block, parts, write, ["id", "rank", "nb"])
