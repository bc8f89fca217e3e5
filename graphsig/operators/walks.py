"""Random-walk visit counts (G2) and personalized PageRank mass (G3) over a graph in block files."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.functions.hashing import bits_of_words_sql, check_bits, md5_words
from graphsig.operators.graph import global_index
from graphsig.operators.graphfiles import GraphFiles, drop_file, numbered, read_file, write_blocks, write_file, write_graph


def step_hash(seed: int, step: int) -> F.Column:
    """32-bit choice value of (seed, source, walk, step): first 8 hex digits of an MD5.

    The same text in SQL, so an oracle can replay the walks exactly; tasks make it by :func:`step_choices`.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col("source"), F.col("walk").cast("string"), F.lit(str(step)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_walk_visits(
    edges: DataFrame,
    length: int = 3,
    walks: int = 1000,
    seed: int = 42,
    sources: DataFrame | None = None,
    bucket_size: int = 1_000_000,
    adjacency: DataFrame | None = None,
) -> DataFrame:
    """``(source, visited, cnt)``: visits of ``walks`` uniform walks of ``length`` steps per source.

    Walks move over closed neighbourhoods (a node may step to itself); the start is counted only when a
    step returns to it. Step ``s`` of walk ``w`` from ``source`` takes neighbour number
    ``md5(seed|source|w|s) mod deg + 1``, a pure function of its coordinates, so results do
    not depend on partitioning.
    """
    graph, ids = write_graph(edges, sources, bucket_size, adjacency)
    return walk_counts(graph, ids, [(length, walks)], seed, sources).withColumnRenamed("c0", "cnt")


def shared_walk_visits(
    edges: DataFrame, settings: list[tuple[int, int]], seed: int = 42, sources: DataFrame | None = None, bucket_size: int = 1_000_000, each: bool = False
) -> DataFrame | list[DataFrame]:
    """G2 for several ``(length, walks)`` at once: ``(source, visited, c0, c1, ...)`` with a count for each.

    A step depends on (seed, source, walk, step) alone, so shorter and fewer walks are parts of the longest
    and most: every setting counts the rows with ``step < length`` and ``walk < walks`` of one walk table. With ``each`` there is
    a ``(source, visited, cnt)`` for every setting, walked when it is read, over one set of graph files.
    """
    graph, ids = write_graph(edges, sources, bucket_size)
    if each:
        return [walk_counts(graph, ids, [x], seed, sources).withColumnRenamed("c0", "cnt") for x in settings]
    return walk_counts(graph, ids, settings, seed, sources)


#: Walkers that a task moves at once, rows that it gives out at once, and hashes made at once.
WALKERS, ROWS, HASHES = 1 << 19, 1 << 16, 1 << 15


def walk_counts(graph: GraphFiles, ids: DataFrame, settings: list[tuple[int, int]], seed: int = 42, sources: DataFrame | None = None) -> DataFrame:
    """Counts of :func:`shared_walk_visits`; rows of a source follow each other.

    The graph lies in block files that every task maps (:mod:`graphsig.operators.graphfiles`). A task walks its sources a
    batch at a time and counts their visits itself, so neither walkers nor visits are shuffled, and the result
    is not kept: reading it again walks again. A source named several times counts as often.
    """
    if min(n for n, _ in settings) < 1:
        raise ValueError("walk length must be at least 1")
    if min(w for _, w in settings) < 1:
        raise ValueError("number of walks must be at least 1")
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = F.lit(1).cast("long")
    if sources is None:
        starts = ids.select("node", "id", once.alias("times"))
    else:
        starts = sources.groupBy("node").agg(F.count(once).alias("times")).join(ids, "node", "left").select("node", "id", "times")
    starts = starts.repartitionByRange(parts, "id").sortWithinPartitions("id")
    out = "source string, visited string, " + ", ".join(f"c{i} long" for i in range(len(settings)))
    names = ["source", "visited", *(f"c{i}" for i in range(len(settings)))]
    most = max(w for _, w in settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, WALKERS // most)
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                some = batch.slice(lo, at_once)
                lone = some.filter(pa.compute.is_null(some.column(1)))  # a null is no node of the graph and stays where it is
                if lone.num_rows:
                    counts = [pa.compute.multiply(lone.column(2), n * w) for n, w in settings]
                    yield pa.RecordBatch.from_arrays([lone.column(0), lone.column(0), *counts], names=names)
                some = some.filter(pa.compute.is_valid(some.column(1)))
                if some.num_rows:
                    yield from _count_visits(graph, some, settings, seed, names)

    return starts.mapInArrow(run, out)


def _count_visits(graph: GraphFiles, starts: pa.RecordBatch, settings: list[tuple[int, int]], seed: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    length, walks = max(n for n, _ in settings), max(w for _, w in settings)
    heads = [f"{seed}|{x}|".encode() for x in starts.column(0).to_pylist()]
    at = np.repeat(starts.column(1).to_numpy(), walks)
    row = np.repeat(np.arange(len(heads), dtype=np.int64), walks) * graph.nodes
    visits = np.empty((length, len(at)), dtype=np.int64)
    for step in range(length):
        at = graph.step(at, step_choices(heads, walks, step).ravel())
        np.add(row, at, out=visits[step])
    if len(settings) == 1:
        found, counts = np.unique(visits, return_counts=True)
        counts = [counts]
    else:
        found, which = np.unique(visits, return_inverse=True)
        which = which.reshape(length, len(heads), walks)
        counts = [np.bincount(which[:n, :, :w].ravel(), minlength=len(found)) for n, w in settings]
    source, visited = np.divmod(found, graph.nodes)
    times = starts.column(2).to_numpy()[source]
    ids, which = np.unique(visited, return_inverse=True)
    visited_names = graph.names_of(ids)
    for lo in range(0, len(found), ROWS):
        part = slice(lo, lo + ROWS)
        columns = [starts.column(0).take(pa.array(source[part])), visited_names.take(pa.array(which[part]))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c[part] * times[part]) for c in counts)], names=names)


def step_choices(heads: list[bytes], walks: int, step: int) -> np.ndarray:
    """:func:`step_hash` of every head ``seed|source|`` (a row) and walk (a column)."""
    tail = f"|{step}".encode()
    out = np.empty((len(heads), walks), dtype=np.int64)
    size = np.array([len(h) for h in heads])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        lo = 0
        while lo < walks:  # walks of as many digits
            hi = min(walks, 10 ** len(str(lo)))
            digits = [str(w).encode() for w in range(lo, hi)]
            total = n + len(digits[0]) + len(tail)
            if total > 55:  # more than one block of MD5
                out[rows, lo:hi] = [[int.from_bytes(hashlib.md5(heads[r] + d + tail).digest()[:4], "big") for d in digits] for r in rows]
                lo = hi
                continue
            ends = np.frombuffer(b"".join(d + tail + b"\x80" for d in digits), dtype=np.uint8).reshape(hi - lo, -1)
            few = max(1, HASHES // (hi - lo))
            for r in range(0, len(rows), few):
                some = rows[r : r + few]
                text = np.zeros((len(some), hi - lo, -(-(total + 1) // 4) * 4), dtype=np.uint8)
                text[:, :, :n] = np.frombuffer(b"".join(heads[x] for x in some), dtype=np.uint8).reshape(-1, 1, n)
                text[:, :, n : total + 1] = ends
                words = text.reshape(-1, text.shape[2]).view("<u4")
                out[some, lo:hi] = _md5_head([np.ascontiguousarray(words[:, i]) for i in range(words.shape[1])], total * 8).reshape(len(some), -1)
            lo = hi
    return out


_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_head(words: list[np.ndarray], bits: int) -> np.ndarray:
    """First 32 bits, as a number, of the MD5 of many messages of one block and equal length. ``words`` are the columns up to
    the closing bit; the rest of the block is zero but for the length."""
    a, b, c, d = (np.full(len(words[0]), x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # what three more rounds make lies behind the first word
        kind, k = divmod(i, 16)
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        add = _MD5_ADD[i]
        if k < len(words):
            np.add(f, words[k], out=f)
        if k == 14:  # two words are never so long that they reach the length
            add = (add + bits) & 0xFFFFFFFF
        np.add(f, a, out=f)
        np.add(f, np.uint32(add), out=f)
        turn = _MD5_TURN[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


# Fixed-point scale of PageRank mass: 1.0 == 10**12 (integer arithmetic keeps sums exact).
PPR_SCALE = 10**12


#: A source's masses (1.0 in all) may still move by this much in the last round, whatever the graph's size.
PPR_TOL = 1e-6


def pagerank_rounds(alpha: tuple[int, int] = (85, 100), tol: float = PPR_TOL, n: int = 1, limit: int = 1000) -> int:
    """Rounds after which every source's masses move by less than ``n * tol``. A round shrinks the moves by
    ``a`` at least and the first moves at most ``2a``, so round ``t`` moves at most ``2 a^t``. With
    ``n`` nodes given it is the stop of common graph libraries, which grows laxer with the graph."""
    for t in range(1, limit + 1):
        if 2 * (alpha[0] / alpha[1]) ** t < n * tol:
            return t
    raise RuntimeError(f"PageRank does not converge to {tol} in {limit} rounds")


#: Sources whose masses stand in one row: a number has a bit for each of them.
PANEL = 63


def personalized_pagerank(
    edges: DataFrame,
    alpha: tuple[int, int] = (85, 100),
    iterations: int | None = None,
    sources: DataFrame | None = None,
    scale: int = PPR_SCALE,
    tol: float | None = None,
) -> DataFrame:
    """``(source, node, mass)`` — personalized PageRank by power iteration, mass in fixed point.

    Masses are files too, one for each block of nodes and ``PANEL`` of sources, which a task reads where its nodes have
    neighbours: a round is one stage without a shuffle but for the moves, whatever the number of sources. The loop stops once no source's masses moved by more than ``tol`` in all (as a fraction of 1.0), an
    absolute measure that does not depend on the graph's size; :func:`pagerank_rounds` bounds the rounds. ``iterations`` without
    ``tol`` runs just that many rounds, with it at most that many.

    ``mass_{t+1}(s, v) = (1-a)·[v = s] + a · Σ_{u ∋ v} mass_t(s, u) / deg(u)`` over closed
    neighbourhoods (every node keeps a self-loop, so nothing dangles). Each contribution is an integer
    floor division, so totals are exact and independent of summation order. No entry is dropped: the
    result grows with sources x nodes, so it is for a list of ``sources``; sketches of all nodes come
    from :func:`pagerank_bit_sums`, which keeps no masses.
    """
    num, den = alpha
    if not 0 < num < den:
        raise ValueError("alpha must be a fraction in (0, 1)")
    graph, ids = write_graph(edges, sources)
    spark, folder, blocks = edges.sparkSession, graph.folder, graph.blocks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sources in the order of their ids, PANEL at a time
    starts = ids if sources is None else sources.select("node").distinct().join(ids, "node")
    listed = global_index(starts.select(F.col("id").alias("at")), ["at"], out="id").select("id", "at")

    def write_panel(p: int, batches: Iterator[list[pa.Array]]) -> int:
        at = np.concatenate([columns[1].to_numpy() for columns in batches])
        write_file(folder, f"sources-{p}", [at])
        return p + 1

    panels = write_blocks(listed, PANEL, parts, write_panel, ["id"])
    teleport_mass = scale * (den - num) // den

    # of each block and panel: a row of masses for each node, and what the node gives to each neighbour, behind which a number
    # has a bit for every source that reaches the node
    def save(p: int, b: int, t: int, mass: np.ndarray, reach: np.ndarray) -> None:
        degree = np.diff(graph.adjacency(b)[0])[:, None]
        write_file(folder, f"mass-{t}-{p}-{b}", [mass, reach])
        write_file(folder, f"gives-{t}-{p}-{b}", [np.c_[mass * num // (den * degree), reach]])

    def load(p: int, b: int, t: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        numbers, rows = read_file(folder, f"mass-{t}-{p}-{b}", np.int64), graph.rows(b)
        return numbers[: rows * width].reshape(rows, width), numbers[rows * width :]

    def begin(p: int, b: int) -> np.ndarray:
        at = read_file(folder, f"sources-{p}", np.int64)
        mass, reach = np.zeros((graph.rows(b), len(at)), dtype=np.int64), np.zeros(graph.rows(b), dtype=np.int64)
        mine = np.flatnonzero(at // graph.block == b)
        mass[at[mine] - b * graph.block, mine] = scale
        reach[at[mine] - b * graph.block] = np.int64(1) << mine
        save(p, b, 0, mass, reach)
        return np.zeros(len(at), dtype=np.int64)

    def go_on(t: int) -> Callable[[int, int], np.ndarray]:
        def one(p: int, b: int) -> np.ndarray:
            at = read_file(folder, f"sources-{p}", np.int64)
            width = len(at)
            before, _ = load(p, b, t - 1, width)
            got = graph.sums(b, lambda other: read_file(folder, f"gives-{t - 1}-{p}-{other}", np.int64).reshape(-1, width + 1), width)
            mass, reach = got[:, :width], got[:, width]
            mine = np.flatnonzero(at // graph.block == b)
            mass[at[mine] - b * graph.block, mine] += teleport_mass
            save(p, b, t, mass, reach)
            for kind in ("mass", "gives"):  # the round before the last is whole, so nobody reads what was before it
                drop_file(folder, f"{kind}-{t - 2}-{p}-{b}")
            return np.abs(mass - before).sum(axis=0)

        return one

    def play(one: Callable[[int, int], np.ndarray]) -> int:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    p, b = divmod(i, blocks)
                    moved = one(p, b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moved)) + p * PANEL), pa.array(moved)], names=["source", "moved"])

        moved = numbered(spark, panels * blocks).mapInArrow(run, "source long, moved long")
        return moved.groupBy("source").agg(F.sum("moved").alias("d")).agg(F.max("d")).first()[0] or 0

    play(begin)
    if iterations is None and tol is None:
        tol = PPR_TOL
    last = 0
    for last in range(1, 1 + (pagerank_rounds(alpha, tol) if iterations is None else iterations)):
        moved = play(go_on(last))
        if tol is not None and moved <= tol * scale:
            break

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                p, b = divmod(i, blocks)
                at = np.asarray(read_file(folder, f"sources-{p}", np.int64))
                mass, reach = load(p, b, last, len(at))
                source_names, node_names = graph.names_of(at), graph.names(b)
                node, source = np.nonzero(reach[:, None] >> np.arange(len(at)) & 1)
                for lo in range(0, len(node), ROWS):
                    x, y = node[lo : lo + ROWS], source[lo : lo + ROWS]
                    yield pa.RecordBatch.from_arrays([source_names.take(pa.array(y)), node_names.take(pa.array(x)), pa.array(mass[x, y])], names=["source", "node", "mass"])

    return numbered(spark, panels * blocks).mapInArrow(rows, "source string, node string, mass long")


# Fixed point of the sketch recurrence: sums over a neighbourhood stay in BIGINT up to 9e8 neighbours.
PPR_SUM_SCALE = 10**10
#: Rows of sums given out at once.
SUM_ROWS = 4096


def pagerank_bit_sums(
    edges: DataFrame,
    f: int = 128,
    alpha: tuple[int, int] = (85, 100),
    iterations: int | None = None,
    node_table: DataFrame | None = None,
    scale: int = PPR_SUM_SCALE,
) -> DataFrame:
    """N3 ``(node, cnt, sums)``: bit sums weighted by personalized PageRank mass, for every node.

    Mass obeys ``mass(s) = (1-a) e_s + a / deg(s) * sum of mass(u) over u in N[s]``, and bit sums are
    linear in mass, so they obey the same recurrence with the node's own bits in place of ``e_s``.
    A round is one stage in which a task adds up, for a block of nodes, the ``f + 1`` numbers of their neighbours from
    the files of the round before: work grows with the edges, nothing is shuffled, no table of (source, node) masses exists, and none of the mass is cut. The last
    number is the total mass (a bit that is always one), floored like the others. ``node_table(node)``
    adds nodes without edges. Without ``iterations`` it runs until no number moves by more than
    ``PPR_TOL`` of a node's mass, at most :func:`pagerank_rounds` rounds, whatever the graph's size.
    """
    num, den = alpha
    if not 0 < num < den:
        raise ValueError("alpha must be a fraction in (0, 1)")
    check_bits(f)
    graph, ids = write_graph(edges, node_table)
    spark, folder, blocks = edges.sparkSession, graph.folder, graph.blocks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    teleport = scale * (den - num) // den
    hashed = ids.withColumn("__own", F.array(*md5_words(F.col("node"), f)))
    own = hashed.select("id", F.expr(f"concat({bits_of_words_sql('__own', f)}, array(1L))").alias("own"))

    def begin(b: int, batches: Iterator[list[pa.Array]]) -> None:
        bits = np.concatenate([columns[1].flatten().to_numpy(zero_copy_only=False) for columns in batches])
        write_file(folder, f"own-{b}", [bits.astype(np.int8)])
        write_file(folder, f"sums-0-{b}", [bits * scale])

    write_blocks(own, graph.block, parts, begin, ["id"])

    def read(t: int, b: int) -> np.ndarray:
        return read_file(folder, f"sums-{t}-{b}", np.int64).reshape(-1, f + 1)

    def play(t: int) -> int:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    v = graph.sums(b, lambda other: read(t - 1, other), f + 1)
                    v //= np.diff(graph.adjacency(b)[0])[:, None]
                    v *= num
                    v //= den
                    v += read_file(folder, f"own-{b}", np.int8).reshape(v.shape) * np.int64(teleport)
                    write_file(folder, f"sums-{t}-{b}", [v])
                    drop_file(folder, f"sums-{t - 2}-{b}")  # the round before the last is whole, so nobody reads what was before it
                    yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(v - read(t - 1, b)).max())])], names=["moved"])

        return numbered(spark, blocks).mapInArrow(run, "moved long").agg(F.max("moved")).first()[0] or 0

    last = 0
    for last in range(1, 1 + (pagerank_rounds(alpha) if iterations is None else iterations)):
        moved = play(last)
        if iterations is None and moved <= PPR_TOL * scale:
            break

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                names, v = graph.names(b), read(last, b)
                for lo in range(0, len(v), SUM_ROWS):
                    some = v[lo : lo + SUM_ROWS]
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * f)
                    sums = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(some[:, :f]).ravel()))
                    yield pa.RecordBatch.from_arrays([names.slice(lo, len(some)), pa.array(np.ascontiguousarray(some[:, f])), sums], names=["node", "cnt", "sums"])

    return numbered(spark, blocks).mapInArrow(rows, "node string, cnt long, sums array<long>")
