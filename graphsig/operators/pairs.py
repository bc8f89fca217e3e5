"""Pair similarity: scores for given pairs, exact global top-k over all pairs, banded candidates.

All-pairs ranking is quadratic by definition. ``top_pairs`` never materialises the pairs: nodes are
hashed into blocks, each node is sent to the block-pairs it belongs to (B rows per node), and one
``applyInPandas`` task per block-pair scores its two blocks with numpy, a strip of about 2^18 cells at a
time. A floor under the k-th similarity, read off the blocks that meet themselves, leaves each task
with few pairs to emit; sorted by ones, norm or angle to a pivot, rows that no bound lets reach the
floor are not compared. A final ``orderBy(...).limit(k)`` merges (``TakeOrderedAndProject``). Tasks hold
two blocks, one strip and at most a few k pairs whatever the skew of the graph.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsig.functions import similarity as SIM
from graphsig.functions.hashing import sig_words, word_widths
from graphsig.session import cut_lineage

PAIR_SCHEMA_INT = "a string, b string, sim int"
PAIR_SCHEMA_DBL = "a string, b string, sim double"


def _vector_kind(df: DataFrame, column: str, f: int | None = None) -> str:
    """'bits' for packed signatures (BIGINT, or ARRAY<BIGINT> words when f is given), 'float' for
    float vectors, 'array' for categorical arrays compared position by position."""
    dt = df.schema[column].dataType
    if isinstance(dt, T.ArrayType):
        if isinstance(dt.elementType, (T.FloatType, T.DoubleType)):
            return "float"
        return "bits" if f is not None else "array"
    return "bits"


def _sim_type(kind: str, measure: str) -> str:
    return "double" if measure == "cosine" or (kind == "float" and measure == "dot_product") else "int"


def pair_similarity(a_vec: Column, b_vec: Column, kind: str, measure: str, f: int | None = None) -> Column:
    """Similarity of two vectors held in columns (bit signatures, categorical arrays or float arrays)."""
    SIM.check_measure(measure)
    if kind == "bits":
        wa, wb = sig_words(a_vec, f), sig_words(b_vec, f)
        if measure == "hamming":
            return SIM.hamming_similarity(wa, wb, f)
        if measure == "dot_product":
            return SIM.common_ones(wa, wb)
        return F.round(SIM.cosine_bits(wa, wb), 6)
    if measure == "hamming":
        eq = F.zip_with(a_vec, b_vec, lambda x, y: F.when(x == y, 1).otherwise(0))
        return F.aggregate(eq, F.lit(0), lambda s, v: s + v)
    if measure == "dot_product":
        d = SIM.dot(a_vec, b_vec)
        return F.round(d, 6) if kind == "float" else d.cast("int")
    return F.round(SIM.cosine_guarded(a_vec, b_vec), 6)


def score_pairs(
    pairs: DataFrame, vectors: DataFrame, measure: str = "hamming", f: int | None = None, a: str = "a", b: str = "b", key: str = "node", vector: str = "sig"
) -> DataFrame:
    """M11 + M1/M3/M4: look both endpoints up (two equi-joins) and score the given pairs."""
    kind = _vector_kind(vectors, vector, f)
    va = vectors.select(F.col(key).alias(a), F.col(vector).alias("__va"))
    vb = vectors.select(F.col(key).alias(b), F.col(vector).alias("__vb"))
    joined = pairs.join(va, a).join(vb, b)
    return joined.withColumn("sim", pair_similarity(F.col("__va"), F.col("__vb"), kind, measure, f)).drop("__va", "__vb")


# ------------------------------------------------------------------ exact top-k kernel


def _matrix(values: pd.DataFrame | pd.Series, kind: str, f: int | None) -> np.ndarray:
    if kind == "bits":
        # signature words arrive as separate BIGINT columns: no per-row Python conversion
        return np.ascontiguousarray(values.to_numpy(dtype=np.int64)).reshape(len(values), -1).view(np.uint64)
    dtype = np.float64 if kind == "float" else np.int64
    return np.array([np.asarray(v, dtype=dtype) for v in values])


#: Cells whose words are mixed at once: the two buffers stay in the processor's cache and are used again.
TILE_CELLS = 1 << 15


def _bit_counts(x: np.ndarray, y: np.ndarray, mix: np.ufunc, f: int) -> np.ndarray:
    """Set bits of ``mix`` of each two vectors. No array is made for a word of a tile: fresh pages cost more than the bits."""
    count = np.zeros((len(x), len(y)), dtype=np.uint8 if f <= 255 else np.int32)
    words = np.ascontiguousarray(y.T)
    step = max(1, TILE_CELLS // max(1, len(y)))
    mixed = np.empty((min(step, len(x)), len(y)), dtype=np.uint64)
    ones = np.empty(mixed.shape, dtype=np.uint8)
    for lo in range(0, len(x), step):
        tile = x[lo : lo + step]
        m, o = mixed[: len(tile)], ones[: len(tile)]
        for w in range(x.shape[1]):
            mix(tile[:, w, None], words[w][None, :], out=m)
            np.bitwise_count(m, out=o)
            count[lo : lo + step] += o
    return count


def _scores(x: np.ndarray, y: np.ndarray, kind: str, measure: str, f: int | None, floor=None, room: np.ndarray | None = None) -> np.ndarray:
    """Similarities of each two vectors. Those under ``floor`` may be given as -1: where the common ones cannot
    reach it, no cosine is made. They may lie in ``room``, numbers that the next call overwrites."""
    if kind == "bits":
        if measure == "hamming":
            count = _bit_counts(x, y, np.bitwise_xor, f)
            return np.subtract(count.dtype.type(f), count, out=count)
        count = _bit_counts(x, y, np.bitwise_and, f)
        if measure == "dot_product":
            return count
        ones_x, ones_y = _ones(x), _ones(y)
        if floor is not None and floor > SLACK and len(x):
            need = np.ceil((floor - SLACK) * np.sqrt(ones_x.min() * ones_y) - SLACK)
            i, j = _cells(count >= np.maximum(need, 0.0).astype(count.dtype)[None, :])
            denom = np.sqrt(ones_x[i] * ones_y[j])
            out = np.empty(count.size) if room is None else room[: count.size]
            out = out.reshape(count.shape)
            out.fill(-1.0)
            out[i, j] = np.round(np.divide(count[i, j], denom, out=np.zeros(len(i)), where=denom > 0), 6)
            return out
        denom = np.sqrt(ones_x[:, None] * ones_y[None, :])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(denom == 0, 0.0, count / denom)
        return np.round(out, 6)
    if measure == "hamming":
        count = np.zeros((len(x), len(y)), dtype=np.int32)
        for d in range(x.shape[1]):
            count += x[:, d, None] == y[None, :, d]
        return count
    xf, yf = x.astype(np.float64), y.astype(np.float64)
    d = xf @ yf.T
    if measure == "dot_product":
        return np.round(d, 6) if kind == "float" else d.astype(np.int64)
    denom = _norms(xf)[:, None] * _norms(yf)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(denom == 0, 0.0, d / denom)
    return np.round(out, 6)


def _cells(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each marked cell; by the flat position, which numpy finds many times faster than both at once."""
    return np.divmod(np.flatnonzero(marked), marked.shape[1])


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) @ np.ones(x.shape[1])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


#: Room for rounding in the bounds: scores are rounded to 6 decimals, angles suffer near 0.
SLACK = 1e-6
STRIP_CELLS = 1 << 18


def _sizes(x: np.ndarray, y: np.ndarray, kind: str, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """One number a vector that bounds similarities: set bits, norm, or angle to the mean direction of both blocks."""
    if kind == "bits":
        return _ones(x), _ones(y)
    if measure == "hamming":
        return np.zeros(len(x)), np.zeros(len(y))
    xf, yf = x.astype(np.float64), y.astype(np.float64)
    nx, ny = _norms(xf), _norms(yf)
    if measure == "dot_product":
        return nx, ny
    ux, uy = (v / np.where(n == 0, 1.0, n)[:, None] for v, n in ((xf, nx), (yf, ny)))
    pivot = ux.sum(axis=0) + uy.sum(axis=0)
    length = np.sqrt(pivot @ pivot)
    pivot = pivot / length if length else pivot
    return np.arccos(np.clip(ux @ pivot, -1.0, 1.0)), np.arccos(np.clip(uy @ pivot, -1.0, 1.0))


def _window(low: float, high: float, kind: str, measure: str, f: int | None, floor: float) -> tuple[float, float]:
    """Sizes on the other side that can reach ``floor`` with a vector of size ``low`` to ``high``."""
    every = (-np.inf, np.inf)
    if kind == "bits" and measure == "hamming":  # the distance is at least the difference of ones
        return low - (f - floor), high + (f - floor)
    if floor <= SLACK or (kind == "array" and measure == "hamming"):
        return every
    if measure == "dot_product":
        if kind == "bits":  # at most the ones of the poorer vector are common
            return (floor, np.inf) if high >= floor else (np.inf, np.inf)
        need = floor - SLACK  # Cauchy and Schwarz
        return (need / high * (1 - SLACK), np.inf) if high > 0 else (np.inf, np.inf)
    least = floor - SLACK
    if kind == "bits":  # cosine <= sqrt(fewer ones / more ones)
        return low * least * least, high / (least * least)
    turn = np.arccos(min(1.0, least)) + 2e-6  # angles obey the triangle inequality
    return low - turn, high + turn


def _strips(x: np.ndarray, y: np.ndarray | None, kind: str, measure: str, f: int | None, floor):
    """``(rows, columns, scores, valid)`` for strips of the matrix of two blocks, or of one block with itself
    (``y`` is None; then ``valid`` marks each pair once). ``floor()`` is asked before each strip; rows that the
    bound keeps below it are left out, and scores under it may be -1. Scores hold until the next strip."""
    same = y is None
    sx, sy = _sizes(x, x if same else y, kind, measure)
    left = np.argsort(sx, kind="stable")
    right = left if same else np.argsort(sy, kind="stable")
    y = x if same else y
    sx, sy = sx[left], sy[right]
    xs, ys = x[left], y[right]
    step = max(1, STRIP_CELLS // max(1, len(ys)))
    room = np.empty(min(step, len(xs)) * len(ys)) if kind == "bits" and measure == "cosine" else None
    for lo in range(0, len(xs), step):
        hi = min(lo + step, len(xs))
        first, last = (lo + 1 if same else 0), len(ys)
        bound = floor()
        if bound is not None:
            least, most = _window(sx[lo], sx[hi - 1], kind, measure, f, bound)
            first = max(first, int(np.searchsorted(sy, least, "left")))
            last = int(np.searchsorted(sy, most, "right"))
        if first >= last:
            continue
        valid = None
        if same:
            valid = np.arange(first, last)[None, :] > np.arange(lo, hi)[:, None]
        yield left[lo:hi], right[first:last], _scores(xs[lo:hi], ys[first:last], kind, measure, f, bound, room), valid


def _blocks_of(pdf: pd.DataFrame, kind: str, f: int | None):
    """``(keys a, vectors a, keys b, vectors b)`` of a block-pair; no vectors b for a block with itself."""
    left = pdf[pdf["__side"] == 0]
    same = len(pdf) > 0 and int(pdf["__bi"].iloc[0]) == int(pdf["__bj"].iloc[0])
    right = left if same else pdf[pdf["__side"] == 1]
    if len(left) == 0 or len(right) == 0 or (same and len(left) < 2):
        return None
    cols = [c for c in pdf.columns if c.startswith("__w")] if kind == "bits" else "__vec"
    x = _matrix(left[cols], kind, f)
    ka = left["__key"].to_numpy(dtype=object)
    return (ka, x, ka, None) if same else (ka, x, right["__key"].to_numpy(dtype=object), _matrix(right[cols], kind, f))


def _no_pairs() -> pd.DataFrame:
    none = np.array([], dtype=object)  # untyped empty columns cannot be turned into strings
    return pd.DataFrame({"a": none, "b": none, "sim": np.array([], dtype=np.int64)})


def _best(parts: list[tuple], k: int) -> tuple:
    """The first ``k`` of the given pairs ``(a, b, sim)`` by (sim desc, a, b), as arrays."""
    a, b, sim = (np.concatenate(p) for p in zip(*parts))
    if len(sim) > k:
        kept = sim >= np.partition(sim, len(sim) - k)[len(sim) - k]
        a, b, sim = a[kept], b[kept], sim[kept]
    order = pd.DataFrame({"a": a, "b": b, "sim": sim}).sort_values(["sim", "a", "b"], ascending=[False, True, True], kind="mergesort").index[:k]
    return a[order], b[order], sim[order]


def _block_topk(kind: str, measure: str, f: int | None, k: int, floor=None):
    """A block-pair's first ``k`` pairs at or above ``floor``; the floor rises as better pairs are found."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _blocks_of(pdf, kind, f)
        if got is None:
            return _no_pairs()
        ka, x, kb, y = got
        bound, parts, held = floor, [], 0
        for rows, cols, s, valid in _strips(x, y, kind, measure, f, lambda: bound):
            hit = np.ones(s.shape, dtype=bool) if bound is None else s >= bound
            if valid is not None:
                hit &= valid
            i, j = _cells(hit)
            if not len(i):
                continue
            p, q = ka[rows[i]], kb[cols[j]]
            swap = p < q
            vals = s[i, j].astype(np.float64 if s.dtype.kind == "f" else np.int64)
            parts.append((np.where(swap, q, p), np.where(swap, p, q), vals))
            held += len(i)
            if held > 2 * k + STRIP_CELLS:
                parts = [_best(parts, k)]
                held = len(parts[0][2])
                bound = parts[0][2][-1]
        return pd.DataFrame(dict(zip(("a", "b", "sim"), _best(parts, k)))) if parts else _no_pairs()

    return run


def _route(vectors: DataFrame, key: str, vector: str, B: int, kind: str = "", f: int | None = None) -> DataFrame:
    if kind == "bits":
        words = sig_words(F.col(vector), f)
        payload = [w.alias(f"__w{i}") for i, w in enumerate(words)]
    else:
        payload = [F.col(vector).alias("__vec")]
    base = vectors.select(F.col(key).cast("string").alias("__key"), *payload).withColumn(
        "__blk", F.pmod(F.xxhash64("__key"), F.lit(B)).cast("int")
    )
    # a node in block i joins block-pairs (i, j): left side when i < j, right side when i > j, alone when i == j
    others = base.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    return others.select(
        F.least("__blk", "__j").alias("__bi"),
        F.greatest("__blk", "__j").alias("__bj"),
        F.when(F.col("__blk") <= F.col("__j"), 0).otherwise(1).alias("__side"),
        "__key",
        *[c for c in base.columns if c.startswith("__w") or c == "__vec"],
    )


def _block_values(kind: str, measure: str, f: int | None, k: int):
    """The ``k`` highest similarities of a block-pair, without their pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _blocks_of(pdf, kind, f)
        best, bound = np.array([], dtype=np.int64), None
        if got is not None:
            for _, _, s, valid in _strips(got[1], got[3], kind, measure, f, lambda: bound):
                vals = s.ravel() if valid is None else s[valid]
                vals = vals if bound is None else vals[vals > bound]  # ties with the k-th value change nothing
                best = np.concatenate([best.astype(vals.dtype), vals]) if len(best) else vals
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
                    bound = best.min()
        return pd.DataFrame({"sim": best})

    return run


def _block_count(n: int, block_size: int | None) -> int:
    """Blocks for ``n`` nodes: of at most 16,384, so that a node is sent to few block-pairs, but of 2,048 as long as
    sixteen of them are not reached, so that the block-pairs of a small graph occupy all cores."""
    if block_size is not None:
        return max(1, math.ceil(n / block_size))
    return max(1, math.ceil(n / 16384), min(16, math.ceil(n / 2048)))


def _sampled_floor(routed: DataFrame, n: int, k: int, kind: str, measure: str, f: int | None, schema: str, blocks: int):
    """``(estimate, proof)`` of a floor under the k-th best similarity, from the pairs inside blocks.

    Nodes are dealt by hash, so pairs inside blocks are a sample of all pairs; half as many again as the
    sample's share of k (and four deviations) give the estimate. ``proof()`` is the sample's own k-th value:
    more pairs can only raise the k-th value. None where the sample is too small."""
    inside = routed.filter("__bi = __bj").groupBy("__bi", "__bj")
    share = min(1.0, max(n / blocks - 1, 1.0) / (n - 1))
    want = math.ceil(1.5 * k * share + 4 * math.sqrt(k * share) + 4)

    def value_at(rank: int):
        sample = inside.applyInPandas(_block_values(kind, measure, f, rank), schema=f"sim {schema.rsplit(' ', 1)[1]}")
        got = sample.orderBy(F.col("sim").desc()).limit(rank).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("t")).first()
        return got["t"] if got["n"] == rank else None

    return (value_at(want) if want <= k else None), (lambda: value_at(k))


def top_pairs(
    vectors: DataFrame,
    k: int = 100_000,
    measure: str = "hamming",
    f: int | None = None,
    key: str = "node",
    vector: str = "sig",
    block_size: int | None = None,
    num_blocks: int | None = None,
    freeze: bool = True,
) -> DataFrame:
    """M7/M8: exact global top-k pairs ``(a, b, sim)`` with ``a > b``, ordered by (sim desc, a, b).

    Over several blocks, the pairs inside blocks give a floor under the k-th similarity
    (:func:`_sampled_floor`). One pass over all block-pairs emits what reaches it, each at most its first
    k; if these are fewer than k, the pass runs again with the floor that the sample proves, so the
    rows never depend on the estimate. A single block needs no floor.
    """
    SIM.check_measure(measure)
    kind = _vector_kind(vectors, vector, f)
    if kind == "bits" and f is None:
        raise ValueError("f is required for bit signatures")

    # frozen once: the count and all passes read the same n rows instead of recomputing the sketch
    # (``freeze=False`` when the caller's vectors already come from a checkpointed table)
    vectors = vectors.select(key, vector)
    if freeze:
        vectors = cut_lineage(vectors)
    n = vectors.count()
    B = int(num_blocks) if num_blocks is not None else _block_count(n, block_size)
    routed = _route(vectors, key, vector, B, kind, f)
    schema = PAIR_SCHEMA_DBL if _sim_type(kind, measure) == "double" else PAIR_SCHEMA_INT

    def scored(floor) -> DataFrame:
        return routed.groupBy("__bi", "__bj").applyInPandas(_block_topk(kind, measure, f, k, floor), schema=schema)

    if B == 1 or n < 2:
        found = scored(None)
    else:
        floor, proof = _sampled_floor(routed, n, k, kind, measure, f, schema, B)
        found = cut_lineage(scored(floor)) if floor is not None else None
        if found is None or found.count() < k:
            found = scored(proof())
    return found.orderBy(F.col("sim").desc(), "a", "b").limit(k)


def _block_ahead(kind: str, measure: str, f: int | None, bound: tuple):
    """Pairs of a block-pair that rank up to ``bound = (sim, a, b)``, the bound itself included."""
    sim, a, b = bound

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _blocks_of(pdf, kind, f)
        if got is None:
            return pd.DataFrame({"n": np.array([], dtype=np.int64)})
        ka, x, kb, y = got
        n = 0
        for rows, cols, s, valid in _strips(x, y, kind, measure, f, lambda: sim):
            above, tied = s > sim, s == sim
            if valid is not None:
                above, tied = above & valid, tied & valid
            i, j = _cells(tied)
            p, q = ka[rows[i]], kb[cols[j]]
            swap = p < q
            hi, lo = np.where(swap, q, p), np.where(swap, p, q)
            n += int(np.count_nonzero(above)) + int(((hi < a) | ((hi == a) & (lo <= b))).sum())
        return pd.DataFrame({"n": np.array([n], dtype=np.int64)})

    return run


def pairs_ahead(
    vectors: DataFrame, bound: tuple, measure: str = "hamming", f: int | None = None, key: str = "node", vector: str = "sig", block_size: int | None = None
) -> int:
    """How many of all node pairs rank up to ``bound = (sim, a, b)`` by (sim desc, a, b): each
    block-pair counts its own, so no ranking is stored and any rank can be asked for."""
    kind = _vector_kind(vectors, vector, f)
    blocks = _block_count(vectors.count(), block_size)
    grouped = _route(vectors, key, vector, blocks, kind, f).groupBy("__bi", "__bj")
    return grouped.applyInPandas(_block_ahead(kind, measure, f, bound), schema="n long").agg(F.sum("n")).first()[0] or 0


def band_values(sigs: DataFrame, f: int, bands: int, key: str = "node", sig: str = "sig") -> DataFrame:
    """``(key, sig, band, value)``: the signature cut into ``bands`` contiguous bit ranges."""
    if bands < 1 or bands > f:
        raise ValueError("bands must be in 1..f")
    words = sig_words(F.col(sig), f)
    widths = word_widths(f)
    bounds = [round(i * f / bands) for i in range(bands + 1)]
    exprs = []
    for j in range(bands):
        parts = []
        for kbit in range(bounds[j], bounds[j + 1]):
            wi, pos = divmod(kbit, 64)
            parts.append(F.shiftrightunsigned(words[wi], widths[wi] - 1 - pos).bitwiseAND(F.lit(1)).cast("string"))
        exprs.append(F.struct(F.lit(j).alias("band"), F.concat(*parts).alias("value")))
    return sigs.select(F.col(key).alias(key), F.col(sig).alias(sig), F.explode(F.array(*exprs)).alias("__b")).select(
        key, sig, "__b.band", "__b.value"
    )


#: Bands of which two at a time are a key; more bands would make too many keys.
PAIRED_BANDS = 8


def paired_values(sigs: DataFrame, f: int, radius: int, key: str = "node", sig: str = "sig") -> DataFrame:
    """``(key, sig, band, value)``: one row for every two of ``radius + 2`` bit ranges, ``value`` their hash.

    ``radius`` differing bits leave two of the ranges equal, so signatures that near share a value, and one of
    two ranges is shared by far fewer others than a single one is: a range of 16 bits has 65,536 values however many
    signatures there are. Equal hashes of unequal ranges only add a comparison.
    """
    words, widths = sig_words(F.col(sig), f), word_widths(f)
    bounds = [round(i * f / (radius + 2)) for i in range(radius + 3)]

    def pieces(first: int, last: int) -> list[Column]:
        out = []
        while first < last:
            word, at = divmod(first, 64)
            n = min(last - first, widths[word] - at)
            out.append(F.shiftrightunsigned(words[word], widths[word] - at - n).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1)))
            first += n
        return out

    ranges = [pieces(a, b) for a, b in zip(bounds, bounds[1:])]
    both = [(i, j) for j in range(len(ranges)) for i in range(j)]
    values = [F.xxhash64(F.lit(n), *ranges[i], *ranges[j]) for n, (i, j) in enumerate(both)]
    return sigs.select(F.col(key), F.col(sig), F.posexplode(F.array(*values)).alias("band", "value"))


def band_links(sigs: DataFrame, f: int, bands: int, key: str = "node", sig: str = "sig", chunk_rows: int = 1024) -> DataFrame:
    """``(a, b, sim)``: verified links at Hamming distance below ``bands``, none lost.

    Keys with equal signatures form a class, each linked to its smallest key (a star). Two classes
    are linked through their smallest keys if their signatures are that near; by pigeonhole they then
    share a band, or two of one band more (:func:`paired_values`, up to ``PAIRED_BANDS`` bands). Only one row of each class enters the buckets, and a large bucket is dealt to
    chunks of about ``chunk_rows`` that meet pairwise, so one task compares chunks, never a bucket.
    Keys without a signature have no link.
    """
    known = sigs.select(F.col(key).alias("__k"), F.col(sig).alias("__s")).filter("__s is not null")
    classes = cut_lineage(known.groupBy("__s").agg(F.min("__k").alias("__rep")))
    copies = known.join(classes, "__s").filter(F.col("__k") != F.col("__rep"))
    if bands < 1 or bands > f:
        raise ValueError("bands must be in 1..f")
    bv = band_values(classes, f, bands, "__rep", "__s") if bands > PAIRED_BANDS else paired_values(classes, f, bands - 1, "__rep", "__s")
    sizes = bv.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunked = bv.join(sizes, ["band", "value"]).withColumn("chunks", F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int"))
    chunked = chunked.withColumn("c", F.pmod(F.xxhash64("__rep"), F.col("chunks")).cast("int"))
    bucket = ["band", "value", "i", "j"]
    low = chunked.select("band", "value", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("chunks") - 1)).alias("j"), F.col("__rep").alias("x"), F.col("__s").alias("sx"))
    high = chunked.select("band", "value", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("i"), F.col("c").alias("j"), F.col("__rep").alias("y"), F.col("__s").alias("sy"))
    sim = SIM.hamming_similarity(sig_words(F.col("sx"), f), sig_words(F.col("sy"), f), f)
    near = low.join(high, bucket).filter((sim > f - bands) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    between = near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), sim.alias("sim")).distinct()
    return copies.select(F.col("__k").alias("a"), F.col("__rep").alias("b"), F.lit(f).alias("sim")).unionByName(between)


def near_duplicate_clusters(sigs: DataFrame, f: int, bands: int, key: str = "node", sig: str = "sig") -> DataFrame:
    """``(key, cluster)`` for every item linked to another one; cluster = smallest key of the component."""
    from graphsig.operators.components import connected_components

    links = band_links(sigs, f, bands, key, sig).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"))
    cc = connected_components(links)
    return cc.select(F.col("node").alias(key), F.col("component").alias("cluster"))
