"""Edge holdout, negative sampling and splits, all by hash order.

``randomSplit``/``rand`` depend on partitioning; here every choice is ordered by
``md5(seed|...)`` with full tie-breaking, and "the first n" is an exact selection through
:func:`graphsig.operators.graph.global_index` (range partitions + offsets), never a one-partition limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphsig.operators.graph import canonical_edges, global_index, nodes
from graphsig.session import cut_lineage


def hash_order(seed: int, *cols: str) -> F.Column:
    """60-bit non-negative order key from md5(seed|cols...)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_digits(seed: int, *cols: str) -> F.Column:
    """The 15 hex digits that :func:`hash_order` is the number of: the same order without making numbers."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])), 1, 15)


def _draw(seed: int, side: str) -> F.Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"), F.lit(side)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Exactly the first ``n`` rows in ``order`` (a total order), computed without a global limit."""
    if n <= 0:
        return df.limit(0)
    return global_index(df, order, out="__pos").filter(F.col("__pos") < n).drop("__pos")


def nth_by_hash(edges: DataFrame, n: int) -> tuple:
    """``(__h, src, dst)`` of the ``n``-th of the distinct edges in that order, of at least ``n``. Counts by the first four digits
    of the hash tell in which of 65,536 shares it is; only that share is sorted."""
    share = F.substring("__h", 1, 4)
    counts = edges.groupBy(share.alias("share")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 rows at most
    found = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter((F.col("before") < n) & (F.col("before") + F.col("n") >= n)).first()
    inside = edges.filter(share == found["share"]).select("__h", "src", "dst").orderBy("__h", "src", "dst").limit(n - found["before"])
    return tuple(inside.agg(F.max(F.struct("__h", "src", "dst"))).first()[0])


def _canonical_once(edges: DataFrame, canonical: bool) -> DataFrame:
    """Canonical edges as a table: each of the reads below would join and make distinct anew."""
    return edges.select("src", "dst") if canonical else cut_lineage(canonical_edges(edges))


def holdout_edges(
    edges: DataFrame, p: float = 0.1, seed: int = 42, keep_connected: bool = True, forest: DataFrame | None = None, canonical: bool = False
) -> tuple[DataFrame, DataFrame]:
    """H1: hold out ``int(p * |E|)`` edges; returns ``(held_out, remaining)``.

    With ``keep_connected`` the spanning-forest edges are never held out, so the remaining graph has
    the same components; too few removable edges is an error. ``canonical`` tells that the edges are a table of
    canonical edges already, which are then not made distinct again.
    """
    if not 0 < p < 1:
        raise ValueError("p must be in (0, 1)")
    e = _canonical_once(edges, canonical)
    total = e.count()
    n = int(p * total)
    removable = e
    if keep_connected:
        if forest is None:
            from graphsig.operators.components import spanning_forest

            forest = spanning_forest(e, seed)
        removable = e.join(forest.select("src", "dst"), ["src", "dst"], "left_anti")
        available = removable.count()
        if available < n:
            raise ValueError(f"only {available} edges can be removed without disconnecting the graph, {n} requested")
    if n and not keep_connected:  # the order is of hashes, so one edge tells the two sides apart: no sort, no join
        keyed = e.withColumn("__h", hash_digits(seed, "src", "dst"))
        h, src, dst = nth_by_hash(keyed, n)
        among = (F.col("__h") < h) | ((F.col("__h") == h) & ((F.col("src") < src) | ((F.col("src") == src) & (F.col("dst") <= dst))))
        return cut_lineage(keyed.filter(among).drop("__h")), keyed.filter(~among).drop("__h")
    keyed = removable.withColumn("__h", hash_order(seed, "src", "dst"))
    held = cut_lineage(first_n(keyed, n, ["__h", "src", "dst"]).drop("__h"))
    rest = e.join(held, ["src", "dst"], "left_anti")
    return held, rest


def negative_edges(
    graph_edges: DataFrame, n: int, seed: int = 42, node_table: DataFrame | None = None, oversample: float = 1.5, canonical: bool = False
) -> DataFrame:
    """H2: ``n`` distinct node pairs that are not edges of the graph (no loops), by hash order.

    Candidate ``i`` pairs node ``h(seed|i|0) mod N`` with node ``h(seed|i|1) mod N`` (nodes numbered in id
    order); the first ``n`` valid candidates by ``i`` are kept. More candidates are drawn until enough. ``canonical``
    as in :func:`holdout_edges`.
    """
    spark = graph_edges.sparkSession
    if n <= 0:
        return spark.createDataFrame([], "src string, dst string")
    e = _canonical_once(graph_edges, canonical)
    nd = node_table if node_table is not None else nodes(e)
    numbered = cut_lineage(global_index(nd.select(F.col("node")), ["node"], out="pos"))
    count = numbered.count()
    if count * (count - 1) // 2 - e.count() < n:
        raise ValueError("not enough non-edges")
    draws = max(16, int(math.ceil(n * oversample)))
    while True:
        cand = spark.range(draws).select(F.col("id").alias("i"))
        cand = cand.withColumn("pa", F.pmod(_draw(seed, "0"), F.lit(count))).withColumn("pb", F.pmod(_draw(seed, "1"), F.lit(count)))
        na = numbered.select(F.col("pos").alias("pa"), F.col("node").alias("na"))
        nb = numbered.select(F.col("pos").alias("pb"), F.col("node").alias("nb"))
        pairs = cand.join(na, "pa").join(nb, "pb").select("i", F.least("na", "nb").alias("src"), F.greatest("na", "nb").alias("dst"))
        pairs = pairs.filter(F.col("src") != F.col("dst")).join(e, ["src", "dst"], "left_anti")
        valid = cut_lineage(pairs.groupBy("src", "dst").agg(F.min("i").alias("i")))
        if valid.count() >= n:
            return first_n(valid, n, ["i"]).select("src", "dst")
        draws *= 2


def labelled_split(held: DataFrame, negatives: DataFrame, split: str) -> DataFrame:
    return held.select("src", "dst", F.lit(1).alias("label")).unionByName(negatives.select("src", "dst", F.lit(0).alias("label"))).withColumn(
        "split", F.lit(split)
    )


def link_split(
    edges: DataFrame,
    p: float = 0.1,
    seed: int = 42,
    keep_connected: bool = True,
    split: str = "test",
    negatives: bool = True,
    canonical: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Hold out positives and (optionally) the same number of negatives: ``(remaining_graph, labelled)``."""
    e = _canonical_once(edges, canonical)
    held, rest = holdout_edges(e, p, seed, keep_connected, canonical=True)
    if negatives:
        neg = negative_edges(e, held.count(), seed + 1, canonical=True)
    else:
        neg = held.limit(0)
    return cut_lineage(rest), labelled_split(held, neg, split)


def nested_link_split(
    edges: DataFrame, p: float = 0.1, seed: int = 42, keep_connected: bool = True, negatives: bool = True, canonical: bool = False
) -> dict[str, DataFrame]:
    """H3: G -> G_test (test edges removed) -> G_train (train edges removed from G_test)."""
    g_test, test = link_split(edges, p, seed, keep_connected, "test", negatives, canonical)
    g_train, train = link_split(g_test, p, seed + 100, keep_connected, "train", negatives, canonical=True)
    return {"G_test": g_test, "G_train": g_train, "test": test, "train": train, "labelled": test.unionByName(train)}


def random_split(df: DataFrame, train_size: float = 0.75, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """H4: ``part`` = 'train' for the first floor(train_size * n) rows in hash order, else 'selection'."""
    key_cols = key_cols or list(df.columns)
    n = df.count()
    n_train = int(math.floor(train_size * n))
    keyed = df.withColumn("__h", hash_order(seed, *key_cols))
    indexed = global_index(keyed, ["__h", *key_cols], out="__pos")
    return indexed.withColumn("part", F.when(F.col("__pos") < n_train, "train").otherwise("selection")).drop("__h", "__pos")


def stream_split(
    edges: DataFrame, base: float = 0.5, seed: int = 42, keep_connected: bool = True, negatives: bool = False
) -> tuple[DataFrame, DataFrame]:
    """H5: ``(base_graph, stream_edges)`` with ``1 - base`` of the edges held out as the stream. With
    ``negatives`` the stream has a ``label`` and as many non-edges of the whole graph (label 0) as edges."""
    e = _canonical_once(edges, False)
    held, rest = holdout_edges(e, 1 - base, seed, keep_connected, canonical=True)
    if negatives:
        fake = negative_edges(e, held.count(), seed + 1, canonical=True)
        held = labelled_split(held, fake, "stream").drop("split")
    return cut_lineage(rest), held
