"""Graph shaping on edge DataFrames.

An undirected simple graph is ``edges(src STRING, dst STRING)`` with ``src < dst``, no loops and
no duplicates. The symmetric view ``(node, nb)`` is derived on demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst", orientation: str = "sort") -> DataFrame:
    """One row per undirected edge, ``src < dst``, self-loops dropped.

    ``orientation="filter"`` keeps only rows already given with ``src < dst`` (edges given the other
    way round are skipped, as the reference's stream replay does).
    """
    a, b = F.col(src).cast("string"), F.col(dst).cast("string")
    if orientation == "sort":
        out = edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    elif orientation == "filter":
        out = edges.select(a.alias("src"), b.alias("dst")).filter(F.col("src") < F.col("dst"))
    else:
        raise ValueError(f"unknown orientation {orientation}")
    return out.filter(F.col("src") != F.col("dst")).dropna().distinct()


def half_edges(edges: DataFrame) -> DataFrame:
    """Both directions of each canonical edge as ``(node, nb)``; disjoint halves, so no distinct.

    One ``explode`` over a single read of the edge table (a union of two projections would plan the
    edge table's whole lineage twice).
    """
    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nb")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("nb")),
    )
    return edges.select(F.explode(both).alias("__h")).select("__h.node", "__h.nb")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def with_self_loops(nbrs: DataFrame, node_table: DataFrame | None = None) -> DataFrame:
    """Closed neighbourhoods: add ``(v, v)`` for every node (loops live only in this view)."""
    node_table = node_table if node_table is not None else nbrs.select("node").distinct()
    return nbrs.select("node", "nb").unionAll(node_table.select("node", F.col("node").alias("nb"))).distinct()


def neighbours(edges: DataFrame, closed: bool = True) -> DataFrame:
    """Neighbour rows ``(node, nb)``; with ``closed`` every node also lists itself."""
    h = half_edges(edges)
    if not closed:
        return h
    return h.unionAll(nodes(edges).select("node", F.col("node").alias("nb")))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: number of distinct neighbours, loops excluded."""
    return half_edges(edges).groupBy("node").agg(F.count(F.lit(1)).cast("long").alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: node count, edge count, max and mean degree."""
    deg = degrees(edges)
    return deg.agg(
        F.count(F.lit(1)).cast("long").alias("node_count"),
        (F.sum("degree") / 2).cast("long").alias("edge_count"),
        F.max("degree").cast("long").alias("max_degree"),
        F.round(F.avg("degree"), 6).alias("mean_degree"),
    )


def check_dense_ids(node_ids: DataFrame, column: str = "id") -> bool:
    """True when the ids are exactly 0..n-1 (one aggregate, three scalars to the driver)."""
    row = node_ids.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_distinct(column).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if row["rows"] == 0:
        return True
    return row["lo"] == 0 and row["hi"] == row["n"] - 1 and row["n"] == row["rows"]


def assert_dense_ids(node_ids: DataFrame, column: str = "id") -> None:
    if not check_dense_ids(node_ids, column):
        raise AssertionError("The node indexing is wrong.")


def global_index(df: DataFrame, order_cols: list[str], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based position of each row in ``order_cols`` order, without a one-partition window.

    Range-partition and sort, tag rows with (partition, position), freeze the tags with a reliable
    checkpoint, then add per-partition offsets (a table with one row per partition, so broadcast).
    """
    from graphsig.session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = cut_lineage(ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(out, (F.col("__off") + F.col("__mid") - F.col("__m0")).cast("long"))
        .drop("__pid", "__mid", "__n", "__m0", "__off")
    )


def running_total(df: DataFrame, order_cols: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order_cols`` order (a total order), without a
    one-partition window: range partitions, per-partition totals as broadcast offsets, then a window
    inside each range partition only."""
    from graphsig.session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id()))
    totals = tagged.groupBy("__pid").agg(F.sum(value).alias("__t"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tagged.join(F.broadcast(offsets), "__pid").withColumn(out, F.col("__off") + F.sum(value).over(inside)).drop("__pid", "__off")


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relabel nodes to 0..n-1 in ``original_id`` order; returns ``(nodes(id, original_id), edges(src, dst))``."""
    node_table = global_index(nodes(edges).select(F.col("node").alias("original_id")), ["original_id"], out="id").select("id", "original_id")
    a = node_table.select(F.col("original_id").alias("src"), F.col("id").alias("src_id"))
    b = node_table.select(F.col("original_id").alias("dst"), F.col("id").alias("dst_id"))
    relabelled = edges.join(a, "src").join(b, "dst").select(
        F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst")
    )
    return node_table, relabelled


def mark_edges(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", flag: str = "is_edge") -> DataFrame:
    """Left join a pair table with a canonical edge table: adds INT ``flag`` 0/1."""
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.lit(1).alias(flag))
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    joined = pairs.withColumn("__s", lo).withColumn("__d", hi).join(e, ["__s", "__d"], "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(0))).drop("__s", "__d")


def keep_edges(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", present: bool = True) -> DataFrame:
    """Semi (``present``) or anti join of a pair table against the canonical edge table."""
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    keyed = pairs.withColumn("__s", lo).withColumn("__d", hi)
    return keyed.join(e, ["__s", "__d"], "left_semi" if present else "left_anti").drop("__s", "__d")


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Add new undirected edges that are not present yet."""
    fresh = canonical_edges(new).join(edges, ["src", "dst"], "left_anti")
    return edges.unionByName(fresh)


def new_edges(edges: DataFrame, incoming: DataFrame, orientation: str = "sort") -> DataFrame:
    """Incoming edges (canonicalised) that the graph does not have yet."""
    return canonical_edges(incoming, orientation=orientation).join(edges, ["src", "dst"], "left_anti")


def adjacency_index(edges: DataFrame, closed: bool = True, bucket_size: int = 1_000_000) -> DataFrame:
    """``(node, idx, nb, nb_deg)``: neighbours numbered 1..deg per node, plus the neighbour's degree.

    A hub is split into ``ceil(deg / bucket_size)`` buckets by neighbour key; neighbours are numbered
    inside each (node, bucket) and shifted by the sizes of the earlier buckets, so no task ever holds
    more than about ``bucket_size`` rows of one node. Numbering order is (bucket, nb). When no node
    exceeds ``bucket_size`` (one scalar aggregate tells), every node has a single bucket and one
    window per node gives the same numbering with fewer shuffles.
    """
    from graphsig.functions.mixing import node_key

    from graphsig.session import cut_lineage

    nbrs = neighbours(edges, closed=closed)
    deg = cut_lineage(nbrs.groupBy("node").agg(F.count(F.lit(1)).cast("long").alias("deg")))
    nb_deg = deg.select(F.col("node").alias("nb"), F.col("deg").alias("nb_deg"))
    max_deg = deg.agg(F.max("deg")).first()[0] or 0
    if max_deg <= bucket_size:
        numbered = nbrs.withColumn("idx", F.row_number().over(Window.partitionBy("node").orderBy("nb")).cast("long"))
        return numbered.join(nb_deg, "nb").select("node", "idx", "nb", "nb_deg")
    buckets = F.pmod(node_key(F.col("nb")), F.ceil(F.col("deg") / F.lit(bucket_size)).cast("long"))
    keyed = nbrs.join(deg, "node").withColumn("bucket", buckets)
    local = keyed.withColumn("li", F.row_number().over(Window.partitionBy("node", "bucket").orderBy("nb")).cast("long"))
    sizes = keyed.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("off", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long")).drop("n")
    numbered = local.join(offsets, ["node", "bucket"]).select("node", (F.col("off") + F.col("li")).alias("idx"), "nb")
    return numbered.join(nb_deg, "nb").select("node", "idx", "nb", "nb_deg")
