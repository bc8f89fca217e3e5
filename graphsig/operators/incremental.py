"""Incremental sketch maintenance as edges arrive.

The neighbour sketch is additive: new edges add their endpoint hashes to the stored bit sums and
raise the stored counts, so the updated signature equals a full recompute (the count moves the
majority threshold). Walk and PageRank sketches are not additive: affected nodes are found by joins
and recomputed on the current graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.functions.hashing import HashExpr, bits_of_words_sql, md5_words
from graphsig.operators.graph import canonical_edges, half_edges, new_edges
from graphsig.operators.simhash import add_feature, bit_sums, majority


def apply_edges(state: DataFrame, graph: DataFrame, incoming: DataFrame, f: int, hash_words: HashExpr = md5_words, fresh: bool = False) -> DataFrame:
    """``(node, cnt, sums)`` after adding the incoming edges that the graph does not have yet.

    Each new undirected edge adds the other endpoint's hash to both endpoints (symmetric, unlike the
    reference's first-additive/second-recomputed update). Nodes seen for the first time start from
    their own id. Work is one aggregate over the new edges plus one outer merge with the state. With ``fresh`` the caller
    has found out that all of ``incoming`` are canonical edges that the graph does not have.
    """
    added = incoming if fresh else new_edges(graph, incoming)
    delta = bit_sums(half_edges(added).withColumnRenamed("nb", "feature"), "node", f, hash_words=hash_words)
    delta = delta.select("node", F.col("cnt").alias("dcnt"), F.col("sums").alias("dsums"))
    merged = state.join(delta, "node", "full_outer")
    zeros = F.array(*[F.lit(0).cast("long") for _ in range(f)])
    is_new = F.col("cnt").isNull()
    out = merged.select(
        "node",
        is_new.alias("__new"),
        (F.coalesce("cnt", F.lit(0).cast("long")) + F.coalesce("dcnt", F.lit(0).cast("long"))).alias("cnt"),
        F.zip_with(F.coalesce("sums", zeros), F.coalesce("dsums", zeros), lambda x, y: x + y).alias("sums"),
    )
    # nodes seen for the first time also get their own id, in the same projection (no second branch)
    own = out.withColumn("__own", F.array(*hash_words(F.col("node"), f)))
    with_own = F.expr(f"zip_with(sums, {bits_of_words_sql('__own', f)}, (s, b) -> s + b)")
    return own.select(
        "node",
        (F.col("cnt") + F.when(F.col("__new"), F.lit(1)).otherwise(F.lit(0))).cast("long").alias("cnt"),
        F.when(F.col("__new"), with_own).otherwise(F.col("sums")).alias("sums"),
    )


def recompute_nodes(graph: DataFrame, ids: DataFrame, f: int, hash_words: HashExpr = md5_words) -> DataFrame:
    """``(node, cnt, sums)`` of the given nodes only, from their current neighbourhoods."""
    keep = ids.select("node").distinct()
    half = half_edges(canonical_edges(graph)).join(keep, "node", "left_semi").withColumnRenamed("nb", "feature")
    state = bit_sums(half, "node", f, hash_words=hash_words)
    zeros = F.array(*[F.lit(0).cast("long") for _ in range(f)])
    state = keep.join(state, "node", "left").select(
        "node", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"), F.coalesce("sums", zeros).alias("sums")
    )
    return add_feature(state, F.col("node"), f, hash_words)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def stale_nodes(visits: DataFrame, incoming: DataFrame, walks: int) -> DataFrame:
    """Sources whose stored visits to either endpoint of a new edge reach ``int(0.5 * walks)``.

    One equi-join of the new endpoints with ``visits.visited``, instead of scanning every node's
    neighbourhood per edge.
    """
    limit = int(walks * 0.5)
    ends = endpoints(canonical_edges(incoming)).withColumnRenamed("node", "visited")
    return visits.join(ends, "visited").filter(F.col("cnt") >= F.lit(limit)).select(F.col("source").alias("node")).distinct()


def replace_rows(table: DataFrame, fresh: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Drop the rows of ``nodes`` from ``table`` and add their fresh rows (an anti-join merge)."""
    keep = table.join(nodes.select(F.col("node").alias(key)), key, "left_anti")
    return keep.unionByName(fresh)


def sketch_from_state(state: DataFrame, f: int) -> DataFrame:
    return majority(state, f).select("node", "cnt", "sig")
