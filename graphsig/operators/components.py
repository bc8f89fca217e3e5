"""Connected components, spanning forest and bipartiteness as iterative DataFrame jobs.

All three contract the graph in Borůvka rounds. In a round every component picks one of its edges (towards its
smallest neighbour, or the lightest), picks are followed to the root of their tree by pointer doubling, and
what is left of the edges is carried over to the roots: a round at least halves the components that are not
whole, and later rounds see only the edges that still cross. Picks make cycles of two components at most, the
smaller of which is the root. No node's neighbour list is ever collected. Lineage is cut with reliable checkpoints
into ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.operators.graph import canonical_edges
from graphsig.session import cut_lineage

#: A forest of the lightest edges, this many for each node, comes first where the graph has twice as many.
LIGHT = 2


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint with the table's measured size: a plain checkpoint hands on estimates, which joins multiply, so after some
    dozen rounds they are numbers of millions of digits. As many partitions as a shuffle has, because a
    broadcast join keeps those of a union, which would add up."""
    held = df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).persist()
    held.count()
    try:
        return cut_lineage(held)
    finally:
        held.unpersist()


def _both(e: DataFrame, *cols: str) -> DataFrame:
    """Edges (a, b, ...) from either end, as (c, to, ...)."""
    ends = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to"), *cols), F.struct(F.col("b").alias("c"), F.col("a").alias("to"), *cols))
    return e.select(F.explode(ends).alias("h")).select("h.*")


def _roots(picks: DataFrame) -> DataFrame:
    """picks(c, to, odd), one of each component, followed to the roots: (c, root, odd). ``odd`` is the parity of the way.

    Those who reached a root are set aside, so that a large tree's rows meet at its root only once.
    """
    p = _cut(picks)
    back = p.select(F.col("c").alias("l"), F.col("to").alias("l_to"))
    root = (F.col("l_to") == F.col("c")) & (F.col("c") < F.col("to"))
    first = p.join(back, F.col("to") == F.col("l")).select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to"), F.when(root, F.lit(0)).otherwise(F.col("odd")).alias("odd"), root.alias("done"))
    left = _cut(first)
    done = left.filter("done")
    while True:
        left = left.filter("not done")
        ahead = done.unionByName(left).select(F.col("c").alias("l"), F.col("to").alias("l_to"), F.col("odd").alias("l_odd"), F.col("done").alias("l_done"))
        moved = left.join(ahead, F.col("to") == F.col("l"))
        left = _cut(moved.select("c", F.col("l_to").alias("to"), F.col("odd").bitwiseXOR(F.col("l_odd")).alias("odd"), F.col("l_done").alias("done")))
        done = done.unionByName(left.filter("done"))
        if left.filter("not done").isEmpty():
            return done.select("c", F.col("to").alias("root"), "odd")


def _carried(e: DataFrame, roots: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """Edges (a, b, ...) between the roots of their ends: (a, b, turned, ...); ``turned`` is the parity of both ways."""
    ra = roots.select(F.col("c").alias("a"), F.col("root").alias("ra"), F.col("odd").alias("oa"))
    rb = roots.select(F.col("c").alias("b"), F.col("root").alias("rb"), F.col("odd").alias("ob"))
    turned = F.coalesce("oa", F.lit(0)).bitwiseXOR(F.coalesce("ob", F.lit(0))).alias("turned")
    return e.join(ra, "a", how).join(rb, "b", how).select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), turned, *cols)


def _followed(rounds: list[DataFrame]) -> DataFrame:
    """(c, root, odd) of each round -> of all: every first component with its last root. The small last rounds are joined first."""
    out = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        on = out.select(F.col("c").alias("root"), F.col("root").alias("next"), F.col("odd").alias("n_odd"))
        odd = F.col("odd").bitwiseXOR(F.coalesce("n_odd", F.lit(0)))
        out = _cut(earlier.join(on, "root", "left").select("c", F.coalesce("next", "root").alias("root"), odd.alias("odd")))
    return out


def _contract(edges: DataFrame, parity: bool, max_rounds: int = 64) -> tuple[DataFrame | None, DataFrame | None]:
    """Canonical edges -> ``(c, root, odd)`` of every node and ``(root)`` of the components with an odd cycle.

    With ``parity`` ``odd`` says whether the way to the root has an odd number of edges, else it is 0.
    """
    e = _cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(int(parity)).alias("odd")))
    rounds: list[DataFrame] = []
    cycles = None
    for _ in range(max_rounds):
        if e.isEmpty():
            return (_followed(rounds) if rounds else None), cycles
        picks = _both(e, "odd").groupBy("c").agg(F.min(F.struct("to", "odd")).alias("p")).select("c", "p.to", "p.odd")
        roots = _roots(picks)
        rounds.append(roots)
        carried = _carried(e, roots, "odd").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("odd").bitwiseXOR(F.col("turned")).alias("odd"))
        kept = _cut(carried.filter("a <> b or odd = 1").distinct()) if parity else _cut(carried.filter("a <> b").distinct())
        e = kept.filter("a <> b")
        if parity:
            # an odd edge inside a tree closes an odd cycle, which stays with the tree's later roots
            met = kept.filter("a = b").select(F.col("a").alias("root"))
            if cycles is not None:
                on = roots.select(F.col("c").alias("root"), F.col("root").alias("next"))
                met = met.unionByName(cycles.join(on, "root", "left").select(F.coalesce("next", "root").alias("root")))
            cycles = _cut(met.distinct())
    raise RuntimeError("connected components did not converge")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` where component is the smallest node id of the component."""
    found, _ = _contract(canonical_edges(edges), False, max_rounds)
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    least = found.groupBy("root").agg(F.min("c").alias("component"))
    return found.join(least, "root").select(F.col("c").alias("node"), "component")


def _edge_weight(seed: int) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("src"), F.col("dst")))


def _lightest(e: DataFrame, max_rounds: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(a, b, e) with a weighted edge ``e`` between components -> the chosen edges and the roots of each round."""
    chosen, rounds = [], []
    for _ in range(max_rounds):
        if e.isEmpty():
            return chosen, rounds
        best = _both(e, "e").groupBy("c").agg(F.min(F.struct("e", "to")).alias("p"))
        best = _cut(best.select("c", "p.to", "p.e"))
        chosen.append(best.select("e.src", "e.dst").distinct())
        rounds.append(_roots(best.select("c", "to", F.lit(0).alias("odd"))))
        e = _cut(_carried(e, rounds[-1], "e").filter("a <> b").select("a", "b", "e"))
    raise RuntimeError("the spanning forest did not converge")


def spanning_forest(edges: DataFrame, seed: int = 42, max_rounds: int = 64) -> DataFrame:
    """``(src, dst)`` edges of the minimum spanning forest under unique hash weights (Borůvka).

    Weights are ``(md5(seed|src|dst), src, dst)``, all distinct, so the forest is unique whatever the
    partitioning. Each round every component picks its lightest outgoing edge (a min-aggregate of
    structs), chosen edges join the forest, and components merge along them. Where a graph has many edges for each
    node, the forest of its lightest edges is made first: a heavier edge inside one of that forest's trees is the
    heaviest of a cycle, so only those between its trees take part in the other rounds.
    """
    weighted = canonical_edges(edges).select("src", "dst", F.unhex(_edge_weight(seed)).alias("w"))
    e = _cut(weighted.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("e")))
    total = e.count()
    count = e.select(F.explode(F.array("a", "b")).alias("c")).distinct().count()
    share = LIGHT * count / total if total else 1.0
    if share > 0.5:
        chosen, _ = _lightest(e, max_rounds)
    else:
        bound = F.lit(bytearray(int(share * 2**64).to_bytes(8, "big")))
        chosen, rounds = _lightest(e.filter(F.col("e.w") < bound), max_rounds)
        rest = e.filter(F.col("e.w") >= bound)
        if rounds:
            rest = _carried(rest, _followed(rounds), "e", how="left").filter("a <> b").select("a", "b", "e")
        chosen += _lightest(_cut(rest), max_rounds)[0]
    forest = edges.sparkSession.createDataFrame([], "src string, dst string")
    for some in chosen:
        forest = forest.unionByName(some)
    return forest


def is_bipartite(edges: DataFrame) -> bool:
    """Bipartite iff no component has an odd cycle.

    Self-loops make a graph non-bipartite, so they are checked before canonicalising.
    """
    loops = edges.filter(F.col("src").cast("string") == F.col("dst").cast("string")).limit(1).count()
    if loops:
        return False
    _, cycles = _contract(canonical_edges(edges), True)
    return cycles is None or cycles.isEmpty()


def bipartite_sides(edges: DataFrame) -> DataFrame:
    """``(node, side)``: a 2-colouring from parities; side is NULL in a non-bipartite component.

    A component's two colours are the copies ``(v, 0)`` and ``(v, 1)`` of its double cover, which is never made; side = 0
    when ``(v, 0)`` lies in the copy with the smaller node. Self-loops are dropped first (a loop node is never 2-colourable; see
    :func:`is_bipartite`).
    """
    found, cycles = _contract(canonical_edges(edges), True)
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, side int")

    def least(tag):
        return F.min(F.concat("c", F.lit("\u0001"), tag.cast("string")))

    # the copies of the root's (root, 0) and (root, 1): their smallest nodes
    copies = found.groupBy("root").agg(least(F.col("odd")).alias("c0"), least(1 - F.col("odd")).alias("c1"))
    marked = copies.join(cycles.withColumn("cycle", F.lit(True)), "root", "left")
    first = marked.select("root", F.when(F.col("cycle"), F.lit(None)).when(F.col("c0") < F.col("c1"), F.lit(0)).otherwise(F.lit(1)).alias("first"))
    return found.join(first, "root").select(F.col("c").alias("node"), F.col("odd").bitwiseXOR(F.col("first")).cast("int").alias("side"))
