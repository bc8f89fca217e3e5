"""Embedding models: neighbour, random-walk and PageRank SimHash sketches, and NodeSketch.

A model turns an edge table into a state; ``embedding(state)`` gives ``(node, sig)``. Models that
support updates take new edges and return a new state (U6/U7); the others are refitted (U8).
Each fit is independent of earlier fits (no hidden state is carried between graphs).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.functions.hashing import check_bits
from graphsig.operators import incremental as U
from graphsig.operators.graph import append_edges, canonical_edges, new_edges
from graphsig.operators.simhash import bit_sums, majority, sketch_state
from graphsig.operators.walks import pagerank_bit_sums, random_walk_visits
from graphsig.session import cut_lineage

#: Visits are far more than the graph: they are walked again when read, and written down once in so many updates.
FROZEN = 10


@dataclass
class SketchState:
    mode: str
    f: int
    edges: DataFrame
    sums: DataFrame  # (node, cnt, sums)
    visits: DataFrame | None = None  # walk mode: (source, visited, cnt), walked again when read
    extra: dict = field(default_factory=dict)

    def embedding(self) -> DataFrame:
        return majority(self.sums, self.f).select("node", "sig")


@dataclass
class SimHashSketch:
    """SimHash sketch model: neighbours (default), random-walk visits, or personalized PageRank."""

    dimensions: int = 32
    seed: int = 42
    random_walk_length: int | None = None
    number_of_walks: int = 1000
    use_page_rank: bool = False
    ppr_iterations: int | None = None  # None: to the tolerance of the reference
    refresh_endpoints: bool = False  # walk updates also redo the ends of every new edge
    supports_update: bool = True

    def __post_init__(self) -> None:
        if self.random_walk_length and self.use_page_rank:
            raise ValueError("walk features and PageRank features exclude each other")
        if self.random_walk_length is not None and self.random_walk_length < 1:
            raise ValueError("random_walk_length must be at least 1")
        check_bits(self.dimensions)

    @property
    def mode(self) -> str:
        if self.use_page_rank:
            return "ppr"
        return "walk" if self.random_walk_length else "neighbours"

    @property
    def name(self) -> str:
        return "SimHashSketch"

    # -- fitting --------------------------------------------------------------------------

    def fit_visits(self, edges: DataFrame, visits: DataFrame) -> SketchState:
        """Walk mode with ``(source, visited, cnt)`` counted elsewhere, such as by several models at once. The sums are made when read."""
        visits = visits.filter("cnt > 0")
        return SketchState("walk", self.dimensions, edges, self._walk_sums(visits), visits=visits)

    def _walk_sums(self, visits: DataFrame) -> DataFrame:
        feats = visits.select(F.col("source").alias("node"), F.col("visited").alias("feature"), F.col("cnt").alias("w"))
        return bit_sums(feats, "node", self.dimensions, weight="w", placed="together")  # visits are counted by source

    def _ppr_sums(self, edges: DataFrame, node_table: DataFrame | None = None) -> DataFrame:
        return pagerank_bit_sums(edges, self.dimensions, iterations=self.ppr_iterations, node_table=node_table)

    def fit(self, edges: DataFrame, node_table: DataFrame | None = None, canonical: bool = False) -> SketchState:
        """``canonical`` tells that the edges are a table of canonical edges already, which is then not made distinct and written again."""
        e = edges.select("src", "dst") if canonical else cut_lineage(canonical_edges(edges))
        f = self.dimensions
        if self.mode == "neighbours":
            return SketchState("neighbours", f, e, cut_lineage(sketch_state(e, f, canonical=False, node_table=node_table)))
        if self.mode == "walk":
            visits = random_walk_visits(e, self.random_walk_length, self.number_of_walks, self.seed, sources=node_table)
            return SketchState("walk", f, e, cut_lineage(self._walk_sums(visits)), visits=visits)
        return SketchState("ppr", f, e, cut_lineage(self._ppr_sums(e, node_table)))

    # -- updates (U6) --------------------------------------------------------------------

    def update(self, state: SketchState, incoming: DataFrame, edges_now: DataFrame | None = None) -> SketchState:
        """Apply incoming edges. A caller that already holds the grown graph passes ``edges_now``;
        ``incoming`` is then taken as the canonical new edges (no second anti-join)."""
        if edges_now is None:
            fresh = cut_lineage(new_edges(state.edges, incoming))
            edges_now = cut_lineage(state.edges.unionByName(fresh))
        else:
            fresh = incoming
        f = self.dimensions
        if self.mode == "neighbours":
            sums = U.apply_edges(state.sums, state.edges, fresh, f, fresh=True)
            return SketchState("neighbours", f, edges_now, cut_lineage(sums))
        if self.mode == "walk":
            # nodes that the graph did not have, and nodes whose walks often met an end of a new edge
            added = U.endpoints(fresh)
            if not self.refresh_endpoints:
                added = added.join(state.sums.select("node"), "node", "left_anti")
            stale = cut_lineage(U.stale_nodes(state.visits, fresh, self.number_of_walks).unionByName(added).distinct())
            fresh_visits = random_walk_visits(edges_now, self.random_walk_length, self.number_of_walks, self.seed, sources=stale)
            visits = U.replace_rows(state.visits, fresh_visits, stale, "source")
            updates = state.extra.get("updates", 0) + 1
            if updates % FROZEN == 0:
                visits = cut_lineage(visits)
            fresh_sums = self._walk_sums(fresh_visits)
            sums = cut_lineage(U.replace_rows(state.sums, fresh_sums, stale, "node"))
            return SketchState("walk", f, edges_now, sums, visits=visits, extra={"stale": stale, "updates": updates})
        ends = U.endpoints(fresh)
        fresh_sums = self._ppr_sums(edges_now).join(ends, "node", "left_semi")
        sums = cut_lineage(U.replace_rows(state.sums, fresh_sums, ends, "node"))
        return SketchState("ppr", f, edges_now, sums)

    def fit_or_update(self, state: SketchState | None, edges: DataFrame, added: DataFrame | None = None, canonical: bool = False) -> SketchState:
        """Fit when there is no state yet, then apply ``added`` edges if given."""
        st = state if state is not None else self.fit(edges, canonical=canonical)
        return self.update(st, added) if added is not None else st


@dataclass
class NodeSketchModel:
    """NodeSketch baseline (recursive min-hash sketching); no incremental update: refit (U8)."""

    dimensions: int = 128
    iterations: int = 4
    decay: float = 0.2
    seed: int = 42
    supports_update: bool = False

    @property
    def name(self) -> str:
        return "NodeSketch"

    def fit(self, edges: DataFrame, node_table: DataFrame | None = None, canonical: bool = False):
        from graphsig.operators.nodesketch import recursive_node_sketch

        e = edges.select("src", "dst") if canonical else cut_lineage(canonical_edges(edges))
        return cut_lineage(recursive_node_sketch(e, self.dimensions, self.iterations, self.decay, self.seed, node_table=node_table))


def refit_or_update(model, state, edges_now: DataFrame, incoming: DataFrame, grown: bool = False):
    """U8: models without update support are refitted on the grown graph.

    With ``grown`` the caller has already added ``incoming`` (canonical, new) to ``edges_now``.
    """
    if getattr(model, "supports_update", False):
        return model.update(state, incoming, edges_now) if grown else model.update(state, incoming)
    return model.fit(edges_now if grown else append_edges(canonical_edges(edges_now), incoming))
