import random

from pyspark.sql import functions as F

from conftest import SF_SMALL, edges_df
from graphsig.operators import components as C
from graphsig.operators import graph as G


def components_brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = {}
    for n in list(parent):
        out[n] = find(n)
    # component label = smallest member
    groups = {}
    for n, r in out.items():
        groups.setdefault(r, []).append(n)
    return {n: min(groups[r]) for n, r in out.items()}


def test_canonical_edges_duplicates(spark):
    e = G.canonical_edges(edges_df(spark, [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a")]))
    assert [tuple(r) for r in e.collect()] == [("a", "b")]


def test_orientation_filter(spark):
    e = G.canonical_edges(edges_df(spark, [("a", "b"), ("d", "c")]), orientation="filter")
    assert [tuple(r) for r in e.collect()] == [("a", "b")]


def test_degrees_stats_and_neighbours(spark):
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    deg = {r["node"]: r["degree"] for r in G.degrees(G.canonical_edges(e)).collect()}
    assert deg == {"a": 1, "b": 2, "c": 2, "d": 1}
    st = G.graph_stats(G.canonical_edges(e)).first()
    assert (st["node_count"], st["edge_count"], st["max_degree"]) == (4, 3, 2)
    closed = G.neighbours(G.canonical_edges(e)).collect()
    assert len(closed) == 3 * 2 + 4


def test_dense_ids(spark):
    e = G.canonical_edges(edges_df(spark, [("x", "y"), ("y", "z"), ("a", "z")]))
    nodes, rel = G.dense_ids(e)
    ids = {r["original_id"]: r["id"] for r in nodes.collect()}
    assert ids == {"a": 0, "x": 1, "y": 2, "z": 3}
    assert G.check_dense_ids(nodes)
    assert sorted(tuple(r) for r in rel.collect()) == [(0, 3), (1, 2), (2, 3)]
    assert not G.check_dense_ids(spark.createDataFrame([(0,), (2,)], "id long"))


def test_global_index_independent_of_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(13)
    idx = {r["v"]: r["idx"] for r in G.global_index(df, ["v"], out="idx", partitions=5).collect()}
    assert idx == {v: v for v in range(1000)}


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, v long").repartition(7)
    got = {r["k"]: r["c"] for r in G.running_total(df, ["k"], "v", "c", partitions=4).collect()}
    acc, want = 0, {}
    for i in range(50):
        acc += i % 3
        want[i] = acc
    assert got == want


def test_adjacency_index_hub_buckets(spark):
    star = [("hub", f"leaf{i:03d}") for i in range(200)]
    adj = G.adjacency_index(G.canonical_edges(edges_df(spark, star)), bucket_size=16)
    hub = adj.filter("node = 'hub'").collect()
    assert sorted(r["idx"] for r in hub) == list(range(1, 202))
    assert {r["nb"] for r in hub} == {"hub"} | {f"leaf{i:03d}" for i in range(200)}
    assert {r["nb_deg"] for r in hub if r["nb"] != "hub"} == {2}


def test_membership_and_append(spark):
    g = G.canonical_edges(edges_df(spark, [("a", "b"), ("b", "c")]))
    pairs = spark.createDataFrame([("b", "a"), ("a", "c")], "a string, b string")
    flags = {(r["a"], r["b"]): r["is_edge"] for r in G.mark_edges(pairs, g).collect()}
    assert flags == {("b", "a"): 1, ("a", "c"): 0}
    grown = G.append_edges(g, edges_df(spark, [("c", "b"), ("c", "d")]))
    assert sorted(tuple(r) for r in grown.collect()) == [("a", "b"), ("b", "c"), ("c", "d")]


def test_connected_components_vs_brute_force(spark):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(110)]
    got = {r["node"]: r["component"] for r in C.connected_components(edges_df(spark, pairs)).collect()}
    assert got == components_brute(pairs)


def test_two_components_and_path(spark):
    got = {r["node"]: r["component"] for r in C.connected_components(edges_df(spark, [("a", "b"), ("c", "d")])).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}
    long_path = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(300)]
    comp = C.connected_components(edges_df(spark, long_path))
    assert comp.select("component").distinct().collect()[0][0] == "p0000"


def test_spanning_forest_properties(spark):
    rng = random.Random(3)
    pairs = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(150)]
    forest = [tuple(r) for r in C.spanning_forest(edges_df(spark, pairs), seed=1).collect()]
    comps = components_brute(pairs)
    n_nodes, n_comps = len(comps), len(set(comps.values()))
    assert len(forest) == n_nodes - n_comps
    assert components_brute(forest) == comps  # spans every component, hence acyclic with n - c edges
    again = [tuple(r) for r in C.spanning_forest(edges_df(spark, pairs).repartition(5), seed=1).collect()]
    assert sorted(again) == sorted(forest)


def test_path_of_four_every_edge_in_forest(spark):
    path = [("a", "b"), ("b", "c"), ("c", "d")]
    assert sorted(tuple(r) for r in C.spanning_forest(edges_df(spark, path)).collect()) == path


def test_bipartite(spark):
    assert C.is_bipartite(edges_df(spark, [("a", "b"), ("b", "c"), ("c", "d")]))
    assert not C.is_bipartite(edges_df(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert not C.is_bipartite(edges_df(spark, [("a", "b"), ("a", "a")]))
    sides = {r["node"]: r["side"] for r in C.bipartite_sides(edges_df(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x")])).collect()}
    assert sides["a"] == sides["c"] != sides["b"]
    assert sides["x"] is None


def test_reference_ratings_graph_is_bipartite(spark):
    """The reference's own test: the ratings edge list is a bipartite graph."""
    from graphsig.sources.files import ratings_to_edges
    from graphsig.sources.tables import ratings_standin

    assert C.is_bipartite(ratings_to_edges(ratings_standin(spark, SF_SMALL), 3.0))


def test_contraction_against_brute_force_carries_only_crossing_edges(spark, monkeypatch):
    """Dense, sparse and odd-cycled parts: forest, sides and components by brute force; no double cover is
    made and no round after the first carries inner edges again."""
    import hashlib
    import random

    rng = random.Random(5)
    wide = [(f"l{i}", f"r{j}") for i in range(12) for j in range(30)]  # many edges for each node, bipartite
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)]
    odd = [("o1", "o2"), ("o2", "o3"), ("o3", "o1"), ("o3", "o4")]
    loose = [(f"x{rng.randrange(40)}", f"x{rng.randrange(40)}") for _ in range(30)]
    pairs = sorted({(min(p), max(p)) for p in wide + path + odd + loose if p[0] != p[1]})
    rows: list[int] = []
    cut = C.cut_lineage

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(C, "cut_lineage", counted)

    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    forest = []
    for _, s, d in sorted((hashlib.md5(f"42|{s}|{d}".encode()).hexdigest(), s, d) for s, d in pairs):
        if find(s) != find(d):
            parent[find(s)] = find(d)
            forest.append((s, d))
    assert sorted(tuple(r) for r in C.spanning_forest(edges_df(spark, pairs)).collect()) == sorted(forest)

    near: dict[str, list[str]] = {}
    for s, d in pairs:
        near.setdefault(s, []).append(d)
        near.setdefault(d, []).append(s)
    colour: dict[str, int] = {}
    least: dict[str, str] = {}
    for start in sorted(near):
        if start in colour:
            continue
        colour[start], todo, members, clash = 0, [start], [start], False
        for v in todo:
            for w in near[v]:
                if w not in colour:
                    colour[w] = 1 - colour[v]
                    todo.append(w)
                    members.append(w)
                clash |= colour[w] == colour[v]
        for v in members:
            least[v] = start
            colour[v] = None if clash else colour[v]
            colour[v] = colour[v] if colour[v] is not None else -1
    rows.clear()
    sides = {r["node"]: -1 if r["side"] is None else r["side"] for r in C.bipartite_sides(edges_df(spark, pairs)).collect()}
    assert sides == colour
    assert max(rows) <= len(pairs)
    rows.clear()
    assert {r["node"]: r["component"] for r in C.connected_components(edges_df(spark, pairs)).collect()} == least
    assert sum(n > len(near) for n in rows) <= 1  # all edges once, then at most one row for each node
