import hashlib
import random

import pytest
from conftest import edges_df
from graphsig.operators import walks as W
from reference_model import closed_neighbourhoods


def walk_brute(pairs, length, walks, seed):
    nb = {n: sorted(s) for n, s in closed_neighbourhoods(pairs).items()}
    visits = {}
    for src in nb:
        for w in range(walks):
            cur = src
            for step in range(length):
                h = int(hashlib.md5(f"{seed}|{src}|{w}|{step}".encode()).hexdigest()[:8], 16)
                cur = nb[cur][h % len(nb[cur])]
                visits[(src, cur)] = visits.get((src, cur), 0) + 1
    return visits


def test_walk_visits_match_brute_force(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(60)]
    got = {(r["source"], r["visited"]): r["cnt"] for r in W.random_walk_visits(edges_df(spark, pairs), 3, 20, 42).collect()}
    assert got == walk_brute(pairs, 3, 20, 42)


def test_visit_totals_and_partition_independence(spark):
    pairs = [("hub", f"l{i}") for i in range(40)] + [("l1", "l2")]
    v1 = W.random_walk_visits(edges_df(spark, pairs), 2, 10, 7)
    totals = {r["source"]: r["t"] for r in v1.groupBy("source").agg({"cnt": "sum"}).withColumnRenamed("sum(cnt)", "t").collect()}
    assert set(totals.values()) == {20}
    v2 = W.random_walk_visits(edges_df(spark, pairs).repartition(7), 2, 10, 7, bucket_size=8)
    # with hub buckets the numbering order changes, but every walk still has `length` visits
    assert v2.groupBy().sum("cnt").first()[0] == 41 * 20


def ppr_brute(pairs, iterations, num=85, den=100, scale=10**12):
    nb = {n: sorted(s) for n, s in closed_neighbourhoods(pairs).items()}
    out = {}
    for s in nb:
        mass = {s: scale}
        for _ in range(iterations):
            new = {s: scale * (den - num) // den}
            for u, m in mass.items():
                c = (m * num) // (den * len(nb[u]))
                for v in nb[u]:
                    new[v] = new.get(v, 0) + c
            mass = new
        for v, m in mass.items():
            out[(s, v)] = m
    return out


def test_ppr_exact_integer_iteration(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "e")]
    got = {(r["source"], r["node"]): r["mass"] for r in W.personalized_pagerank(edges_df(spark, pairs), iterations=6).collect()}
    want = ppr_brute(pairs, 6)
    assert got == want
    per_source = {}
    for (s, _), m in got.items():
        per_source[s] = per_source.get(s, 0) + m
    assert all(abs(t - 10**12) < 10**6 for t in per_source.values())


def test_ppr_tolerance_stop(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "e")]
    capped = {(r["source"], r["node"]): r["mass"] for r in W.personalized_pagerank(edges_df(spark, pairs), iterations=200, tol=1e-9).collect()}
    longer = {(r["source"], r["node"]): r["mass"] for r in W.personalized_pagerank(edges_df(spark, pairs), iterations=60).collect()}
    assert capped.keys() == longer.keys()
    assert max(abs(capped[k] - longer[k]) for k in capped) <= 10**4  # within 1e-8 of 1.0


def test_nodes_without_edges_stay(spark):
    from graphsig.plans.models import SimHashSketch

    edges = edges_df(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("iso",)], "node string")
    for model in (SimHashSketch(32), SimHashSketch(32, random_walk_length=2, number_of_walks=5), SimHashSketch(32, use_page_rank=True, ppr_iterations=3)):
        assert {r["node"] for r in model.fit(edges, nodes).embedding().collect()} == {"a", "b", "c", "iso"}


def test_ppr_sums_follow_the_masses(spark):
    """Bit sums by the recurrence equal the sums over all (source, node) masses, hub and lone node included."""
    f = 32
    pairs = [("hub", f"l{i}") for i in range(25)] + [("l1", "l2"), ("l2", "x"), ("x", "y")]
    masses = ppr_brute(pairs, 6)
    lone = spark.createDataFrame([("lone",), ("x",)], "node string")
    got = {r["node"]: r for r in W.pagerank_bit_sums(edges_df(spark, pairs), f, iterations=6, node_table=lone).collect()}
    masses[("lone", "lone")] = 10**12
    want = {}
    for (source, node), m in masses.items():
        word = int.from_bytes(hashlib.md5(node.encode()).digest()[-f // 8 :], "big")
        sums = want.setdefault(source, [0] * (f + 1))
        for k in range(f):
            sums[k] += m * (word >> (f - 1 - k) & 1)
        sums[f] += m
    assert got.keys() == want.keys()
    for node, sums in want.items():
        row = [*got[node]["sums"], got[node]["cnt"]]
        assert max(abs(x / W.PPR_SUM_SCALE - y / 10**12) for x, y in zip(row, sums)) < 1e-8


def test_ppr_stops_at_an_absolute_error(spark):
    """Every source's masses end within 1e-5 of the limit (a move of 1e-6 leaves at most a/(1-a) times that), on
    graphs of two sizes: the stop does not get laxer as a graph grows."""
    small = [(f"u{i}", f"p{j}") for i in range(4) for j in range(4)]
    large = [(f"u{i}", f"p{(i * k + k) % 40}") for i in range(60) for k in (1, 3, 7)]
    for pairs in (small, large):
        limit = ppr_brute(sorted(set(pairs)), 60, 1, 2)
        names = sorted({x for e in pairs for x in e})[:5]
        sources = spark.createDataFrame([(x,) for x in names], "node string")
        got = {(r["source"], r["node"]): r["mass"] for r in W.personalized_pagerank(edges_df(spark, pairs), (1, 2), sources=sources).collect()}
        for s in names:
            assert sum(abs(m - got.get((s, v), 0)) for (x, v), m in limit.items() if x == s) < 10**7
    assert W.pagerank_rounds() == 90 and W.pagerank_rounds(n=12) < 90
    with pytest.raises(RuntimeError):
        W.pagerank_rounds((99, 100), limit=100)


def test_ppr_sums_stop_at_an_absolute_error(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "e")] + [(f"x{i}", f"x{i + 1}") for i in range(12)]
    got, far = ({r["node"]: [*r["sums"], r["cnt"]] for r in W.pagerank_bit_sums(edges_df(spark, pairs), 32, (1, 2), iterations=n).collect()} for n in (None, 40))
    assert max(abs(x - y) for v in far for x, y in zip(got[v], far[v], strict=True)) < 1e-5 * W.PPR_SUM_SCALE


def test_shared_walks_equal_single_ones(spark):
    """One walk table of the longest walks and most walkers holds every setting's visits."""
    pairs = [("hub", f"l{i}") for i in range(12)] + [("l1", "l2"), ("l2", "x"), ("x", "y")]
    settings = [(2, 5), (4, 5), (3, 9), (1, 2)]
    lone = spark.createDataFrame([("lone",), ("x",), ("hub",)], "node string")
    shared = W.shared_walk_visits(edges_df(spark, pairs), settings, 7, sources=lone).collect()
    for i, (length, walks) in enumerate(settings):
        single = W.random_walk_visits(edges_df(spark, pairs), length, walks, 7, sources=lone).collect()
        assert {(r["source"], r["visited"]): r[f"c{i}"] for r in shared if r[f"c{i}"]} == {(r["source"], r["visited"]): r["cnt"] for r in single}


def test_sweep_shares_walks(spark):
    """Precision of every model is what the model alone gets."""
    from graphsig.plans import evaluation as P
    from graphsig.plans.models import SimHashSketch

    pairs = [(f"u{i}", f"p{(i * k) % 11}") for i in range(14) for k in (1, 2, 5)]
    models = [SimHashSketch(32), SimHashSketch(32, random_walk_length=2, number_of_walks=6), SimHashSketch(32, random_walk_length=3, number_of_walks=4)]
    rows = P.sweep(edges_df(spark, pairs), [(m.name, m) for m in models], "toy", keep_connected=False).collect()
    split = P.make_split(edges_df(spark, pairs), seed=42, keep_connected=False, negatives=False)
    for row, m in zip(rows, models, strict=True):
        assert row["precision"] == P.precision_at_100(split, m)[0].first()["precision"]


def test_walks_shuffle_neither_walkers_nor_visits(spark):
    """Counts come from one stage behind the graph files; names of any length, hubs numbered by buckets and sources named twice or null."""
    from graphsig.operators.graph import adjacency_index, canonical_edges

    pairs = [("hub", f"l{i}") for i in range(30)] + [("l1", "\u00e9" * 40), ("l2", "x"), ("x", "y" * 47), ("y" * 47, "")]
    edges = edges_df(spark, pairs)
    visits = W.random_walk_visits(edges, 3, 120, 42)
    plan = visits._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("Exchange") == 1  # the sources' own
    assert {(r["source"], r["visited"]): r["cnt"] for r in visits.collect()} == walk_brute(pairs, 3, 120, 42)
    # hubs: the numbering of adjacency_index
    adj = {}
    for r in adjacency_index(canonical_edges(edges), bucket_size=8).orderBy("idx").collect():
        adj.setdefault(r["node"], []).append(r["nb"])
    want = {}
    for w in range(50):
        h = int(hashlib.md5(f"1|hub|{w}|0".encode()).hexdigest()[:8], 16)
        want[adj["hub"][h % 31]] = want.get(adj["hub"][h % 31], 0) + 1
    some = spark.createDataFrame([("hub",), ("hub",), ("lone",), (None,)], "node string")
    got = W.random_walk_visits(edges, 1, 50, 1, sources=some, bucket_size=8).collect()
    assert {r["visited"]: r["cnt"] for r in got if r["source"] == "hub"} == {k: 2 * n for k, n in want.items()}
    assert sorted((r["visited"] or "", r["cnt"]) for r in got if r["source"] != "hub") == [("", 50), ("lone", 50)]
    given = W.random_walk_visits(edges, 1, 50, 1, sources=some, adjacency=adjacency_index(canonical_edges(edges), bucket_size=8)).collect()
    assert sorted(map(str, given)) == sorted(map(str, got))
    empty = edges_df(spark, pairs).limit(0)
    assert W.random_walk_visits(empty, 2, 5).count() == 0


def test_ppr_rounds_shuffle_no_masses(spark):
    """More sources than stand in one row, named twice or without edges: masses are exact, a reached node keeps its row at
    mass 0, and they are read from files without an exchange."""
    pairs = [(f"n{i:03d}", f"n{(i * 7 + 1) % 140:03d}") for i in range(140)] + [("n000", "n001"), ("far", "away")]
    names = [f"n{i:03d}" for i in range(0, 140, 2)] + ["far"]
    sources = spark.createDataFrame([(x,) for x in [*names, "far", "lone", None]], "node string")
    got = W.personalized_pagerank(edges_df(spark, pairs), iterations=7, sources=sources, scale=1000)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: m for k, m in ppr_brute(pairs, 7, scale=1000).items() if k[0] in names} | {("lone", "lone"): None}
    rows = {(r["source"], r["node"]): r["mass"] for r in got.collect()}
    assert rows.keys() == want.keys() and 0 in rows.values()
    assert all(m is None or rows[k] == m for k, m in want.items())
    assert W.personalized_pagerank(edges_df(spark, pairs).limit(0)).count() == 0 and W.pagerank_bit_sums(edges_df(spark, pairs).limit(0), 32).count() == 0
