import os
import shutil
import random
import tempfile

from pyspark.sql import functions as F

from conftest import edges_df
from graphsig.operators import incremental as U
from graphsig.operators import simhash as S
from graphsig.plans.models import NodeSketchModel, SimHashSketch, refit_or_update


def random_graph(spark, n=40, m=120, seed=4):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)]


def sigs(df):
    return {r["node"]: r["sig"] for r in df.collect()}


def test_additive_update_equals_recompute(spark):
    pairs = random_graph(spark)
    base, new = pairs[:70], pairs[70:] + [("fresh1", "v01"), ("fresh1", "fresh2")]
    state = S.sketch_state(edges_df(spark, base), 32)
    updated = U.apply_edges(state, S.canonical_edges(edges_df(spark, base)), edges_df(spark, new), 32)
    full = S.node_sketch(edges_df(spark, base + new), 32)
    assert sigs(U.sketch_from_state(updated, 32)) == sigs(full)


def test_model_update_and_fit_or_update(spark):
    pairs = random_graph(spark)
    m = SimHashSketch(dimensions=64)
    st = m.fit_or_update(None, edges_df(spark, pairs[:60]), edges_df(spark, pairs[60:]))
    assert sigs(st.embedding()) == sigs(S.node_sketch(edges_df(spark, pairs), 64))


def test_walk_update_refreshes_stale_sources(spark):
    pairs = random_graph(spark, seed=8)
    m = SimHashSketch(dimensions=32, random_walk_length=2, number_of_walks=10)
    st = m.update(m.fit(edges_df(spark, pairs[:80])), edges_df(spark, pairs[80:]))
    refit = m.fit(edges_df(spark, pairs))
    stale = {r["node"] for r in st.extra["stale"].collect()}
    a, b = sigs(st.embedding()), sigs(refit.embedding())
    assert all(a[n] == b[n] for n in stale)


def test_stale_nodes_threshold(spark):
    visits = spark.createDataFrame([("s1", "x", 249), ("s2", "x", 250), ("s3", "y", 251), ("s4", "q", 400)], "source string, visited string, cnt long")
    stale = {r["node"] for r in U.stale_nodes(visits, edges_df(spark, [("x", "y")]), 500).collect()}
    assert stale == {"s2", "s3"}


def test_mode_exclusive():
    import pytest

    with pytest.raises(ValueError):
        SimHashSketch(random_walk_length=3, use_page_rank=True)


def test_nodesketch_refit(spark):
    pairs = random_graph(spark, n=20, m=40)
    m = NodeSketchModel(dimensions=8, iterations=2)
    sk = refit_or_update(m, None, edges_df(spark, pairs[:30]), edges_df(spark, pairs[30:]))
    rows = sk.collect()
    assert rows and all(len(r["sketch"]) == 8 for r in rows)


def test_stream_sketch_equals_batch(spark):
    from graphsig.streaming.edges import run_stream_sketch, write_stream_files

    pairs = random_graph(spark, m=150, seed=12) + [("v01", "v02")] * 3
    df = edges_df(spark, pairs).withColumn("ts", F.current_timestamp()).withColumn("i", F.monotonically_increasing_id())
    folder = tempfile.mkdtemp(prefix="graphsig-stream-")
    n = write_stream_files(df.drop("i"), os.path.join(folder, "in"), 40, ["src", "dst"])
    assert n >= 4
    final = run_stream_sketch(spark, os.path.join(folder, "in"), os.path.join(folder, "state"), 32)
    got = {r["node"]: (r["degree"], r["sig"]) for r in final.collect()}
    want = {r["node"]: (r["degree"], r["sig"]) for r in S.node_sketch(edges_df(spark, pairs), 32).collect()}
    assert got == want


def test_edge_stream_replay(spark):
    from graphsig.streaming.edges import run_edge_stream, write_stream_files

    pairs = random_graph(spark, m=100, seed=21)
    base, stream = pairs[:50], pairs[50:] + pairs[:5]
    folder = tempfile.mkdtemp(prefix="graphsig-replay-")
    sdf = edges_df(spark, stream).withColumn("ts", F.lit(None).cast("timestamp"))
    write_stream_files(sdf, os.path.join(folder, "in"), 20, ["src", "dst"])
    res = run_edge_stream(spark, os.path.join(folder, "in"), os.path.join(folder, "state"), SimHashSketch(32), edges_df(spark, base))
    metrics = spark.read.parquet(res.metrics).orderBy("batch_id").collect()
    all_edges = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    assert metrics[-1]["edge_count"] == len(all_edges)
    assert sum(r["added"] for r in metrics) == len(all_edges) - len({tuple(sorted(p)) for p in base if p[0] != p[1]})


def test_replay_evaluates_the_base_graph_first(spark):
    """Batch -1 has the base graph's own metric, is written once, and a stream of one-edge files has a row for each."""
    from graphsig.streaming.edges import run_edge_stream, write_stream_files

    base, stream = [("a", "b"), ("b", "c")], [("c", "d"), ("a", "c")]
    folder = tempfile.mkdtemp(prefix="graphsig-initial-")
    sdf = edges_df(spark, stream).withColumn("ts", F.lit(None).cast("timestamp"))
    write_stream_files(sdf, os.path.join(folder, "in"), 1, ["src", "dst"])
    seen = []

    def evaluate(state, edges):
        seen.append(state.embedding().count())
        return float(edges.count())

    for _ in range(2):  # the second run finds nothing new
        res = run_edge_stream(spark, os.path.join(folder, "in"), os.path.join(folder, "state"), SimHashSketch(32), edges_df(spark, base), evaluate)
    rows = spark.read.parquet(res.metrics).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["added"], r["edge_count"], r["precision"]) for r in rows] == [(-1, 0, 2, 2.0), (0, 1, 3, 3.0), (1, 1, 4, 4.0)]
    assert seen[0] == 3 and len(seen) == 3


def test_replay_goes_on_after_a_restart(spark):
    """Stopping between batches loses no edge, and the metrics equal those of one run."""
    from graphsig.streaming.edges import run_edge_stream, write_stream_files

    pairs = random_graph(spark, m=80, seed=22)
    base, parts = pairs[:30], (pairs[30:55], pairs[55:])
    folder = tempfile.mkdtemp(prefix="graphsig-restart-")
    for k, part in enumerate(parts):
        sdf = edges_df(spark, part).withColumn("ts", F.lit(None).cast("timestamp"))
        write_stream_files(sdf, os.path.join(folder, f"new{k}"), 30, ["src", "dst"])
        (name,) = (x for x in os.listdir(os.path.join(folder, f"new{k}")) if x.startswith("batch-"))
        shutil.copytree(os.path.join(folder, f"new{k}", name), os.path.join(folder, "in", f"batch-{k:08d}"))
        res = run_edge_stream(spark, os.path.join(folder, "in"), os.path.join(folder, "state"), SimHashSketch(32), edges_df(spark, base))
    last = spark.read.parquet(res.metrics).orderBy(F.col("batch_id").desc()).first()
    assert last["edge_count"] == len({tuple(sorted(p)) for p in pairs if p[0] != p[1]})


def test_state_save_load_versions(spark):
    from graphsig.sources.state import load_state, save_state

    pairs = random_graph(spark, m=50, seed=30)
    m = SimHashSketch(dimensions=32)
    folder = tempfile.mkdtemp(prefix="graphsig-state-")
    st = m.fit(edges_df(spark, pairs[:30]))
    save_state(st, folder, 0)
    save_state(m.update(st, edges_df(spark, pairs[30:])), folder, 1)
    latest = load_state(spark, folder)
    assert sigs(latest.embedding()) == sigs(S.node_sketch(edges_df(spark, pairs), 32))
    assert sigs(load_state(spark, folder, 0).embedding()) == sigs(st.embedding())


def test_update_compares_new_edges_with_the_graph_once(spark, monkeypatch):
    pairs = random_graph(spark, seed=3)
    m = SimHashSketch(dimensions=64)
    st = m.fit(edges_df(spark, pairs[:60]))

    def again(*args, **kwargs):
        raise AssertionError("the update knows its new edges")

    monkeypatch.setattr(U, "new_edges", again)
    assert sigs(m.update(st, edges_df(spark, pairs[50:])).embedding()) == sigs(S.node_sketch(edges_df(spark, pairs), 64))
