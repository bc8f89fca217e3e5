import random

from conftest import edges_df
from graphsig.operators import components as C
from graphsig.operators import sampling as H


def graph(spark, n=80, m=300, seed=2):
    rng = random.Random(seed)
    ring = [(f"v{i:02d}", f"v{(i + 1) % n:02d}") for i in range(n)]
    extra = [(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)]
    return edges_df(spark, ring + extra)


def test_holdout_exact_count_and_disjoint(spark):
    e = graph(spark)
    total = e.selectExpr("least(src,dst) a", "greatest(src,dst) b").filter("a <> b").distinct().count()
    held, rest = H.holdout_edges(e, 0.1, 42, keep_connected=False)
    h, r = {tuple(x) for x in held.collect()}, {tuple(x) for x in rest.collect()}
    assert len(h) == int(0.1 * total) and not (h & r) and len(h | r) == total


def test_holdout_keeps_components(spark):
    e = graph(spark)
    held, rest = H.holdout_edges(e, 0.3, 42, keep_connected=True)
    before = C.connected_components(e).select("component").distinct().count()
    after = C.connected_components(rest).select("component").distinct().count()
    assert before == after == 1
    assert held.count() > 0


def test_negatives(spark):
    e = graph(spark)
    neg = {tuple(x) for x in H.negative_edges(e, 50, 3).collect()}
    edges = {tuple(sorted(x)) for x in e.collect()}
    assert len(neg) == 50 and not (neg & edges) and all(a < b for a, b in neg)


def test_nested_split_and_random_split(spark):
    parts = H.nested_link_split(graph(spark), 0.1, 42, keep_connected=False)
    test, train = parts["test"], parts["train"]
    assert test.filter("label = 1").count() == test.filter("label = 0").count()
    assert train.filter("label = 1").count() == train.filter("label = 0").count()
    rs = H.random_split(train.select("src", "dst", "label"), 0.75, 1)
    n = train.count()
    assert rs.filter("part = 'train'").count() == int(0.75 * n)


def test_stream_split_with_negatives(spark):
    """Half of the edges as label 1, as many pairs that are no edges of the whole graph as label 0; no edge is lost."""
    rng = random.Random(5)
    whole = {tuple(sorted(rng.sample([f"n{i}" for i in range(40)], 2))) for _ in range(60)}
    base, stream = H.stream_split(edges_df(spark, sorted(whole)), 0.5, 3, keep_connected=False, negatives=True)
    rows = [(r["src"], r["dst"], r["label"]) for r in stream.collect()]
    held = {(a, b) for a, b, x in rows if x == 1}
    fake = [(a, b) for a, b, x in rows if x == 0]
    assert held | {tuple(r) for r in base.select("src", "dst").collect()} == whole
    assert len(held) == len(whole) // 2 == len(fake) == len(set(fake)) and not set(fake) & whole


def test_edges_are_made_once(spark):
    """However often a split reads the graph, the rows behind it are read once."""
    pairs = sorted({(f"a{i % 9}", f"b{i * 7 % 23}") for i in range(90)})
    for split in (
        lambda e: H.holdout_edges(e, 0.2, 1, keep_connected=False)[0],
        lambda e: H.negative_edges(e, 20, 1),
        lambda e: H.nested_link_split(e, 0.1, 1, keep_connected=False)["labelled"],
        lambda e: H.stream_split(e, 0.5, 1, keep_connected=False)[1],
    ):
        read = spark.sparkContext.accumulator(0)
        rows = spark.sparkContext.parallelize(pairs, 2).map(lambda x, read=read: (read.add(1), x)[1])
        assert split(spark.createDataFrame(rows, "src string, dst string")).count() > 0
        assert read.value == len(pairs)


def test_holdout_is_the_first_by_hash_without_a_join(spark):
    import hashlib

    e = graph(spark)
    every = sorted({tuple(sorted(x)) for x in e.collect() if x[0] != x[1]}, key=lambda x: (hashlib.md5(f"7|{x[0]}|{x[1]}".encode()).hexdigest()[:15], x))
    for p in (0.01, 0.3, 0.99):
        held, rest = H.holdout_edges(e, p, 7, keep_connected=False)
        n = int(p * len(every))
        assert {tuple(x) for x in held.collect()} == set(every[:n]) and {tuple(x) for x in rest.collect()} == set(every[n:])
        assert "Join" not in rest._jdf.queryExecution().toString()
