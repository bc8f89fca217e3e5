import pytest
from pyspark.sql import functions as F

from conftest import edges_df
from graphsig.functions.hashing import sig_bits_array, sig_bits_string
from graphsig.operators import simhash as S
from reference_model import node_sketch, signed, simhash, text_simhash

GRAPHS = {
    "single_edge": [("a", "b")],
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "triangle": [("a", "b"), ("b", "c"), ("c", "a")],
    "star": [("hub", f"leaf{i}") for i in range(200)],
    "two_components": [("a", "b"), ("c", "d")],
    "duplicates": [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a")],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
@pytest.mark.parametrize("f", [32, 64])
def test_node_sketch_matches_plain_python(spark, name, f):
    got = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, GRAPHS[name]), f=f).collect()}
    assert got == node_sketch(GRAPHS[name], f)


def test_single_edge_signatures_equal_and_ties_zero(spark):
    rows = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, [("a", "b")]), f=32).collect()}
    assert rows["a"] == rows["b"]
    # two features: a bit is set only when both hashes have it (1 of 2 is a tie -> 0)
    assert rows["a"] == simhash([("a", 1), ("b", 1)], 32)


def test_triangle_all_equal(spark):
    rows = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, GRAPHS["triangle"]), f=64).collect()}
    assert len(set(rows.values())) == 1


def test_128_bit_words(spark):
    sk = S.node_sketch(edges_df(spark, GRAPHS["path"]), f=128)
    got = {r["node"]: r["bits"] for r in sk.select("node", sig_bits_string(F.col("sig"), 128).alias("bits")).collect()}
    want = {n: format(v, "0128b") for n, v in ((n, simhash([(x, 1) for x in s], 128)) for n, s in
            __import__("reference_model").closed_neighbourhoods(GRAPHS["path"]).items())}
    assert got == want


def test_bits_array_and_embedding(spark):
    sk = S.node_sketch(edges_df(spark, GRAPHS["path"]), f=32)
    emb = {r["node"]: r["bits"] for r in S.embedding(sk, 32).collect()}
    ref = node_sketch(GRAPHS["path"], 32)
    for n, bits in emb.items():
        assert bits == [int(c) for c in format(ref[n], "032b")]
    with pytest.raises(ValueError):
        S.embedding(None, 32)


def test_weighted_features_small_large_fractional(spark):
    rows = [("k", "x", 1.0), ("k", "y", 50.0), ("k", "z", 51.0), ("k", "z", 300.0), ("k", "p", 0.25)]
    df = spark.createDataFrame(rows, "key string, feature string, weight double")
    got = S.simhash_features(df, "key", feature="feature", weight="weight", f=64).first()
    want = simhash([("x", 1.0), ("y", 50.0), ("z", 351.0), ("p", 0.25)], 64)
    assert got["sig"] == signed(want, 64)
    assert got["cnt"] == pytest.approx(402.25)


def test_token_array_and_map_forms(spark):
    df = spark.createDataFrame([("k", ["a", "b", "b"], {"a": 1, "b": 2})], "key string, toks array<string>, m map<string,int>")
    a = S.simhash_features(df, "key", tokens="toks", f=32).first()["sig"]
    b = S.simhash_features(df, "key", weights_map="m", f=32).first()["sig"]
    assert a == b == simhash([("a", 1), ("b", 2)], 32)


TEXTS = ["", "ab", "abcd", "Abc d!", "Привет, мир! Привет", "中文文本的测试，中文", "The the THE the. " * 5]


def test_text_simhash_matches_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["sig"] for r in S.text_simhash(docs, f=64).collect()}
    assert got == {i: text_simhash(t) for i, t in enumerate(TEXTS)}


def test_text_case_and_punctuation_removed(spark):
    docs = spark.createDataFrame([(1, "Abc d!"), (2, "abcd")], "doc_id long, text string")
    got = {r["doc_id"]: r["sig"] for r in S.text_simhash(docs, f=64).collect()}
    assert got[1] == got[2]


def test_bits_multiple_of_eight():
    from graphsig.functions.hashing import check_bits

    with pytest.raises(ValueError):
        check_bits(12)
    with pytest.raises(ValueError):
        check_bits(136)


def test_duplicate_signatures(spark):
    docs = spark.createDataFrame([(1, "same text here"), (2, "Same text, here!"), (3, "other words entirely")], "doc_id long, text string")
    dup = S.duplicate_signatures(S.text_simhash(docs, f=64)).collect()
    assert sorted(r["doc_id"] for r in dup) == [1, 2]
    assert {r["first_id"] for r in dup} == {1}


def test_from_signature_and_hamming(spark):
    from graphsig.functions.similarity import hamming_distance

    df = spark.createDataFrame([(0b1011, 0b0001)], "x long, y long")
    df = S.from_signature(df, "x", 8, "a").withColumn("d", hamming_distance([F.col("a")], [F.col("y")]))
    assert df.first()["d"] == 2


def test_sketch_independent_of_partitioning(spark):
    import random

    rng = random.Random(17)
    pairs = [(f"n{rng.randrange(50):02d}", f"n{rng.randrange(50):02d}") for _ in range(200)]
    a = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, pairs), f=64).collect()}
    b = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, pairs).repartition(11), f=64).collect()}
    c = {r["node"]: r["sig"] for r in S.node_sketch(edges_df(spark, pairs).coalesce(1), f=64).collect()}
    assert a == b == c


@pytest.mark.parametrize("placed", [None, "task", "together"])
def test_bit_sums_wherever_the_rows_are(spark, placed):
    import hashlib
    from collections import defaultdict

    rows = [("hub", f"x{i}", 1 + i % 3) for i in range(3000)] + [(f"k{i % 97}", f"y{i}", None if i % 5 == 0 else i) for i in range(2000)]
    rows += [("none", "z", None), (None, "n", 7), ("k1", None, 4)]
    df = spark.createDataFrame(rows, "node string, feature string, w long").repartition(5, "feature")
    plain, weighted = defaultdict(lambda: [0, [0] * 128]), defaultdict(lambda: [None, [0] * 128])
    for node, feature, w in rows:
        digest = int(hashlib.md5(feature.encode()).hexdigest(), 16) if feature else 0
        bits = [digest >> (127 - k) & 1 for k in range(128)]
        for state, by in ((plain[node], 1), (weighted[node], w)):
            if by is not None:
                state[0] = (state[0] or 0) + by
                state[1] = [s + b * by for s, b in zip(state[1], bits)]
    for weight, want in ((None, plain), ("w", weighted)):
        got = S.bit_sums(df, "node", 128, weight=weight, placed=placed).collect()
        assert len(got) == len(want)
        assert {r["node"]: [r["cnt"], r["sums"]] for r in got} == {**want}


def test_bit_sums_shuffle_features_not_sums(spark):
    sk = S.sketch_state(edges_df(spark, [("a", "b"), ("b", "c")]), 128, canonical=False)
    plan = sk._jdf.queryExecution().executedPlan().toString()
    assert "sum(" not in plan and "HashAggregate" not in plan


def test_shingle_counts_are_not_shuffled(spark):
    """Counts equal a plain count, for ids that occur once, twice or are null, and for documents over several batches; without
    shared ids no shuffle of shingles is in the plan."""
    from collections import Counter

    from graphsig.operators import simhash as S

    rows = [(1, "abcabcabcd"), (2, "Ab c"), (3, None), (4, ""), (5, "xyz" * 9000), (6, "xyz" * 9000), (None, "abcdabcd")]
    more = [*rows, (1, "abcabc"), (None, "cdab"), (4, None)]

    def plain(table):
        want = Counter()
        for i, text in table:
            if text is not None:
                t = "".join(x for x in text.lower() if x.isalnum())
                want.update((i, t[k : k + 4]) for k in range(max(1, len(t) - 3)))
        return want

    for table in (rows, more):
        got = S.shingle_counts(spark.createDataFrame(table, "doc_id long, text string").coalesce(1))
        assert Counter({(r["doc_id"], r["shingle"]): r["cnt"] for r in got.collect()}) == plain(table) and got.count() == len(plain(table))
    once = S.shingle_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()
    assert S.shingle_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
