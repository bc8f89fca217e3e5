import random

import pytest

from graphsig.operators import pairs as PR


def brute_top(vecs, k, f):
    items = sorted(vecs.items())
    out = []
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            sim = f - bin((x ^ y) & ((1 << 64) - 1)).count("1")
            hi, lo = (a, b) if a > b else (b, a)
            out.append((hi, lo, sim))
    out.sort(key=lambda t: (-t[2], t[0], t[1]))
    return out[:k]


@pytest.mark.parametrize("block_size", [7, 1000])
def test_top_pairs_exact_with_ties(spark, block_size):
    rng = random.Random(5)
    vecs = {f"n{i:03d}": rng.getrandbits(16) for i in range(60)}
    df = spark.createDataFrame([(k, v) for k, v in vecs.items()], "node string, sig long")
    got = [tuple(r) for r in PR.top_pairs(df, k=150, measure="hamming", f=16, block_size=block_size).collect()]
    assert got == brute_top(vecs, 150, 16)


def test_top_pairs_float_cosine(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(30)]
    rows.append((99, [0.0] * 5))
    df = spark.createDataFrame(rows, "node long, v array<double>")
    got = PR.top_pairs(df, k=20, measure="cosine", vector="v", block_size=8).collect()
    import math

    def cos(a, b):
        d = sum(x * y for x, y in zip(a, b))
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
        return 0.0 if n == 0 else round(d / n, 6)

    allp = []
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            sa, sb = str(a), str(b)
            hi, lo = (sa, sb) if sa > sb else (sb, sa)
            allp.append((hi, lo, cos(x, y)))
    allp.sort(key=lambda t: (-t[2], t[0], t[1]))
    assert [(r["a"], r["b"]) for r in got] == [(a, b) for a, b, _ in allp[:20]]


def test_unknown_measure(spark):
    df = spark.createDataFrame([("a", 1)], "node string, sig long")
    with pytest.raises(ValueError):
        PR.top_pairs(df, k=1, measure="jaccard", f=8)


def test_band_links_exact_within_radius(spark):
    rng = random.Random(1)
    base = rng.getrandbits(32)
    sigs = {"a": base, "b": base ^ 0b1, "c": base ^ 0b1011, "z": rng.getrandbits(32)}
    df = spark.createDataFrame(list(sigs.items()), "node string, sig long")
    links = PR.band_links(df, 32, 4)
    linked = {(r["a"], r["b"]) for r in links.collect()}
    # a-b differ in 1 bit, a-c in 3 bits: both below 4 bands, so they share a band bucket
    assert ("b", "a") in linked and ("c", "a") in linked
    sims = {(r["a"], r["b"]): r["sim"] for r in links.collect()}
    assert sims[("b", "a")] == 31


def test_pair_similarity_symmetric_and_bounded(spark):
    rng = random.Random(23)
    vecs = [(f"n{i}", [rng.getrandbits(63), rng.getrandbits(63)]) for i in range(12)]
    df = spark.createDataFrame(vecs, "node string, sig array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a, _ in vecs for b, _ in vecs], "a string, b string")
    got = {(r["a"], r["b"]): r["sim"] for r in PR.score_pairs(pairs, df, "hamming", f=128).collect()}
    assert all(got[(a, b)] == got[(b, a)] for a, b in got)
    assert all(0 <= v <= 128 for v in got.values())
    assert all(got[(a, a)] == 128 for a, _ in vecs)


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_band_links_equal_brute_force(spark, chunk_rows):
    rng = random.Random(4)
    sigs, base = {}, rng.getrandbits(31)
    for i in range(60):  # one crowded neighbourhood with copies, and strangers
        near = base ^ sum(1 << b for b in rng.sample(range(31), rng.randrange(5)))
        sigs[f"n{i:02d}"] = near if i % 3 else rng.getrandbits(31)
    sigs.update({f"z{i}": base for i in range(6)})
    df = spark.createDataFrame([*sigs.items(), ("none", None)], "node string, sig long")
    first = {}
    for k in sorted(sigs):
        first.setdefault(sigs[k], k)
    want = {(k, first[s], 32) for k, s in sigs.items() if first[s] != k}
    for x, a in first.items():
        for y, b in first.items():
            if a > b and (x ^ y).bit_count() < 4:
                want.add((a, b, 32 - (x ^ y).bit_count()))
    got = [tuple(r) for r in PR.band_links(df, 32, 4, chunk_rows=chunk_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def brute_pairs(rows, sim):
    out = []
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            out.append((max(a, b), min(a, b), sim(x, y)))
    return sorted(out, key=lambda t: (-t[2], t[0], t[1]))


@pytest.mark.parametrize("measure", ["hamming", "dot_product", "cosine"])
@pytest.mark.parametrize("k", [1, 40, 5000])
def test_top_pairs_of_bits_over_blocks(spark, measure, k):
    rng = random.Random(7)
    rows = [(f"n{i:03d}", rng.getrandbits(32) & (rng.getrandbits(32) if i % 2 else -1)) for i in range(90)]
    rows += [("zero", 0), ("copy", rows[0][1]), ("zz", 0)]

    def sim(x, y):
        if measure == "hamming":
            return 32 - (x ^ y).bit_count()
        common = (x & y).bit_count()
        if measure == "dot_product":
            return common
        both = x.bit_count() * y.bit_count()
        return round(common / both**0.5, 6) if both else 0.0

    df = spark.createDataFrame(rows, "node string, sig long")
    got = [tuple(r) for r in PR.top_pairs(df, k=k, measure=measure, f=32, block_size=12).collect()]
    want = brute_pairs(rows, sim)[:k]
    assert got == (want if measure != "cosine" else [(a, b, pytest.approx(s)) for a, b, s in want])


def test_top_pairs_all_equal_vectors(spark):
    df = spark.createDataFrame([(f"n{i:02d}", 5) for i in range(40)], "node string, sig long")
    got = [tuple(r) for r in PR.top_pairs(df, k=30, measure="hamming", f=8, block_size=6).collect()]
    assert got == brute_pairs([(f"n{i:02d}", 0) for i in range(40)], lambda x, y: 8)[:30]


def test_floor_below_estimate_runs_again(spark, monkeypatch):
    """An estimate above the k-th value gives too few pairs; the proven floor then gives the same rows."""
    rng = random.Random(3)
    vecs = {f"n{i:03d}": rng.getrandbits(16) for i in range(60)}
    df = spark.createDataFrame(list(vecs.items()), "node string, sig long")
    sampled = PR._sampled_floor
    monkeypatch.setattr(PR, "_sampled_floor", lambda *a: (16, sampled(*a)[1]))
    got = [tuple(r) for r in PR.top_pairs(df, k=50, f=16, block_size=9).collect()]
    assert got == brute_top(vecs, 50, 16)


@pytest.mark.parametrize(
    "kind, measure, f", [("bits", "hamming", 64), ("bits", "dot_product", 64), ("bits", "cosine", 64), ("float", "cosine", None), ("float", "dot_product", None), ("array", "hamming", None)]
)
def test_strips_lose_no_pair_above_the_floor(kind, measure, f):
    """Bounds leave out cells, never one that reaches the floor."""
    import numpy as np

    rng = np.random.default_rng(2)
    if kind == "bits":
        draw = lambda n: (rng.integers(0, 1 << 62, (n, 1)) & rng.choice([3, (1 << 40) - 1, -1], (n, 1))).view(np.uint64)
    elif kind == "float":
        draw = lambda n: rng.normal(0, 1, (n, 6)) * rng.choice([0.0, 0.1, 1.0, 4.0], (n, 1)) + rng.choice([-1.0, 1.0], (n, 1)) * [3, 0, 0, 0, 0, 0]
    else:
        draw = lambda n: rng.integers(0, 3, (n, 6))
    x, y = draw(300), draw(200)
    whole = PR._scores(x, y, kind, measure, f).astype(float)
    inner = PR._scores(x, x, kind, measure, f).astype(float)
    skipped = {}
    for share in (0.5, 0.99, 1.0):
        floor = float(np.quantile(whole, share))
        floor = floor if kind == "float" or measure == "cosine" else int(floor)
        seen, cells = set(), 0
        PR_CELLS, PR.STRIP_CELLS = PR.STRIP_CELLS, 2000
        try:
            for rows, cols, s, _ in PR._strips(x, y, kind, measure, f, lambda: floor):
                cells += s.size
                seen |= {(rows[i], cols[j]) for i, j in zip(*np.nonzero(s >= floor))}
            once = [
                tuple(sorted((rows[i], cols[j])))
                for rows, cols, s, valid in PR._strips(x, None, kind, measure, f, lambda: floor)
                for i, j in zip(*np.nonzero((s >= floor) & valid))
            ]
        finally:
            PR.STRIP_CELLS = PR_CELLS
        assert seen == set(zip(*np.nonzero(whole >= floor)))
        i, j = np.nonzero(inner >= floor)
        assert len(once) == len(set(once)) and set(once) == {(p, q) for p, q in zip(i, j) if p < q}
        skipped[share] = 1 - cells / whole.size
    if kind != "array":
        assert skipped[1.0] > 0.2


def test_cosines_under_the_floor_are_not_made():
    import numpy as np

    rng = np.random.default_rng(6)
    x, y = (rng.integers(0, 1 << 62, (n, 2)).view(np.uint64) for n in (90, 70))
    y[:3] = 0
    whole = PR._scores(x, y, "bits", "cosine", 128)
    floor = float(np.quantile(whole, 0.9))
    some = PR._scores(x, y, "bits", "cosine", 128, floor)
    assert (some[whole >= floor] == whole[whole >= floor]).all() and (some[whole < floor] < floor).all() and (some == -1).any()


def test_crowded_bands_do_not_meet_whole(spark):
    """Signatures that are equal in one band only share no two of the finer ranges; those within the radius do."""
    rng = random.Random(12)
    sigs = {f"n{i:03d}": (rng.getrandbits(47) << 16) | 0xABCD for i in range(300)}
    base = sigs["n000"]
    sigs.update({f"z{i:02d}": base ^ sum(1 << b for b in rng.sample(range(63), 3)) for i in range(40)})
    df = spark.createDataFrame(list(sigs.items()), "node string, sig long")
    shared = {}
    for r in PR.paired_values(df, 64, 3).collect():
        shared.setdefault((r["band"], r["value"]), set()).add(r["node"])
    met = {(a, b) for group in shared.values() for a in group for b in group if a < b}
    assert all(("n000", f"z{i:02d}") in met for i in range(40))
    assert sum(a[0] == b[0] == "n" for a, b in met) < 300  # of 44,850 that share the band
