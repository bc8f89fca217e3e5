"""DuckDB SQL text for the oracle side of each registered query.

These strings are what ``oracle_sql()`` hands to DuckDB; they restate each operator's semantics
in plain SQL over the same parquet tables, so Spark and DuckDB results can be compared value by value.
"""

from __future__ import annotations

from graphsig.functions.hashing import word_widths

HEX = "'0123456789abcdef'"

CUSTOMER_PART_RAW = (
    "SELECT 'user_' || CAST(o.o_custkey AS VARCHAR) AS src, 'item_' || CAST(l.l_partkey AS VARCHAR) AS dst "
    "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"
)
SUPPLIER_PART_RAW = (
    "SELECT 'supp_' || CAST(l_suppkey AS VARCHAR) AS src, 'item_' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem"
)


def canonical(raw: str) -> str:
    return (
        f"SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({raw}) r "
        "WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst"
    )


def half_edges(edges: str) -> str:
    return f"SELECT src AS node, dst AS nb FROM ({edges}) e UNION ALL SELECT dst AS node, src AS nb FROM ({edges}) e"


def closed_neighbours(edges: str) -> str:
    return (
        f"SELECT node, nb FROM ({half_edges(edges)}) h UNION ALL "
        f"SELECT node, node AS nb FROM (SELECT src AS node FROM ({edges}) e UNION SELECT dst FROM ({edges}) e) n"
    )


def bit_expr(digest: str, f: int, k: int, hex_len: int = 32) -> str:
    """Bit k (MSB first) of the last f bits of a hex digest, as 0/1."""
    pos = hex_len + 1 - f // 4 + k // 4
    return f"(((instr({HEX}, substr({digest}, {pos}, 1)) - 1) >> {3 - k % 4}) & 1)"


def bit_sums_sql(
    features: str, f: int, key: str = "node", feature: str = "feature", weight: str | None = None, digest: str = "md5", hex_len: int = 32
) -> str:
    """``(key, cnt, s0..s{f-1})`` over a feature table, hashing like the Spark side."""
    w = "1" if weight is None else weight
    bits = ", ".join(f"{bit_expr('__m', f, k, hex_len)} AS b{k}" for k in range(f))
    sums = ", ".join(f"CAST(sum(b{k} * __w) AS {'BIGINT' if weight is None else 'HUGEINT'}) AS s{k}" for k in range(f))
    return (
        f"SELECT {key}, CAST(sum(__w) AS HUGEINT) AS cnt, {sums} FROM ("
        f"SELECT {key}, __w, {bits} FROM ("
        f"SELECT {key}, {w} AS __w, {digest}(CAST({feature} AS VARCHAR)) AS __m FROM ({features}) ft) hb0) hb "
        f"GROUP BY {key}"
    )


def majority_bigint(f: int, word: int = 0) -> str:
    """Packed majority bits of one 64-bit word as signed BIGINT (same value as the Spark word)."""
    widths = word_widths(f)
    start = 64 * word
    width = widths[word]
    terms = " + ".join(
        f"(CASE WHEN 2 * s{start + p} > cnt THEN (1::HUGEINT << {width - 1 - p}) ELSE 0::HUGEINT END)" for p in range(width)
    )
    if width < 64:
        return f"CAST(({terms}) AS BIGINT)"
    return (
        f"CAST((CASE WHEN ({terms}) >= 9223372036854775808 THEN ({terms}) - 18446744073709551616 "
        f"ELSE ({terms}) END) AS BIGINT)"
    )


def majority_bits_string(f: int) -> str:
    return " || ".join(f"(CASE WHEN 2 * s{k} > cnt THEN '1' ELSE '0' END)" for k in range(f))


def sig_sql(f: int) -> str:
    """Signature column as produced by Spark: BIGINT for f <= 64, else a BIGINT list."""
    if f <= 64:
        return majority_bigint(f)
    return "[" + ", ".join(majority_bigint(f, i) for i in range(len(word_widths(f)))) + "]"


def node_sketch_sql(edges: str, f: int) -> str:
    feats = f"SELECT node, nb AS feature FROM ({closed_neighbours(edges)}) c"
    return f"SELECT node, CAST(cnt - 1 AS BIGINT) AS degree, {sig_sql(f)} AS sig FROM ({bit_sums_sql(feats, f)}) s"


WORD_CLASS = "[^\\p{L}\\p{N}_\\x{4e00}-\\x{9fcc}]"


def cleaned_text(col: str) -> str:
    return f"regexp_replace(lower({col}), '{WORD_CLASS}', '', 'g')"


def shingles_sql(docs: str, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> str:
    """``(id, feature)``: one row per shingle occurrence; a text shorter than width is one shingle."""
    return (
        f"SELECT {id_col}, CASE WHEN length(t) < {width} THEN t ELSE substring(t, i::BIGINT, {width}) END AS feature "
        f"FROM (SELECT {id_col}, {cleaned_text(text_col)} AS t FROM ({docs}) d) c, "
        f"LATERAL (SELECT unnest(range(1, greatest(length(t) - {width} + 1, 1) + 1)) AS i) g"
    )


# ------------------------------------------------------------------ graph helpers


def nodes_sql(edges: str) -> str:
    return f"SELECT src AS node FROM ({edges}) e UNION SELECT dst AS node FROM ({edges}) e"


def closed_over(edges: str, nodes: str) -> str:
    """Closed neighbourhoods over an explicit node list (isolated nodes keep their self-loop)."""
    return f"SELECT node, nb FROM ({half_edges(edges)}) h UNION ALL SELECT node, node AS nb FROM ({nodes}) n"



def hash_order_sql(seed: int, *cols: str) -> str:
    args = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {args})), 1, 15))::BIGINT"


def holdout_sql(edges: str, p: float, seed: int) -> str:
    """First floor(p*|E|) edges by (md5 order, src, dst)."""
    return (
        f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY h, src, dst) AS rn FROM "
        f"(SELECT src, dst, {hash_order_sql(seed, 'src', 'dst')} AS h FROM ({edges}) e) x) y "
        f"WHERE rn <= (SELECT CAST(floor(CAST({p!r} AS DOUBLE) * count(*)) AS BIGINT) FROM ({edges}) e)"
    )


def holdout_connected_sql(edges: str, forest: str, p: float, seed: int) -> str:
    """First floor(p*|E|) edges outside ``forest`` by (md5 order, src, dst)."""
    return (
        f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY h, src, dst) AS rn FROM "
        f"(SELECT src, dst, {hash_order_sql(seed, 'src', 'dst')} AS h FROM ({minus_sql(edges, forest)}) e) x) y "
        f"WHERE rn <= (SELECT CAST(floor(CAST({p!r} AS DOUBLE) * count(*)) AS BIGINT) FROM ({edges}) e)"
    )


def minus_sql(edges: str, removed: str) -> str:
    return f"SELECT src, dst FROM ({edges}) e WHERE NOT EXISTS (SELECT 1 FROM ({removed}) r WHERE r.src = e.src AND r.dst = e.dst)"


def negatives_sql(edges: str, n_sql: str, seed: int, nodes: str | None = None) -> str:
    """First n non-edges by candidate index i; candidate i pairs nodes md5(seed|i|0) and md5(seed|i|1) mod N."""
    nodes = nodes or nodes_sql(edges)

    def draw(side: str) -> str:
        return f"('0x' || substr(md5(concat_ws('|', '{seed}', CAST(i AS VARCHAR), '{side}')), 1, 15))::BIGINT"

    return (
        f"WITH numbered AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS pos FROM ({nodes}) n), "
        f"cnt AS (SELECT count(*) AS c FROM numbered), "
        f"want AS (SELECT ({n_sql}) AS n), "
        f"cand AS (SELECT i, {draw('0')} % c AS pa, {draw('1')} % c AS pb FROM "
        f"(SELECT unnest(range(4 * n + 64)) AS i FROM want) r, cnt), "
        f"pairs AS (SELECT c.i, least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst FROM cand c "
        f"JOIN numbered a ON a.pos = c.pa JOIN numbered b ON b.pos = c.pb), "
        f"valid AS (SELECT src, dst, min(i) AS i FROM pairs p WHERE src <> dst AND NOT EXISTS "
        f"(SELECT 1 FROM ({edges}) e WHERE e.src = p.src AND e.dst = p.dst) GROUP BY src, dst) "
        f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY i) AS rn FROM valid) v "
        f"WHERE rn <= (SELECT n FROM want)"
    )


def adjacency_sql(edges: str, bucket_size: int) -> str:
    """(node, idx, nb, nb_deg) numbered like the Spark side: by (bucket, nb) inside each node."""
    return (
        f"WITH nbr AS ({closed_neighbours(edges)}), "
        f"deg AS (SELECT node, count(*) AS deg FROM nbr GROUP BY node), "
        f"keyed AS (SELECT nbr.node, nbr.nb, {node_key_sql_ref('nbr.nb')} % CAST(ceil(deg.deg / {bucket_size}) AS BIGINT) AS bucket "
        f"FROM nbr JOIN deg ON deg.node = nbr.node), "
        f"local AS (SELECT node, nb, bucket, row_number() OVER (PARTITION BY node, bucket ORDER BY nb) AS li FROM keyed), "
        f"sizes AS (SELECT node, bucket, count(*) AS n FROM keyed GROUP BY node, bucket), "
        f"offs AS (SELECT node, bucket, coalesce(sum(n) OVER (PARTITION BY node ORDER BY bucket "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sizes) "
        f"SELECT l.node, o.off + l.li AS idx, l.nb, d.deg AS nb_deg FROM local l "
        f"JOIN offs o ON o.node = l.node AND o.bucket = l.bucket JOIN deg d ON d.node = l.nb"
    )


def node_key_sql_ref(node: str) -> str:
    from graphsig.functions.mixing import node_key_sql

    return node_key_sql(node)


def walk_visits_sql(edges: str, length: int, walks: int, seed: int, bucket_size: int = 1_000_000) -> str:
    parts = [
        f"adj AS ({adjacency_sql(edges, bucket_size)})",
        "deg AS (SELECT DISTINCT nb AS node, nb_deg AS deg FROM adj)",
        f"w0 AS (SELECT n.node AS source, n.node AS cur, d.deg, r.walk "
        f"FROM ({nodes_sql(edges)}) n JOIN deg d ON d.node = n.node, (SELECT unnest(range({walks})) AS walk) r)",
    ]
    for s in range(length):
        h = f"('0x' || substr(md5(concat_ws('|', '{seed}', source, CAST(walk AS VARCHAR), '{s}')), 1, 8))::BIGINT"
        parts.append(f"h{s} AS (SELECT source, walk, cur, deg, {h} % deg + 1 AS idx FROM w{s})")
        parts.append(
            f"w{s + 1} AS (SELECT h.source, a.nb AS cur, a.nb_deg AS deg, h.walk FROM h{s} h "
            f"JOIN adj a ON a.node = h.cur AND a.idx = h.idx)"
        )
    union = " UNION ALL ".join(f"SELECT source, cur AS visited FROM w{s + 1}" for s in range(length))
    return (
        "WITH " + ", ".join(parts) + f" SELECT source, visited, CAST(count(*) AS BIGINT) AS cnt FROM ({union}) v GROUP BY source, visited"
    )


#: The bound of rounds and the move that stops them, as in ``operators.walks``.
PPR_ROUNDS, PPR_TOL = 90, 1e-6


def ppr_sql(edges: str, sources: str, num: int = 85, den: int = 100, scale: int = 10**12) -> str:
    """``(source, node, mass)`` for the nodes that ``sources`` selects; a round replaces all masses, until no
    source's masses move by more than ``PPR_TOL`` in all."""
    teleport = scale * (den - num) // den
    parts = [
        f"nbr AS MATERIALIZED ({closed_neighbours(edges)})",
        "deg AS (SELECT node, count(*) AS deg FROM nbr GROUP BY node)",
        "trans AS MATERIALIZED (SELECT nbr.node, nbr.nb, deg.deg FROM nbr JOIN deg ON deg.node = nbr.node)",
        f"nd AS MATERIALIZED ({sources})",
        f"m(source, node, t, mass, moved) USING KEY (source, node) AS (SELECT node, node, CAST(0 AS BIGINT), CAST({scale} AS BIGINT), CAST({scale} AS BIGINT) FROM nd UNION "
        f"SELECT source, node, t, mass, CAST(abs(mass - before) AS BIGINT) FROM (SELECT m.source, x.nb AS node, m.t + 1 AS t, "
        f"CAST(sum((m.mass * {num}) // ({den} * x.deg)) + CASE WHEN m.source = x.nb THEN {teleport} ELSE 0 END AS BIGINT) AS mass, coalesce(max(m.mass) FILTER (x.nb = m.node), 0) AS before "
        f"FROM m JOIN trans x ON x.node = m.node WHERE m.t < {PPR_ROUNDS} "
        f"AND (SELECT max(d) FROM (SELECT sum(moved) AS d FROM m GROUP BY source) s) > {int(PPR_TOL * scale)} GROUP BY m.source, x.nb, m.t) r)",
    ]
    return "WITH RECURSIVE " + ", ".join(parts) + " SELECT source, node, mass FROM m"


def ppr_sums_sql(edges: str, f: int, num: int = 85, den: int = 100, scale: int = 10**10) -> str:
    """``(node, cnt, s0..s{f-1})``: bit sums by the PageRank recurrence; a round replaces all sums."""
    teleport = scale * (den - num) // den
    names = [f"s{k}" for k in range(f)] + ["cnt"]
    bits = ", ".join(f"{bit_expr('__m', f, k)} AS s{k}" for k in range(f))
    sums = ", ".join(f"sum(m.{x}) AS {x}" for x in names)
    new = [f"CAST((a.{x} // a.deg) * {num} // {den} + o.{x} * {teleport} AS BIGINT)" for x in names]
    step = ", ".join(f"{e} AS {x}" for e, x in zip(new, names, strict=True))
    moved = "greatest(" + ", ".join(f"abs(n.{x} - b.{x})" for x in names) + ")"
    parts = [
        f"nbr AS MATERIALIZED ({closed_neighbours(edges)})",
        f"own AS MATERIALIZED (SELECT node, {bits}, 1 AS cnt FROM (SELECT node, md5(node) AS __m FROM ({nodes_sql(edges)}) n) h)",
        f"m(node, t, moved, {', '.join(names)}) USING KEY (node) AS (SELECT node, CAST(0 AS BIGINT), CAST({scale} AS BIGINT), " + ", ".join(f"CAST({x} AS BIGINT) * {scale}" for x in names) + " FROM own UNION "
        f"SELECT n.node, n.t, CAST({moved} AS BIGINT), {', '.join(f'n.{x}' for x in names)} FROM ("
        f"SELECT a.node, a.t + 1 AS t, {step} FROM (SELECT n.node, m.t, count(*) AS deg, {sums} FROM nbr n JOIN m ON m.node = n.nb "
        f"WHERE m.t < {PPR_ROUNDS} AND (SELECT max(moved) FROM m) > {int(PPR_TOL * scale)} GROUP BY n.node, m.t) a JOIN own o ON o.node = a.node) n JOIN m b ON b.node = n.node)",
    ]
    return "WITH RECURSIVE " + ", ".join(parts) + f" SELECT node, {', '.join(names)} FROM m"


def sig_words_sql(f: int, prefix: str = "w") -> str:
    return ", ".join(f"{majority_bigint(f, i)} AS {prefix}{i}" for i in range(len(word_widths(f))))



def hamming_sim_sql(f: int, a: str = "x", b: str = "y") -> str:
    n = len(word_widths(f))
    diff = " + ".join(f"CAST(bit_count(xor({a}.w{i}, {b}.w{i})) AS INTEGER)" for i in range(n))
    return f"CAST({f} - ({diff}) AS INTEGER)"


def top_pairs_sql(words: str, f: int, k: int | None) -> str:
    """The best ``k`` pairs; all of them with None."""
    pairs = f"SELECT x.node AS a, y.node AS b, {hamming_sim_sql(f)} AS sim FROM ({words}) x JOIN ({words}) y ON x.node > y.node"
    return pairs if k is None else f"{pairs} ORDER BY sim DESC, a, b LIMIT {k}"


def precision_sql(ranked: str, truth: str, train: str, hits: int = 100) -> str:
    return (
        f"WITH c AS (SELECT r.a, r.b, r.sim, CASE WHEN EXISTS (SELECT 1 FROM ({truth}) t WHERE t.src = least(r.a, r.b) "
        f"AND t.dst = greatest(r.a, r.b)) THEN 1 ELSE 0 END AS hit FROM ({ranked}) r WHERE NOT EXISTS "
        f"(SELECT 1 FROM ({train}) g WHERE g.src = least(r.a, r.b) AND g.dst = greatest(r.a, r.b))), "
        f"w AS (SELECT row_number() OVER (ORDER BY sim DESC, a, b) AS rank, sum(hit) OVER (ORDER BY sim DESC, a, b "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, hit FROM c), "
        f"s AS (SELECT min(CASE WHEN cum >= {hits} THEN rank END) AS stop, count(*) AS rows, coalesce(sum(hit), 0) AS all_hits FROM w) "
        f"SELECT CAST(CASE WHEN stop IS NOT NULL THEN {hits} ELSE all_hits END AS BIGINT) AS tp, "
        f"CAST(coalesce(stop, rows) AS BIGINT) AS traversed, "
        f"round(CAST(CASE WHEN stop IS NOT NULL THEN {hits} ELSE all_hits END AS DOUBLE) / nullif(coalesce(stop, rows), 0), 6) AS precision FROM s"
    )


def precision_counts_sql(truth: str, train: str, f: int, hits: int = 100, words: str = "tw") -> str:
    """Precision at the ``hits``-th true edge outside ``train``, by counting the pairs of ``words`` up to it."""
    sim = hamming_sim_sql(f)
    scored = f"SELECT x.node AS a, y.node AS b, {sim} AS sim FROM ({{}}) p JOIN {words} x ON x.node = greatest(p.src, p.dst) JOIN {words} y ON y.node = least(p.src, p.dst)"
    up_to = "(bound.sim IS NULL OR t.sim > bound.sim OR (t.sim = bound.sim AND (t.a < bound.a OR (t.a = bound.a AND t.b <= bound.b))))"
    best = f"SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS rank FROM ({scored.format(minus_sql(truth, train))}) h QUALIFY rank <= {hits}"
    at = ", ".join(f"max(CASE WHEN rank = {hits} THEN {c} END) AS {c}" for c in ("sim", "a", "b"))
    return (
        f"WITH bound AS MATERIALIZED (SELECT count(*) AS tp, {at} FROM ({best}) h), "
        f"n AS (SELECT (SELECT count(*) FROM ({top_pairs_sql(f'SELECT * FROM {words}', f, None)}) t, bound WHERE {up_to}) "
        f"- (SELECT count(*) FROM ({scored.format(train)}) t, bound WHERE {up_to}) AS traversed) "
        f"SELECT CAST(tp AS BIGINT) AS tp, CAST(traversed AS BIGINT) AS traversed, round(CAST(tp AS DOUBLE) / nullif(traversed, 0), 6) AS precision FROM bound, n"
    )
