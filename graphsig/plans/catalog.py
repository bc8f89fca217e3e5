"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator, and
the DuckDB SQL that must return the same rows (where SQL can say it).

Every query reads the driver tables (or what Spark derives from them) in full. Queries without
an oracle are iterative graph jobs, streaming state or model fitting; they get the rows-only check
and are tested against brute force on small graphs in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsig.functions.hashing import sha256_words, sig_bits_string
from graphsig.operators import components as C
from graphsig.operators import graph as G
from graphsig.operators import linkpred as L
from graphsig.operators import pairs as PR
from graphsig.operators import sampling as H
from graphsig.operators import simhash as S
from graphsig.operators import walks as W
from graphsig.plans import sqltext as Q
from graphsig.session import cut_lineage
from graphsig.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Parameters of the registered runs. Sketch width 128, walk settings and the 100,000-pair list
# follow the reference's experiment grid; 32 bits is the model's default width.
F_DEFAULT = 32
F_EXPERIMENT = 128
WALKS, WALK_LENGTH, SEED = 500, 3, 42
TOP_K = 100_000
HOLDOUT_P = 0.1
PPR_SOURCES = 20
BATCH_P = 0.01
TEXT_F, TEXT_BANDS = 64, 4

CP = Q.canonical(Q.CUSTOMER_PART_RAW)
SP = Q.canonical(Q.SUPPLIER_PART_RAW)
E = "SELECT src, dst FROM e"


def with_edges(edges_sql: str, body: str, extra: str = "") -> str:
    ctes = f"e AS ({edges_sql})" + (f", {extra}" if extra else "")
    return f"WITH {ctes} SELECT * FROM ({body}) q"


def cp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_edges(T.customer_part_raw(spark, sf_dir))


def sp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_edges(T.supplier_part_raw(spark, sf_dir))


def bits_string_sql(f: int) -> str:
    return Q.majority_bits_string(f)


def feats(edges: str, nodes: str | None = None) -> str:
    inner = Q.closed_over(edges, nodes) if nodes else Q.closed_neighbours(edges)
    return f"SELECT node, nb AS feature FROM ({inner}) c"


# ---------------------------------------------------------------- scans, sinks, shaping


@register("p1_ratings_edges", "SELECT DISTINCT 'user_' || CAST(o.o_custkey AS VARCHAR) AS src, 'movie_' || CAST(l.l_partkey AS VARCHAR) AS dst "
          "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 3.0")
def p1_ratings_edges(spark, sf_dir):
    """Ratings strictly above 3.0, prefixed ids, rating/timestamp dropped, duplicates removed."""
    from graphsig.sources.files import ratings_to_edges

    return ratings_to_edges(T.ratings_standin(spark, sf_dir), 3.0)


@register("s1_ratings_csv_roundtrip", "SELECT DISTINCT 'user_' || CAST(o.o_custkey AS VARCHAR) AS src, 'movie_' || CAST(l.l_partkey AS VARCHAR) AS dst "
          "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 3.0")
def s1_ratings_csv_roundtrip(spark, sf_dir):
    """Write the ratings table as CSV with a header, read it back with the explicit schema, build edges."""
    from graphsig.session import scratch_path
    from graphsig.sources.files import ratings_to_edges, read_ratings

    path = scratch_path(spark, "ratings-csv")
    T.ratings_standin(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return ratings_to_edges(read_ratings(spark, path), 3.0)


@register("s2_edge_csv_roundtrip", CP)
def s2_edge_csv_roundtrip(spark, sf_dir):
    """S6 + S2: write the edge list (no header), read it back as an undirected simple graph."""
    from graphsig.session import scratch_path
    from graphsig.sources.files import read_edges, write_edges

    path = scratch_path(spark, "edges-csv")
    write_edges(T.customer_part_raw(spark, sf_dir), path)
    return read_edges(spark, path)


@register("s3_snap_text_roundtrip", SP)
def s3_snap_text_roundtrip(spark, sf_dir):
    """S3: whitespace-separated SNAP text with a comment line, read back and canonicalised."""
    from graphsig.session import scratch_path
    from graphsig.sources.files import read_snap_edges

    path = scratch_path(spark, "snap-text")
    raw = T.supplier_part_raw(spark, sf_dir)
    lines = raw.select(F.concat_ws("\t", "src", "dst").alias("value"))
    header = spark.createDataFrame([("# Undirected graph: supplier-part",)], "value string")
    header.unionByName(lines).write.mode("overwrite").text(path)
    return read_snap_edges(spark, path)


@register("s4_edges_from_coo", "SELECT DISTINCT least(r, c) AS src, greatest(r, c) AS dst FROM (SELECT CAST(l_suppkey AS VARCHAR) AS r, "
          "CAST(l_partkey AS VARCHAR) AS c FROM lineitem WHERE l_discount <> 0) t WHERE r <> c")
def s4_edges_from_coo(spark, sf_dir):
    """Sparse (row, col, value) triples -> undirected edges over the non-zero cells."""
    from graphsig.sources.files import edges_from_coo

    li = T.load(spark, sf_dir, "lineitem")
    triples = li.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_discount").alias("value"))
    return edges_from_coo(triples)


@register("p5_canonical_edges", CP)
def p5_canonical_edges(spark, sf_dir):
    """P5: one orientation per undirected edge (src < dst), loops and duplicates dropped."""
    return cp_edges(spark, sf_dir)


@register("g1_closed_neighbours", with_edges(CP, Q.closed_neighbours(E)))
def g1_closed_neighbours(spark, sf_dir):
    """G1 + P7: neighbour rows of every node, including the node itself."""
    return G.neighbours(cp_edges(spark, sf_dir), closed=True)


@register("g4_degrees", with_edges(CP, f"SELECT node, CAST(count(*) AS BIGINT) AS degree FROM ({Q.half_edges(E)}) h GROUP BY node"))
def g4_degrees(spark, sf_dir):
    return G.degrees(cp_edges(spark, sf_dir))


@register(
    "g4_graph_stats",
    with_edges(
        CP,
        "SELECT CAST(count(*) AS BIGINT) AS node_count, CAST(sum(degree) / 2 AS BIGINT) AS edge_count, "
        "CAST(max(degree) AS BIGINT) AS max_degree, round(avg(degree), 6) AS mean_degree FROM "
        f"(SELECT node, count(*) AS degree FROM ({Q.half_edges(E)}) h GROUP BY node) d",
    ),
)
def g4_graph_stats(spark, sf_dir):
    return G.graph_stats(cp_edges(spark, sf_dir))


@register("p9_dense_ids", with_edges(CP, f"SELECT CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS id, node AS original_id FROM ({Q.nodes_sql(E)}) n"))
def p9_dense_ids(spark, sf_dir):
    """Nodes relabelled 0..n-1 in id order (range partitions + offsets, no one-partition window)."""
    node_table, _ = G.dense_ids(cp_edges(spark, sf_dir))
    return node_table


@register(
    "p8_dense_id_check",
    with_edges(
        CP,
        "SELECT CAST(min(id) AS BIGINT) AS lo, CAST(max(id) AS BIGINT) AS hi, CAST(count(DISTINCT id) AS BIGINT) AS n, "
        "(min(id) = 0 AND max(id) = count(DISTINCT id) - 1 AND count(DISTINCT id) = count(*)) AS dense FROM "
        f"(SELECT row_number() OVER (ORDER BY node) - 1 AS id FROM ({Q.nodes_sql(E)}) n) x",
    ),
)
def p8_dense_id_check(spark, sf_dir):
    """Ids are exactly 0..n-1 (one aggregate)."""
    node_table, _ = G.dense_ids(cp_edges(spark, sf_dir))
    return node_table.agg(
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.count_distinct("id").alias("n"),
        ((F.min("id") == 0) & (F.max("id") == F.count_distinct("id") - 1) & (F.count_distinct("id") == F.count(F.lit(1)))).alias("dense"),
    )


def _status_edges_sql(status: str) -> str:
    return Q.canonical(
        "SELECT 'user_' || CAST(o.o_custkey AS VARCHAR) AS src, 'item_' || CAST(l.l_partkey AS VARCHAR) AS dst "
        f"FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = '{status}'"
    )


def _status_edges(spark, sf_dir, status: str) -> DataFrame:
    orders = T.load(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    items = T.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    raw = orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("item_"), F.col("l_partkey").cast("string")).alias("dst"),
    )
    return G.canonical_edges(raw)


@register(
    "g5_edge_membership",
    f"WITH fe AS ({_status_edges_sql('F')}), oe AS ({_status_edges_sql('O')}) SELECT fe.src AS a, fe.dst AS b, "
    "CASE WHEN oe.src IS NULL THEN 0 ELSE 1 END AS is_edge FROM fe LEFT JOIN oe ON fe.src = oe.src AND fe.dst = oe.dst",
)
def g5_edge_membership(spark, sf_dir):
    """Is each finished-order edge also an edge of the open-order graph (left join on the canonical pair)."""
    fe = _status_edges(spark, sf_dir, "F").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return G.mark_edges(fe, _status_edges(spark, sf_dir, "O"))


@register("g9_append_edges", f"SELECT src, dst FROM ({_status_edges_sql('F')}) a UNION SELECT src, dst FROM ({_status_edges_sql('O')}) b")
def g9_append_edges(spark, sf_dir):
    """Add the open-order edges the finished-order graph does not have yet."""
    return G.append_edges(_status_edges(spark, sf_dir, "F"), _status_edges(spark, sf_dir, "O"))


# ---------------------------------------------------------------- node sketches


@register("n1_node_sketch", Q.node_sketch_sql(CP, F_DEFAULT))
def n1_node_sketch(spark, sf_dir):
    """Flagship N1: 32-bit neighbour SimHash of every customer and part node: (node, degree, sig)."""
    return S.node_sketch(cp_edges(spark, sf_dir), f=F_DEFAULT)


@register("k13_sig_bits_128", with_edges(CP, f"SELECT node, {bits_string_sql(F_EXPERIMENT)} AS bits FROM ({Q.bit_sums_sql(feats(E), F_EXPERIMENT)}) s"))
def k13_sig_bits_128(spark, sf_dir):
    """K13 over N1 at 128 bits: zero-padded binary string of each signature, MSB first."""
    sk = S.node_sketch(cp_edges(spark, sf_dir), f=F_EXPERIMENT)
    return sk.select("node", sig_bits_string(F.col("sig"), F_EXPERIMENT).alias("bits"))


@register(
    "n5_embedding",
    with_edges(
        SP,
        "SELECT node, [" + ", ".join(f"CASE WHEN 2 * s{k} > cnt THEN 1 ELSE 0 END" for k in range(F_DEFAULT)) + f"]::INTEGER[] AS bits "
        f"FROM ({Q.bit_sums_sql(feats(E), F_DEFAULT)}) s",
    ),
)
def n5_embedding(spark, sf_dir):
    """Embedding rows (node, bits ARRAY<INT>) of the supplier–part graph."""
    return S.embedding(S.node_sketch(sp_edges(spark, sf_dir), f=F_DEFAULT), F_DEFAULT)


@register(
    "k10_sha256_sketch",
    with_edges(SP, f"SELECT node, CAST(cnt - 1 AS BIGINT) AS degree, {Q.sig_sql(64)} AS sig FROM "
               f"({Q.bit_sums_sql(feats(E), 64, digest='sha256', hex_len=64)}) s"),
)
def k10_sha256_sketch(spark, sf_dir):
    """Pluggable feature hash (SHA-256 words instead of MD5), 64 bits."""
    return S.node_sketch(sp_edges(spark, sf_dir), f=64, hash_words=sha256_words)


_K9_BAG = (
    "SELECT o.o_custkey AS customer, 'item_' || CAST(l.l_partkey AS VARCHAR) AS part, CAST(sum(l.l_quantity) AS BIGINT) AS qty "
    "FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2"
)


@register(
    "k9_weighted_bag",
    f"SELECT customer, CAST(cnt AS BIGINT) AS cnt, {Q.sig_sql(64)} AS sig FROM "
    f"({Q.bit_sums_sql(_K9_BAG, 64, key='customer', feature='part', weight='qty')}) s",
)
def k9_weighted_bag(spark, sf_dir):
    """K9: SimHash of weighted bags: each customer's parts weighted by total quantity (weights above 50 included)."""
    orders = T.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = T.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    bag = (
        orders.join(items, orders.o_orderkey == items.l_orderkey)
        .groupBy(F.col("o_custkey").alias("customer"), F.concat(F.lit("item_"), F.col("l_partkey").cast("string")).alias("part"))
        .agg(F.sum("l_quantity").cast("long").alias("qty"))
    )
    return S.simhash_features(bag, "customer", feature="part", weight="qty", f=64)


# ---------------------------------------------------------------- walks and PageRank


WALK_SQL = with_edges(CP, Q.walk_visits_sql(E, WALK_LENGTH, WALKS, SEED))


@register("g2_random_walk_visits", WALK_SQL)
def g2_random_walk_visits(spark, sf_dir):
    """Visit counts of 500 walks of length 3 from every node (hash-chosen steps)."""
    return W.random_walk_visits(cp_edges(spark, sf_dir), length=WALK_LENGTH, walks=WALKS, seed=SEED)


@register(
    "n2_walk_sketch",
    f"SELECT node, {bits_string_sql(F_EXPERIMENT)} AS bits FROM ("
    f"{Q.bit_sums_sql(f'SELECT source AS node, visited AS feature, cnt FROM ({WALK_SQL}) v', F_EXPERIMENT, weight='cnt')}) s",
)
def n2_walk_sketch(spark, sf_dir):
    """128-bit SimHash of random-walk visit counts."""
    visits = W.random_walk_visits(cp_edges(spark, sf_dir), length=WALK_LENGTH, walks=WALKS, seed=SEED)
    sk = S.weighted_sketch(visits.select(F.col("source").alias("node"), F.col("visited").alias("feature"), F.col("cnt").alias("weight")), F_EXPERIMENT, placed="together")
    return sk.select("node", sig_bits_string(F.col("sig"), F_EXPERIMENT).alias("bits"))


PPR_SQL = with_edges(CP, Q.ppr_sql(E, f"SELECT node FROM ({Q.half_edges(E)}) h GROUP BY node ORDER BY count(*) DESC, node LIMIT {PPR_SOURCES}"))


@register("g3_personalized_pagerank", PPR_SQL)
def g3_personalized_pagerank(spark, sf_dir):
    """Personalized PageRank mass (fixed point, 1.0 = 1e12) of all nodes as seen from the 20 nodes
    with the most neighbours, to the reference's tolerance, nothing cut: each source's mass is 1."""
    e = cut_lineage(cp_edges(spark, sf_dir))
    sources = G.degrees(e).orderBy(F.desc("degree"), "node").limit(PPR_SOURCES).select("node")
    return W.personalized_pagerank(e, sources=cut_lineage(sources))


@register(
    "n3_ppr_sketch",
    with_edges(CP, f"SELECT node, {bits_string_sql(F_EXPERIMENT)} AS bits FROM ({Q.ppr_sums_sql(E, F_EXPERIMENT)}) s"),
)
def n3_ppr_sketch(spark, sf_dir):
    """128-bit SimHash of personalized PageRank mass of every node, by the recurrence of its bit sums."""
    sk = S.majority(W.pagerank_bit_sums(cp_edges(spark, sf_dir), F_EXPERIMENT), F_EXPERIMENT)
    return sk.select("node", sig_bits_string(F.col("sig"), F_EXPERIMENT).alias("bits"))


# ---------------------------------------------------------------- text SimHash


DOCS = "SELECT doc_id, text FROM documents"
SHINGLES_SQL = Q.shingles_sql(DOCS)
TEXT_SUMS_SQL = Q.bit_sums_sql(SHINGLES_SQL, TEXT_F, key="doc_id")
TEXT_SIG_SQL = f"SELECT doc_id, CAST(cnt AS BIGINT) AS shingles, {Q.sig_sql(TEXT_F)} AS sig FROM ({TEXT_SUMS_SQL}) s"


def _text_sigs(spark, sf_dir) -> DataFrame:
    return S.text_simhash(T.load(spark, sf_dir, "documents").select("doc_id", "text"), f=TEXT_F)


@register("k5_char_shingles", f"SELECT doc_id, feature AS shingle, CAST(count(*) AS BIGINT) AS cnt FROM ({SHINGLES_SQL}) s GROUP BY doc_id, feature")
def k5_char_shingles(spark, sf_dir):
    """K5: 4-character shingles of every whole document, with their counts."""
    return S.shingle_counts(T.load(spark, sf_dir, "documents").select("doc_id", "text"))


@register("k6_text_simhash", TEXT_SIG_SQL)
def k6_text_simhash(spark, sf_dir):
    """K6: 64-bit text SimHash of every document (shingle counts as weights)."""
    return _text_sigs(spark, sf_dir)


@register(
    "k8_duplicate_signatures",
    f"WITH t AS ({TEXT_SIG_SQL}), g AS (SELECT sig, count(*) AS copies, min(doc_id) AS first_id FROM t GROUP BY sig HAVING count(*) > 1) "
    "SELECT t.doc_id, t.sig, CAST(g.copies AS BIGINT) AS copies, g.first_id FROM t JOIN g ON t.sig = g.sig",
)
def k8_duplicate_signatures(spark, sf_dir):
    """K8: documents whose text signature equals another's."""
    return S.duplicate_signatures(_text_sigs(spark, sf_dir))


_REACH = (
    "WITH RECURSIVE e AS MATERIALIZED ({edges}), s AS MATERIALIZED (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e), "
    "r AS (SELECT DISTINCT u AS node, u AS reached FROM s UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.reached), "
    "c AS (SELECT node, min(reached) AS component FROM r GROUP BY node) "
)
# copies hang on the smallest id of their signature; signatures are compared with all others
BAND_LINKS_SQL = (
    f"WITH sg AS MATERIALIZED ({TEXT_SIG_SQL}), cl AS MATERIALIZED (SELECT sig, min(doc_id) AS r FROM sg GROUP BY sig) "
    f"SELECT sg.doc_id AS a, cl.r AS b, {TEXT_F} AS sim FROM sg JOIN cl ON cl.sig = sg.sig WHERE sg.doc_id <> cl.r UNION ALL "
    f"SELECT y.r AS a, x.r AS b, CAST({TEXT_F} - bit_count(xor(x.sig, y.sig)) AS INTEGER) AS sim FROM cl x JOIN cl y "
    f"ON x.r < y.r AND bit_count(xor(x.sig, y.sig)) < {TEXT_BANDS}"
)


@register("m10_band_links", BAND_LINKS_SQL)
def m10_band_links(spark, sf_dir):
    """M10 + K7: near-duplicate links: signatures that differ in fewer than 4 of 64 bits, found by 4 bands, each verified."""
    return PR.band_links(_text_sigs(spark, sf_dir), TEXT_F, TEXT_BANDS, key="doc_id")


@register(
    "m10_near_duplicate_clusters",
    _REACH.format(edges=f"SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM ({BAND_LINKS_SQL}) l") + "SELECT node AS doc_id, component AS cluster FROM c",
)
def m10_near_duplicate_clusters(spark, sf_dir):
    """Near-duplicate clusters: connected components of the verified links."""
    return PR.near_duplicate_clusters(_text_sigs(spark, sf_dir), TEXT_F, TEXT_BANDS, key="doc_id")


# ---------------------------------------------------------------- pair similarity


CP_WORDS_SQL = f"SELECT node, {Q.sig_words_sql(F_EXPERIMENT)} FROM ({Q.bit_sums_sql(feats(E), F_EXPERIMENT)}) s"


def _cp_sketch128(spark, sf_dir) -> DataFrame:
    return S.node_sketch(cp_edges(spark, sf_dir), f=F_EXPERIMENT, canonical=False)


def _edges_and_sketch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The edges, joined and made distinct once for both uses, and their sketch, made once for both ends."""
    e = cut_lineage(cp_edges(spark, sf_dir))
    return e, cut_lineage(S.node_sketch(e, f=F_EXPERIMENT, canonical=False).select("node", "sig"))


def _edge_pairs_sql(expr: str, name: str) -> str:
    return with_edges(
        CP,
        f"SELECT e.src, e.dst, {expr} AS {name} FROM e JOIN w x ON x.node = e.src JOIN w y ON y.node = e.dst",
        extra=f"w AS ({CP_WORDS_SQL})",
    )


def _score_edges(spark, sf_dir, measure: str) -> DataFrame:
    e, sk = _edges_and_sketch(spark, sf_dir)
    return PR.score_pairs(e, sk, measure=measure, f=F_EXPERIMENT, a="src", b="dst")


@register("m11_edge_hamming", _edge_pairs_sql(Q.hamming_sim_sql(F_EXPERIMENT), "sim"))
def m11_edge_hamming(spark, sf_dir):
    """M11 + M1: look up both endpoint sketches of every edge; Hamming similarity (equal positions)."""
    return _score_edges(spark, sf_dir, "hamming")


_DOT = "(CAST(bit_count(x.w0 & y.w0) AS INTEGER) + CAST(bit_count(x.w1 & y.w1) AS INTEGER))"
_ONES_X = "(CAST(bit_count(x.w0) AS INTEGER) + CAST(bit_count(x.w1) AS INTEGER))"
_ONES_Y = "(CAST(bit_count(y.w0) AS INTEGER) + CAST(bit_count(y.w1) AS INTEGER))"


@register("m2_similarity_from_counts", _edge_pairs_sql(f"CAST({_DOT} + ({F_EXPERIMENT} - ({_ONES_X} + {_ONES_Y} - {_DOT})) AS INTEGER)", "sim"))
def m2_similarity_from_counts(spark, sf_dir):
    """M2: equal positions from 1-counts, dot + (L - (|a| + |b| - dot))."""
    from graphsig.functions import similarity as SIM
    from graphsig.functions.hashing import sig_words

    e, sk = _edges_and_sketch(spark, sf_dir)
    a = sk.select(F.col("node").alias("src"), F.col("sig").alias("sa"))
    b = sk.select(F.col("node").alias("dst"), F.col("sig").alias("sb"))
    j = e.join(a, "src").join(b, "dst")
    wa, wb = sig_words(F.col("sa"), F_EXPERIMENT), sig_words(F.col("sb"), F_EXPERIMENT)
    sim = SIM.similarity_from_counts(SIM.common_ones(wa, wb), SIM.ones(wa), SIM.ones(wb), F_EXPERIMENT)
    return j.select("src", "dst", sim.alias("sim"))


@register("m6_complement_dot", _edge_pairs_sql(f"CAST({F_EXPERIMENT} - {_DOT} AS INTEGER)", "cdot"))
def m6_complement_dot(spark, sf_dir):
    """M6: L - dot(a, b) for every edge (named a distance in the reference; not the Hamming distance)."""
    from graphsig.functions import similarity as SIM
    from graphsig.functions.hashing import sig_words

    e, sk = _edges_and_sketch(spark, sf_dir)
    a = sk.select(F.col("node").alias("src"), F.col("sig").alias("sa"))
    b = sk.select(F.col("node").alias("dst"), F.col("sig").alias("sb"))
    j = e.join(a, "src").join(b, "dst")
    return j.select("src", "dst", SIM.complement_dot(sig_words(F.col("sa"), F_EXPERIMENT), sig_words(F.col("sb"), F_EXPERIMENT), F_EXPERIMENT).alias("cdot"))


@register(
    "m3_edge_cosine_bits",
    _edge_pairs_sql(f"round(CASE WHEN {_ONES_X} * {_ONES_Y} = 0 THEN 0.0 ELSE {_DOT} / sqrt(CAST({_ONES_X} AS DOUBLE) * {_ONES_Y}) END, 6)", "sim"),
)
def m3_edge_cosine_bits(spark, sf_dir):
    """M3 on 0/1 sketches: cosine of every edge's endpoint sketches (zero vectors score 0)."""
    return _score_edges(spark, sf_dir, "cosine")


@register("m4_edge_dot_bits", _edge_pairs_sql(f"CAST({_DOT} AS INTEGER)", "sim"))
def m4_edge_dot_bits(spark, sf_dir):
    """M4 on 0/1 sketches: dot product (common ones) of every edge's endpoint sketches."""
    return _score_edges(spark, sf_dir, "dot_product")


@register(
    "m5_cosine_consecutive",
    "SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / "
    "nullif(sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * "
    "sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))), 0), 6) AS cos "
    "FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
)
def m5_cosine_consecutive(spark, sf_dir):
    """M5: cosine of two float vectors (NULL on a zero norm) for each vector and its successor id."""
    from graphsig.functions.similarity import cosine

    emb = T.load(spark, sf_dir, "embeddings")
    x = emb.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    y = emb.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return x.join(y, "a").select("a", "b", F.round(cosine(F.col("ea"), F.col("eb")), 6).alias("cos"))


@register("m7_top_pairs_hamming", with_edges(CP, Q.top_pairs_sql(f"SELECT * FROM ({CP_WORDS_SQL}) w", F_EXPERIMENT, TOP_K)))
def m7_top_pairs_hamming(spark, sf_dir):
    """M7: exact global top 100,000 node pairs by Hamming similarity of 128-bit sketches."""
    return PR.top_pairs(_cp_sketch128(spark, sf_dir), k=TOP_K, measure="hamming", f=F_EXPERIMENT)


@register(
    "m8_top_pairs_cosine_bits",
    with_edges(
        CP,
        f"SELECT x.node AS a, y.node AS b, round(CASE WHEN {_ONES_X} * {_ONES_Y} = 0 THEN 0.0 ELSE {_DOT} / sqrt(CAST({_ONES_X} AS DOUBLE) * {_ONES_Y}) END, 6) AS sim "
        "FROM w x JOIN w y ON x.node > y.node ORDER BY sim DESC, a, b LIMIT 100000",
        extra=f"w AS ({CP_WORDS_SQL})",
    ),
)
def m8_top_pairs_cosine_bits(spark, sf_dir):
    """M8: top 100,000 pairs of a dense similarity (cosine of 0/1 sketches), ties by (a, b)."""
    return PR.top_pairs(_cp_sketch128(spark, sf_dir), k=TOP_K, measure="cosine", f=F_EXPERIMENT)


def _emb_top_sql(expr: str) -> str:
    return (
        "WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS node, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "
        f"SELECT x.node AS a, y.node AS b, {expr} AS sim FROM v x JOIN v y ON x.node > y.node ORDER BY sim DESC, a, b LIMIT {TOP_K}"
    )


@register(
    "m3_top_pairs_cosine_vectors",
    _emb_top_sql("round(coalesce(list_dot_product(x.e, y.e) / nullif(sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e)), 0), 0.0), 6)"),
)
def m3_top_pairs_cosine_vectors(spark, sf_dir):
    """M3: top 100,000 pairs of float embeddings by cosine."""
    emb = T.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return PR.top_pairs(emb, k=TOP_K, measure="cosine", vector="embedding")


@register("m4_top_pairs_dot_vectors", _emb_top_sql("round(list_dot_product(x.e, y.e), 6)"))
def m4_top_pairs_dot_vectors(spark, sf_dir):
    """M4: top 100,000 pairs of float embeddings by dot product."""
    emb = T.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return PR.top_pairs(emb, k=TOP_K, measure="dot_product", vector="embedding")


# ---------------------------------------------------------------- splits (hash order, exact counts)


def _labels(name: str, links: str) -> str:
    """CTEs: the smallest node of the component of each end of ``links(src, dst)``; only nodes whose label fell pass it on."""
    return (
        f"{name}_s AS MATERIALIZED (SELECT src AS u, dst AS v FROM ({links}) e UNION ALL SELECT dst, src FROM ({links}) e), "
        f"{name}(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM {name}_s UNION SELECT s.v, min({name}.component) FROM {name} "
        f"JOIN {name}_s s ON s.u = {name}.node JOIN recurring.{name} AS k ON k.node = s.v WHERE {name}.component < k.component GROUP BY s.v)"
    )


#: Each round at least halves the components that are not whole, so these do for 2**24 nodes.
FOREST_ROUNDS = 24


def forest_sql(edges: str, seed: int = SEED, rounds: int = FOREST_ROUNDS) -> str:
    """Each component's lightest edge out of it is in the forest; then the joined components are one."""
    parts = [
        f"e AS MATERIALIZED (SELECT src, dst, md5('{seed}|' || src || '|' || dst) AS w FROM ({edges}) p)",
        "m0 AS MATERIALIZED (SELECT src AS node, src AS comp FROM e UNION SELECT dst, dst FROM e)",
    ]
    for t in range(rounds):
        parts += [
            f"x{t} AS MATERIALIZED (SELECT e.w, a.comp AS src, b.comp AS dst FROM e JOIN m{t} a ON a.node = e.src JOIN m{t} b ON b.node = e.dst WHERE a.comp <> b.comp)",
            f"k{t} AS MATERIALIZED (SELECT w, src, dst FROM x{t} WHERE w IN (SELECT min(w) FROM (SELECT src AS comp, w FROM x{t} UNION ALL SELECT dst, w FROM x{t}) y GROUP BY comp))",
            _labels(f"c{t}", f"SELECT src, dst FROM k{t}"),
            f"m{t + 1} AS MATERIALIZED (SELECT m.node, coalesce(c.component, m.comp) AS comp FROM m{t} m LEFT JOIN c{t} c ON c.node = m.comp)",
        ]
    chosen = " UNION ALL ".join(f"SELECT w FROM k{t}" for t in range(rounds))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT src, dst FROM e WHERE w IN ({chosen})"


def split_ctes(seed: int) -> str:
    """The nested split drawn with ``seed`` and its labelled rows."""
    return ", ".join(
        [
            f"e AS ({CP})",
            f"test_pos AS ({Q.holdout_sql(E, HOLDOUT_P, seed)})",
            f"g_test AS ({Q.minus_sql(E, 'SELECT src, dst FROM test_pos')})",
            f"test_neg AS ({Q.negatives_sql(E, 'SELECT count(*) FROM test_pos', seed + 1)})",
            f"train_pos AS ({Q.holdout_sql('SELECT src, dst FROM g_test', HOLDOUT_P, seed + 100)})",
            f"g_train AS ({Q.minus_sql('SELECT src, dst FROM g_test', 'SELECT src, dst FROM train_pos')})",
            f"train_neg AS ({Q.negatives_sql('SELECT src, dst FROM g_test', 'SELECT count(*) FROM train_pos', seed + 101)})",
            f"nd AS ({Q.nodes_sql(E)})",
            "test_rows AS (SELECT src, dst, 1 AS label FROM test_pos UNION ALL SELECT src, dst, 0 AS label FROM test_neg)",
            "train_rows AS (SELECT src, dst, 1 AS label FROM train_pos UNION ALL SELECT src, dst, 0 AS label FROM train_neg)",
        ]
    )


SPLIT_CTES = split_ctes(SEED)


def connected_ctes(name: str, edges: str, p: float, seed: int) -> str:
    """CTE ``name``: the edges held out of ``edges`` (which names no ``e``) beside its spanning forest."""
    forest = f"{name}_forest AS MATERIALIZED (SELECT * FROM ({forest_sql(edges, seed)}) f)"
    return f"{forest}, {name} AS MATERIALIZED ({Q.holdout_connected_sql(edges, f'SELECT src, dst FROM {name}_forest', p, seed)})"


ALL_EDGES, TEST_EDGES = "SELECT src, dst FROM all_edges", "SELECT src, dst FROM g_test"
CONNECTED_CTES = ", ".join(
    [
        f"all_edges AS MATERIALIZED ({CP})",
        connected_ctes("test_pos", ALL_EDGES, HOLDOUT_P, SEED),
        f"g_test AS MATERIALIZED ({Q.minus_sql(ALL_EDGES, 'SELECT src, dst FROM test_pos')})",
        connected_ctes("train_pos", TEST_EDGES, HOLDOUT_P, SEED + 100),
        f"g_train AS MATERIALIZED ({Q.minus_sql(TEST_EDGES, 'SELECT src, dst FROM train_pos')})",
        f"nd AS ({Q.nodes_sql(ALL_EDGES)})",
    ]
)


def split_sql(body: str, extra: str = "", ctes: str = SPLIT_CTES) -> str:
    return f"WITH {ctes}{', ' + extra if extra else ''} SELECT * FROM ({body}) q"


_SPLIT_CACHE: dict[tuple[str, str], object] = {}


def _split(spark, sf_dir, keep_connected: bool = False, negatives: bool = True):
    """Nested split of the customer–part graph (kept per application and input for the queries below)."""
    from graphsig.plans.evaluation import make_split

    key = (spark.sparkContext.applicationId, f"{sf_dir}|{keep_connected}|{negatives}")
    if key not in _SPLIT_CACHE:
        _SPLIT_CACHE[key] = make_split(cp_edges(spark, sf_dir), HOLDOUT_P, SEED, keep_connected, negatives)
    return _SPLIT_CACHE[key]


@register("h1_holdout_edges", split_sql("SELECT src, dst FROM test_pos"))
def h1_holdout_edges(spark, sf_dir):
    """H1: the first int(0.1·|E|) edges in md5(seed|src|dst) order (no connectivity constraint)."""
    held, _ = H.holdout_edges(cp_edges(spark, sf_dir), HOLDOUT_P, SEED, keep_connected=False)
    return held


@register("h1_holdout_connected", f"WITH all_edges AS MATERIALIZED ({CP}), {connected_ctes('held', ALL_EDGES, HOLDOUT_P, SEED)} SELECT src, dst FROM held")
def h1_holdout_connected(spark, sf_dir):
    """H1 with keep_connected: spanning-forest edges are never held out."""
    held, _ = H.holdout_edges(cp_edges(spark, sf_dir), HOLDOUT_P, SEED, keep_connected=True)
    return held


@register("h2_negative_edges", split_sql("SELECT src, dst FROM test_neg"))
def h2_negative_edges(spark, sf_dir):
    """H2: as many non-edges as held-out edges, by hash-drawn candidate order."""
    e = cut_lineage(cp_edges(spark, sf_dir))
    held, _ = H.holdout_edges(e, HOLDOUT_P, SEED, keep_connected=False, canonical=True)
    return H.negative_edges(e, held.count(), SEED + 1, canonical=True)


@register(
    "h3_nested_split",
    split_sql(
        "SELECT src, dst, label, 'test' AS split FROM test_rows UNION ALL SELECT src, dst, label, 'train' AS split FROM train_rows"
    ),
)
def h3_nested_split(spark, sf_dir):
    """H3: G -> G_test -> G_train; labelled positives and negatives of both levels."""
    sp = _split(spark, sf_dir)
    return sp.test.unionByName(sp.train)


@register(
    "h4_random_split",
    split_sql(
        "SELECT src, dst, label, CASE WHEN rn - 1 < (SELECT CAST(floor(0.75 * count(*)) AS BIGINT) FROM train_rows) THEN 'train' ELSE 'selection' END AS part "
        f"FROM (SELECT src, dst, label, row_number() OVER (ORDER BY h, src, dst, label) AS rn FROM "
        f"(SELECT src, dst, label, {Q.hash_order_sql(SEED, 'src', 'dst', 'label')} AS h FROM train_rows) x) y"
    ),
)
def h4_random_split(spark, sf_dir):
    """H4: 75/25 split of the labelled train rows by hash rank."""
    rows = _split(spark, sf_dir).train.select("src", "dst", "label")
    return H.random_split(rows, 0.75, SEED, key_cols=["src", "dst", "label"])


@register("h5_stream_split", f"WITH all_edges AS MATERIALIZED ({CP}), {connected_ctes('held', ALL_EDGES, 0.5, SEED)} SELECT src, dst FROM held")
def h5_stream_split(spark, sf_dir):
    """H5: base graph (50%) and stream edges, spanning forest kept in the base."""
    _, stream = H.stream_split(cp_edges(spark, sf_dir), 0.5, SEED, keep_connected=True)
    return stream


@register(
    "h5_stream_labelled",
    f"WITH all_edges AS MATERIALIZED ({CP}), {connected_ctes('held', ALL_EDGES, 0.5, SEED)}, "
    f"fake AS ({Q.negatives_sql(ALL_EDGES, 'SELECT count(*) FROM held', SEED + 1)}) "
    "SELECT src, dst, 1 AS label FROM held UNION ALL SELECT src, dst, 0 AS label FROM fake",
)
def h5_stream_labelled(spark, sf_dir):
    """H5 with negatives: the stream's edges (label 1) and as many non-edges of the graph (label 0)."""
    _, stream = H.stream_split(cp_edges(spark, sf_dir), 0.5, SEED, keep_connected=True, negatives=True)
    return stream


# ---------------------------------------------------------------- precision, AUC, features

TRAIN_WORDS = f"SELECT node, {Q.sig_words_sql(F_EXPERIMENT)} FROM ({Q.bit_sums_sql(feats('SELECT src, dst FROM g_train', 'SELECT node FROM nd'), F_EXPERIMENT)}) s"
RANKED = f"ranked AS ({Q.top_pairs_sql('SELECT * FROM tw', F_EXPERIMENT, None)})"
TW = f"tw AS ({TRAIN_WORDS})"


def _train_vectors(spark, sf_dir, negatives: bool = True):
    from graphsig.plans.models import SimHashSketch

    sp = _split(spark, sf_dir, negatives=negatives)
    state = SimHashSketch(dimensions=F_EXPERIMENT).fit(sp.g_train, sp.nodes, canonical=True)
    return sp, state.embedding()


@register("r2_precision_at_100", split_sql(Q.precision_sql("SELECT * FROM ranked", E, "SELECT src, dst FROM g_train"), f"{TW}, {RANKED}"))
def r2_precision_at_100(spark, sf_dir):
    """128-bit neighbour sketch of G_train, precision at the 100th hit of G among all pairs."""
    sp, vec = _train_vectors(spark, sf_dir, negatives=False)
    return L.precision_at_hits(vec, sp.graph, sp.g_train, 100, f=F_EXPERIMENT)


@register(
    "r3_precision_at_100_connected",
    split_sql(Q.precision_sql("SELECT * FROM ranked", ALL_EDGES, "SELECT src, dst FROM g_train"), f"{TW}, {RANKED}", CONNECTED_CTES),
)
def r3_precision_at_100_connected(spark, sf_dir):
    """R3 with the reference's keep_connected splits (spanning forest kept in every split)."""
    from graphsig.plans.evaluation import precision_at_100
    from graphsig.plans.models import SimHashSketch

    res, _ = precision_at_100(_split(spark, sf_dir, keep_connected=True, negatives=False), SimHashSketch(dimensions=F_EXPERIMENT))
    return res


_NON_EDGES = (
    "SELECT a, b, sim FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM g_train g WHERE g.src = least(r.a, r.b) AND g.dst = greatest(r.a, r.b)) "
    "ORDER BY sim DESC, a, b LIMIT 100"
)


@register("r4_top_non_edges", split_sql(_NON_EDGES, f"{TW}, {RANKED}"))
def r4_top_non_edges(spark, sf_dir):
    """The 100 most similar pairs that are not edges of the train graph."""
    sp, vec = _train_vectors(spark, sf_dir, negatives=False)
    return L.top_train_non_edges(cut_lineage(vec), sp.g_train, 100, f=F_EXPERIMENT)


@register(
    "r5_top_similarity_precision",
    split_sql(
        "SELECT CAST(coalesce(sum(hit), 0) AS BIGINT) AS tp, round(coalesce(sum(hit), 0) / 100.0, 6) AS precision FROM "
        f"(SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.src = least(t.a, t.b) AND e.dst = greatest(t.a, t.b)) THEN 1 ELSE 0 END AS hit FROM ({_NON_EDGES}) t) x",
        f"{TW}, {RANKED}",
    ),
)
def r5_top_similarity_precision(spark, sf_dir):
    """Share of those 100 pairs that are edges of the full graph."""
    sp, vec = _train_vectors(spark, sf_dir, negatives=False)
    top = L.top_train_non_edges(cut_lineage(vec), sp.g_train, 100, f=F_EXPERIMENT)
    return L.top_similarity_precision(top, sp.graph, sp.g_train, 100)


_TEST_SCORED = (
    f"SELECT t.src, t.dst, t.label, {Q.hamming_sim_sql(F_EXPERIMENT)} AS sim FROM test_rows t "
    "JOIN tw x ON x.node = t.src JOIN tw y ON y.node = t.dst"
)


@register(
    "r6_test_edge_precision",
    split_sql(
        "SELECT CAST(coalesce(sum(hit), 0) AS BIGINT) AS tp, round(coalesce(sum(hit), 0) / 100.0, 6) AS precision FROM "
        "(SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.src = s.src AND e.dst = s.dst) THEN 1 ELSE 0 END AS hit FROM "
        f"(SELECT * FROM ({_TEST_SCORED}) z WHERE src < dst ORDER BY sim DESC, src, dst LIMIT 100) s) x",
        TW,
    ),
)
def r6_test_edge_precision(spark, sf_dir):
    """Rank the labelled test pairs by train-sketch similarity; true edges among the top 100, /100."""
    sp, vec = _train_vectors(spark, sf_dir)
    scored = PR.score_pairs(sp.test, vec, "hamming", F_EXPERIMENT, a="src", b="dst")
    return L.test_edge_precision(scored, sp.graph, 100)


@register(
    "r1_roc_auc",
    split_sql(
        "SELECT round(sum(pos * (neg_upto - neg) + pos * neg * 0.5) / (sum(pos) * sum(neg)), 6) AS roc_auc, "
        "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM ("
        "SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_upto FROM "
        f"(SELECT sim AS score, sum(label) AS pos, sum(1 - label) AS neg FROM ({_TEST_SCORED}) z GROUP BY sim) p) c",
        TW,
    ),
)
def r1_roc_auc(spark, sf_dir):
    """ROC AUC (rank sums, ties one half) of sketch similarity as the link score on the test split."""
    sp, vec = _train_vectors(spark, sf_dir)
    scored = PR.score_pairs(sp.test, vec, "hamming", F_EXPERIMENT, a="src", b="dst").withColumnRenamed("sim", "score")
    return L.roc_auc(scored, "label", "score")


def _test_bits_sql() -> str:
    gt_sums = Q.bit_sums_sql(feats("SELECT src, dst FROM g_test", "SELECT node FROM nd"), F_EXPERIMENT)
    bits = ", ".join(f"CASE WHEN 2 * s{k} > cnt THEN 1.0 ELSE 0.0 END" for k in range(F_EXPERIMENT))
    return f"tb AS (SELECT node, [{bits}]::DOUBLE[] AS bits FROM ({gt_sums}) s)"


def _features_sql(expr: str) -> str:
    return split_sql(
        f"SELECT t.src, t.dst, t.label, {expr} AS features FROM test_rows t JOIN tb x ON x.node = t.src JOIN tb y ON y.node = t.dst",
        _test_bits_sql(),
    )


def _edge_features(spark, sf_dir, op: str) -> DataFrame:
    from graphsig.plans.models import SimHashSketch

    sp = _split(spark, sf_dir)
    emb = SimHashSketch(dimensions=F_EXPERIMENT).fit(sp.g_test, sp.nodes, canonical=True).embedding()
    return L.edge_features(sp.test, emb, op, vector="sig", f=F_EXPERIMENT).select("src", "dst", "label", "features")


@register("e1_edge_features_concat", _features_sql("list_concat(x.bits, y.bits)"))
def e1_edge_features_concat(spark, sf_dir):
    """Concatenated endpoint embeddings (test graph) for the labelled test pairs."""
    return _edge_features(spark, sf_dir, "concat")


@register("e2_edge_features_hadamard", _features_sql("list_transform(list_zip(x.bits, y.bits), lambda p: p[1] * p[2])"))
def e2_edge_features_hadamard(spark, sf_dir):
    """Hadamard product of the endpoint embeddings."""
    return _edge_features(spark, sf_dir, "hadamard")


@register("e3_edge_features_average", _features_sql("list_transform(list_zip(x.bits, y.bits), lambda p: (p[1] + p[2]) / 2)"))
def e3_edge_features_average(spark, sf_dir):
    """Average of the endpoint embeddings."""
    return _edge_features(spark, sf_dir, "average")


@register("e5_classifier_roc_auc")
def e5_classifier_roc_auc(spark, sf_dir):
    """Logistic regression over concat edge vectors, 10 strengths x 10 folds, ROC AUC on test."""
    from graphsig.plans.evaluation import classifier_auc
    from graphsig.plans.models import SimHashSketch

    return classifier_auc(_split(spark, sf_dir), SimHashSketch(dimensions=F_EXPERIMENT), "concat")


# ---------------------------------------------------------------- components


# All purchases as a customer-part graph (one component, bipartite), beside it for each customer's nation
# the parts bought in one order (components of all sizes, odd cycles). Every row of lineitem counts.
_TOGETHER = (
    "SELECT DISTINCT 'n' || coalesce(c.c_nationkey, -1) || '_item_' || x.l_partkey AS src, 'n' || coalesce(c.c_nationkey, -1) || '_item_' || y.l_partkey AS dst "
    "FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey JOIN orders o ON o.o_orderkey = x.l_orderkey "
    "LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE x.l_partkey <> y.l_partkey"
)
BOUGHT = f"{CP} UNION ALL {Q.canonical(_TOGETHER)}"


def bought_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    nations = T.load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = F.concat(F.lit("n"), F.coalesce("c_nationkey", F.lit(-1)).cast("string"), F.lit("_item_"), F.col("l_partkey").cast("string"))
    parts = items.join(orders, "l_orderkey").join(nations, "c_custkey", "left").select("l_orderkey", named.alias("src"))
    pairs = parts.join(parts.select("l_orderkey", F.col("src").alias("dst")), "l_orderkey").filter(F.col("src") < F.col("dst"))
    return cp_edges(spark, sf_dir).unionByName(G.canonical_edges(pairs.select("src", "dst")))


def components_sql(edges: str) -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED ({edges}), {_labels('c', E)} SELECT node, component FROM c"


@register("g8_connected_components", components_sql(BOUGHT))
def g8_connected_components(spark, sf_dir):
    """Component (smallest node id) of every node of the purchase graphs."""
    return C.connected_components(bought_edges(spark, sf_dir))


@register("g7_spanning_forest", forest_sql(BOUGHT))
def g7_spanning_forest(spark, sf_dir):
    """Minimum spanning forest of the purchase graphs under md5 edge weights."""
    return C.spanning_forest(bought_edges(spark, sf_dir), SEED)


def sides_sql(edges: str) -> str:
    cover = f"SELECT src || chr(1) || x AS src, dst || chr(1) || (1 - x) AS dst FROM (SELECT src, dst, unnest([0, 1]) AS x FROM ({edges}) b) y"
    return (
        f"WITH RECURSIVE e AS MATERIALIZED ({cover}), {_labels('c', E)} "
        "SELECT a.node[:-3] AS node, CAST(CASE WHEN a.component = b.component THEN NULL WHEN a.component < b.component THEN 0 ELSE 1 END AS INTEGER) AS side "
        "FROM c a JOIN c b ON a.node[:-3] = b.node[:-3] AND a.node[-1:] = '0' AND b.node[-1:] = '1'"
    )


@register("g6_bipartite_sides", sides_sql(BOUGHT))
def g6_bipartite_sides(spark, sf_dir):
    """2-colouring of the purchase graphs (NULL side in a non-bipartite component)."""
    return C.bipartite_sides(bought_edges(spark, sf_dir))


# ---------------------------------------------------------------- incremental maintenance

STREAM_CTES = f"e AS ({CP}), held AS ({Q.holdout_sql(E, 0.5, SEED)}), rest AS ({Q.minus_sql(E, 'SELECT src, dst FROM held')})"


BATCH_CTES = f"e AS ({CP}), held AS MATERIALIZED ({Q.holdout_sql(E, BATCH_P, SEED)}), rest AS MATERIALIZED ({Q.minus_sql(E, 'SELECT src, dst FROM held')}), ends AS (SELECT src AS node FROM held UNION SELECT dst FROM held)"


def _base_and_stream(spark, sf_dir, p: float = 0.5):
    e = cut_lineage(cp_edges(spark, sf_dir))
    held, rest = H.holdout_edges(e, p, SEED, keep_connected=False, canonical=True)
    return e, cut_lineage(rest), held


def _updated_sql(old: str, new: str, changed: str) -> str:
    """Bit strings of the old sums, of the new ones where a node changed."""
    bits = bits_string_sql(F_EXPERIMENT)
    return (
        f"WITH {BATCH_CTES}, chg AS MATERIALIZED ({changed}) SELECT node, {bits} AS bits FROM ({old}) o WHERE node NOT IN (SELECT node FROM chg) "
        f"UNION ALL SELECT node, {bits} AS bits FROM ({new}) n WHERE node IN (SELECT node FROM chg)"
    )


REST = "SELECT src, dst FROM rest"


def _walk_sums_sql(edges: str) -> str:
    visits = Q.walk_visits_sql(edges, WALK_LENGTH, WALKS, SEED)
    return Q.bit_sums_sql(f"SELECT source AS node, visited AS feature, cnt FROM ({visits}) v", F_EXPERIMENT, weight="cnt")


# nodes that the graph did not have, and sources whose walks met an end of a new edge often enough
_WALKS_STALE = (
    f"SELECT node FROM ends WHERE node NOT IN (SELECT src FROM rest UNION SELECT dst FROM rest) UNION SELECT v.source FROM "
    f"({Q.walk_visits_sql(REST, WALK_LENGTH, WALKS, SEED)}) v JOIN ends ON ends.node = v.visited WHERE v.cnt >= {int(WALKS * 0.5)}"
)


@register("u1_incremental_sketch", Q.node_sketch_sql(CP, F_DEFAULT))
def u1_incremental_sketch(spark, sf_dir):
    """Sketch half the graph, then add the other half's edges to the stored sums and counts;
    equals the full recompute."""
    from graphsig.operators.incremental import apply_edges, sketch_from_state

    _, rest, held = _base_and_stream(spark, sf_dir)
    state = S.sketch_state(rest, F_DEFAULT)
    updated = apply_edges(state, rest, held, F_DEFAULT)
    return sketch_from_state(updated, F_DEFAULT).select("node", (F.col("cnt") - 1).alias("degree"), "sig")


@register(
    "u2_recompute_endpoints",
    f"WITH sk AS ({Q.node_sketch_sql(CP, F_DEFAULT)}), {BATCH_CTES} SELECT sk.node, sk.degree, sk.sig FROM sk "
    "WHERE sk.node IN (SELECT src FROM held UNION SELECT dst FROM held)",
)
def u2_recompute_endpoints(spark, sf_dir):
    """Recompute only the endpoints of a batch of new edges (1 % of them) from the current graph."""
    from graphsig.operators.incremental import endpoints, recompute_nodes, sketch_from_state

    e, _, held = _base_and_stream(spark, sf_dir, BATCH_P)
    state = recompute_nodes(e, endpoints(held), F_DEFAULT)
    return sketch_from_state(state, F_DEFAULT).select("node", (F.col("cnt") - 1).alias("degree"), "sig")


@register(
    "u3_stale_nodes",
    f"WITH {STREAM_CTES}, v AS ({Q.walk_visits_sql('SELECT src, dst FROM rest', WALK_LENGTH, WALKS, SEED)}), "
    "ends AS (SELECT src AS visited FROM held UNION SELECT dst FROM held) "
    f"SELECT DISTINCT v.source AS node FROM v JOIN ends ON ends.visited = v.visited WHERE v.cnt >= {int(WALKS * 0.5)}",
)
def u3_stale_nodes(spark, sf_dir):
    """Sources whose walk visits to a new edge's endpoint reach half the walks."""
    from graphsig.operators.incremental import stale_nodes

    _, rest, held = _base_and_stream(spark, sf_dir)
    visits = W.random_walk_visits(rest, WALK_LENGTH, WALKS, SEED)
    return stale_nodes(visits, held, WALKS)


@register("u4_walk_refresh", _updated_sql(_walk_sums_sql(REST), _walk_sums_sql(E), _WALKS_STALE))
def u4_walk_refresh(spark, sf_dir):
    """Walk-sketch model updated with 1 % of the edges: new and stale sources re-walked on the new graph."""
    from graphsig.plans.models import SimHashSketch

    _, rest, held = _base_and_stream(spark, sf_dir, BATCH_P)
    model = SimHashSketch(dimensions=F_EXPERIMENT, random_walk_length=WALK_LENGTH, number_of_walks=WALKS)
    state = model.update(model.fit(rest, canonical=True), held)
    return state.embedding().select("node", sig_bits_string(F.col("sig"), F_EXPERIMENT).alias("bits"))


@register("u5_ppr_update", _updated_sql(Q.ppr_sums_sql(REST, F_EXPERIMENT), Q.ppr_sums_sql(E, F_EXPERIMENT), "SELECT node FROM ends"))
def u5_ppr_update(spark, sf_dir):
    """PageRank-sketch model; both endpoints of each of 1 % new edges recomputed on the new graph."""
    from graphsig.plans.models import SimHashSketch

    _, rest, held = _base_and_stream(spark, sf_dir, BATCH_P)
    model = SimHashSketch(dimensions=F_EXPERIMENT, use_page_rank=True)
    state = model.update(model.fit(rest, canonical=True), held)
    return state.embedding().select("node", sig_bits_string(F.col("sig"), F_EXPERIMENT).alias("bits"))


@register("u7_fit_or_update", Q.node_sketch_sql(CP, F_DEFAULT).replace("CAST(cnt - 1 AS BIGINT) AS degree, ", ""))
def u7_fit_or_update(spark, sf_dir):
    """Fit on the base graph when no state exists, then update with the added edges."""
    from graphsig.plans.models import SimHashSketch

    _, rest, held = _base_and_stream(spark, sf_dir)
    return SimHashSketch(dimensions=F_DEFAULT).fit_or_update(None, rest, held, canonical=True).embedding()


# ---------------------------------------------------------------- streaming

EVENT_EDGES_SQL = Q.canonical(
    "SELECT 'user_' || CAST(user_id AS VARCHAR) AS src, 'type_' || event_type AS dst FROM events"
)


@register("t5_stream_sketch", Q.node_sketch_sql(EVENT_EDGES_SQL, F_DEFAULT))
def t5_stream_sketch(spark, sf_dir):
    """T5: events replayed as an edge stream (files of 1,000, ten per trigger); the streaming aggregate equals the batch sketch."""
    from graphsig.session import scratch_path
    from graphsig.streaming.edges import run_stream_sketch, write_stream_files

    src = scratch_path(spark, "event-stream")
    write_stream_files(T.event_edges(spark, sf_dir), src, 1000, ["ts", "src", "dst"], ordered=False)
    return run_stream_sketch(spark, src, scratch_path(spark, "event-sketch"), F_DEFAULT, max_files_per_trigger=10)


@register("t1_stream_replay")
def t1_stream_replay(spark, sf_dir):
    """Replay the stream half of the customer–part graph in batches of 1,000 edges into the
    neighbour model, with precision@100 (32 bits) of the base graph (batch -1) and after every batch,
    the last partial one included."""
    from graphsig.plans.models import SimHashSketch
    from graphsig.session import scratch_path
    from graphsig.streaming.edges import run_edge_stream, write_stream_files

    e = cut_lineage(cp_edges(spark, sf_dir))
    base, stream = H.stream_split(e, 0.5, SEED, keep_connected=True)
    src = scratch_path(spark, "cp-stream")
    write_stream_files(stream.withColumn("ts", F.lit(None).cast("timestamp")), src, 1000, ["src", "dst"])
    def evaluate(state, edges_now):
        return L.precision_at_hits(state.embedding(), e, edges_now, 100, f=F_DEFAULT).first()["precision"]

    model = SimHashSketch(dimensions=F_DEFAULT)
    result = run_edge_stream(spark, src, scratch_path(spark, "cp-replay"), model, base, evaluate)
    return spark.read.parquet(result.metrics).select("batch_id", "added", "edge_count", "precision")


# ---------------------------------------------------------------- NodeSketch and sweep


@register("n6_node_sketch_recursive")
def n6_node_sketch_recursive(spark, sf_dir):
    """NodeSketch baseline (128 dims, decay 0.2, 4 rounds) on the supplier–part graph."""
    from graphsig.operators.nodesketch import recursive_node_sketch

    return recursive_node_sketch(sp_edges(spark, sf_dir), 128, 4, 0.2, SEED)


@register("r9_sweep")
def r9_sweep(spark, sf_dir):
    """Parameter sweep rows (dataset, algorithm, dims, walk length, walks, precision, run time,
    iteration) over the ten configurations of the experiment grid."""
    from graphsig.plans.evaluation import sweep
    from graphsig.plans.models import NodeSketchModel, SimHashSketch

    # fixed values: (walk length, number of walks) of the grid
    grid = [(2, 500), (3, 500), (4, 500), (5, 500), (3, 100), (3, 200), (3, 500), (3, 1000)]
    walks = [SimHashSketch(dimensions=F_EXPERIMENT, random_walk_length=n, number_of_walks=w) for n, w in grid]
    models = [SimHashSketch(dimensions=F_EXPERIMENT), *walks, NodeSketchModel(F_EXPERIMENT, 4, 0.2, SEED)]
    return sweep(cp_edges(spark, sf_dir), [(m.name, m) for m in models], "customer-part", iterations=1, keep_connected=False)


#: Splits that the experiment's mean precision is taken over.
REPEATS = 10


def average_precision_sql(repeats: int) -> str:
    runs = [split_sql(Q.precision_counts_sql(E, "SELECT src, dst FROM g_train", F_EXPERIMENT), TW, split_ctes(SEED + i)) for i in range(repeats)]
    return (
        f"SELECT 'customer-part' AS dataset, 'SimHashSketch' AS algorithm, {F_EXPERIMENT} AS dimensions, "
        f"round(avg(precision), 6) AS avg_precision, count(*) AS runs FROM ({' UNION ALL '.join(f'SELECT * FROM ({r}) r' for r in runs)}) p"
    )


@register("r8_average_precision", average_precision_sql(REPEATS))
def r8_average_precision(spark, sf_dir):
    """Mean precision at the 100th hit of the 128-bit neighbour sketch over ten splits, each with its own seed."""
    from graphsig.plans.evaluation import sweep
    from graphsig.plans.models import SimHashSketch

    model = SimHashSketch(dimensions=F_EXPERIMENT)
    runs = sweep(cp_edges(spark, sf_dir), [("SimHashSketch", model)], "customer-part", REPEATS, SEED, keep_connected=False)
    return L.average_precision(runs, ["dataset", "algorithm", "dimensions"])


@register("s9_state_roundtrip", Q.node_sketch_sql(CP, F_DEFAULT).replace("CAST(cnt - 1 AS BIGINT) AS degree, ", ""))
def s9_state_roundtrip(spark, sf_dir):
    """Save the base state (version 0), update with the stream half, save version 1, reload the latest."""
    from graphsig.plans.models import SimHashSketch
    from graphsig.session import scratch_path
    from graphsig.sources.state import load_state, save_state

    _, rest, held = _base_and_stream(spark, sf_dir)
    model = SimHashSketch(dimensions=F_DEFAULT)
    folder = scratch_path(spark, "state")
    base = model.fit(rest, canonical=True)
    save_state(base, folder, 0)
    save_state(model.update(load_state(spark, folder), held), folder, 1)
    return load_state(spark, folder).embedding()
