"""SimHash over weighted feature bags: bit sums, majority, node and text signatures.

State of a sketch is ``(key, cnt, sums ARRAY)``: total weight and per-bit weighted sums. It is additive,
so sketches can be updated by adding the sums of new features (and the counts: the threshold
moves with them). What is shuffled are the features, not sums: dealt by ranges of (hash of the key, feature) and sorted,
each key is one run of rows of a task (a hot key one run in each of several tasks), and tasks add up
the bits of a run with numpy. The runs, about one for each key, are shuffled and added up likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsig.functions.hashing import (
    HEX_DIGITS,
    HashExpr,
    bit_at,
    bits_of_words_sql,
    check_bits,
    md5_words,
    pack_word_sql,
    sig_bits_array,
    word_spans,
    word_widths,
    words_to_sig,
)
from graphsig.functions.text import SHINGLE_WIDTH, WORD_CHARS, char_shingles
from graphsig.operators.graph import canonical_edges, half_edges
from graphsig.session import cut_lineage


_DIGIT = np.zeros(256, dtype=np.uint8)
_DIGIT[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = np.arange(16, dtype=np.uint8)


def _digit_bits(digits: pa.Array, f: int) -> np.ndarray:
    """(rows, f) bits of strings of ``f / 4`` hex digits."""
    digits = digits.fill_null("0" * (f // 4))
    offsets = np.frombuffer(digits.buffers()[1], dtype=np.int32)[digits.offset : digits.offset + len(digits) + 1]
    four = _DIGIT[np.frombuffer(digits.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, f // 4)]
    return np.unpackbits(four[:, ::2] << 4 | four[:, 1::2], axis=1)


def _word_bits(words: list[pa.Array], f: int) -> np.ndarray:
    parts = []
    for word, width in zip(words, word_widths(f), strict=True):
        value = word.fill_null(0).to_numpy(zero_copy_only=False)
        parts.append(np.unpackbits(value.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :])
    return np.concatenate(parts, axis=1)


def _row_bits(batch: pa.RecordBatch, f: int, weighted: bool, kind) -> tuple:
    """``(counts, rows with a weight, bits)`` of rows ``(key[, weight], digits or words...)``; a missing hash has no bits."""
    hashes = batch.columns[2 if weighted else 1 :]
    bits = _digit_bits(hashes[0], f) if pa.types.is_string(hashes[0].type) else _word_bits(hashes, f)
    if not weighted:
        ones = np.ones(batch.num_rows, dtype=np.int64)
        return ones, ones, bits
    weight = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
    return weight, batch.column(1).is_valid().to_numpy(zero_copy_only=False).astype(np.int64), bits * weight[:, None]


def _row_sums(batch: pa.RecordBatch, f: int) -> tuple:
    """The same of rows ``(key, cnt, sums)``."""
    cnt = batch.column(1)
    known = cnt.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    return cnt.fill_null(0).to_numpy(zero_copy_only=False), known, batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, f)


def _run_sums(f: int, kind, read):
    """One ``(key, cnt, sums)`` for each run of rows with equal keys; the count is null if no row has a weight."""

    def give(keys: pa.Array, cnt: np.ndarray, known: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cnt) + 1, dtype=np.int32) * f), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([keys, pa.array(cnt, mask=known == 0), lists], names=["__key", "cnt", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the run that may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            cnt, known, rows = read(batch)
            cnt, known = np.add.reduceat(cnt, starts), np.add.reduceat(known, starts)
            sums = np.add.reduceat(rows, starts, axis=0, dtype=kind)
            heads = keys.take(pa.array(starts))
            if last is not None and last[0][0].as_py() == heads[0].as_py():
                for now, before in zip((cnt, known, sums), last[1:], strict=True):
                    now[0] += before[0]
            elif last is not None:
                yield give(*last)
            if len(starts) > 1:
                yield give(heads[:-1], cnt[:-1], known[:-1], sums[:-1])
            last = (heads[-1:], cnt[-1:], known[-1:], sums[-1:])
        if last is not None:
            yield give(*last)

    return run


def bit_sums(
    features: DataFrame,
    key: str = "node",
    f: int = 32,
    feature: str = "feature",
    weight: str | None = None,
    hash_words: HashExpr = md5_words,
    placed: str | None = None,
) -> DataFrame:
    """K3: ``(key, cnt, sums)`` with ``cnt = sum(weight)`` and ``sums[k] = sum(bit_k * weight)``.

    ``placed`` tells where a key's rows are, and saves their shuffle: ``"together"`` if they follow each other,
    ``"task"`` if they are in one task or few. Wherever they are, the sums are the same.
    """
    check_bits(f, 512)
    hash_words(F.col(feature), f)  # refuses bits that the hash does not have
    if placed not in (None, "task", "together"):
        raise ValueError(f"unknown place {placed}")
    rows = features.select(F.col(key).alias("__key"), F.col(feature).alias("__f"), *([] if weight is None else [F.col(weight).alias("__w")]))
    if weight is not None and not isinstance(rows.schema["__w"].dataType, (T.IntegralType, T.FloatType, T.DoubleType)):
        return _bit_sums_by_column(rows, key, f, hash_words)
    # by the key's hash, a number, which sorts faster; keys that share one only have more runs
    if placed is None:
        rows = rows.repartitionByRange(F.xxhash64("__key"), "__f")
    if placed != "together":
        rows = rows.sortWithinPartitions(F.xxhash64("__key"))
    given = [] if weight is None else ["__w"]
    hashes = [HEX_DIGITS[hash_words](F.col("__f"), f)] if hash_words in HEX_DIGITS else hash_words(F.col("__f"), f)
    hashed = rows.select("__key", *given, *[h.alias(f"__h{i}") for i, h in enumerate(hashes)])
    floating = weight is not None and not isinstance(rows.schema["__w"].dataType, T.IntegralType)
    number, kind = (T.DoubleType(), np.float64) if floating else (T.LongType(), np.int64)
    out = T.StructType([T.StructField("__key", rows.schema["__key"].dataType), T.StructField("cnt", number), T.StructField("sums", T.ArrayType(number))])
    weighted = weight is not None
    runs = hashed.mapInArrow(_run_sums(f, kind, lambda batch: _row_bits(batch, f, weighted, kind)), out)
    # a key over several tasks has a run in each
    sums = runs.repartition("__key").sortWithinPartitions("__key").mapInArrow(_run_sums(f, kind, lambda batch: _row_sums(batch, f)), out)
    return sums.withColumnRenamed("__key", key)


def _bit_sums_by_column(rows: DataFrame, key: str, f: int, hash_words: HashExpr) -> DataFrame:
    """:func:`bit_sums` of weights that numpy does not add exactly (decimals)."""
    words = hash_words(F.col("__f"), f)
    hashed = rows.select("__key", "__w", *[w.alias(f"__h{i}") for i, w in enumerate(words)])
    wcols = [F.col(f"__h{i}") for i in range(len(words))]
    per_bit = [F.sum(bit_at(wcols, k, f) * F.col("__w")).alias(f"s{k}") for k in range(f)]
    agg = hashed.groupBy("__key").agg(F.sum("__w").alias("cnt"), *per_bit)
    return agg.select(F.col("__key").alias(key), "cnt", F.array(*[F.col(f"s{k}") for k in range(f)]).alias("sums"))


def add_feature(state: DataFrame, key_feature: Column, f: int, hash_words: HashExpr = md5_words, weight: int = 1) -> DataFrame:
    """Add one feature per row (weight ``weight``) to a sum state, e.g. the node's own id."""
    words = hash_words(key_feature, f)
    tagged = state.withColumn("__own", F.array(*words))
    own_bits = bits_of_words_sql("__own", f)
    sums = F.expr(f"zip_with(sums, {own_bits}, (s, b) -> s + b * {int(weight)})")
    return tagged.withColumn("sums", sums).withColumn("cnt", F.col("cnt") + F.lit(weight)).drop("__own")


def majority(state: DataFrame, f: int, out: str = "sig") -> DataFrame:
    """K4: ``bit = 2*sum > cnt`` (ties give 0), packed MSB first (one fold per 64-bit word)."""
    words = [F.expr(pack_word_sql("sums", "cnt", start, width)) for start, width in word_spans(f)]
    return state.withColumn(out, words_to_sig(words, f))


def simhash_features(
    df: DataFrame,
    key: str,
    feature: str | None = None,
    weight: str | None = None,
    tokens: str | None = None,
    weights_map: str | None = None,
    f: int = 64,
    hash_words: HashExpr = md5_words,
) -> DataFrame:
    """K9: SimHash per key from (feature[, weight]) rows, a token-array column or a token->weight map."""
    if sum(x is not None for x in (feature, tokens, weights_map)) != 1:
        raise ValueError("give exactly one of feature, tokens, weights_map")
    if tokens is not None:
        rows = df.select(F.col(key), F.explode(tokens).alias("feature"))
        feature, weight = "feature", None
    elif weights_map is not None:
        rows = df.select(F.col(key), F.explode(weights_map).alias("feature", "weight"))
        feature, weight = "feature", "weight"
    else:
        rows = df
    state = bit_sums(rows, key, f, feature=feature, weight=weight, hash_words=hash_words)
    return majority(state, f).select(key, "cnt", "sig")


def sketch_state(
    edges: DataFrame, f: int = 32, hash_words: HashExpr = md5_words, canonical: bool = True, node_table: DataFrame | None = None
) -> DataFrame:
    """Neighbour bit-sum state ``(node, cnt, sums)`` of every node: closed neighbourhood, weight 1.

    The node's own id is added after aggregation, so no distinct node list (and no extra shuffle)
    is needed for the self-loops. ``node_table(node)`` adds nodes without edges (own id only).
    """
    e = canonical_edges(edges) if canonical else edges
    half = half_edges(e).withColumnRenamed("nb", "feature")
    state = bit_sums(half, "node", f, feature="feature", hash_words=hash_words)
    if node_table is not None:
        zeros = F.array(*[F.lit(0).cast("long") for _ in range(f)])
        state = node_table.select("node").join(state, "node", "left").select(
            "node", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"), F.coalesce("sums", zeros).alias("sums")
        )
    return add_feature(state, F.col("node"), f, hash_words)


def node_sketch(
    edges: DataFrame, f: int = 32, hash_words: HashExpr = md5_words, canonical: bool = True, node_table: DataFrame | None = None
) -> DataFrame:
    """``(node, degree, sig)`` — neighbour SimHash of every node (closed neighbourhood)."""
    check_bits(f, 512)
    state = sketch_state(edges, f, hash_words, canonical, node_table)
    return majority(state, f).select("node", (F.col("cnt") - 1).alias("degree"), "sig")


def weighted_sketch(
    features: DataFrame, f: int = 128, key: str = "node", feature: str = "feature", weight: str = "weight", placed: str | None = None
) -> DataFrame:
    """SimHash of ``(key, feature, weight)`` bags (walk visit counts, PageRank mass): ``(key, cnt, sig)``."""
    state = bit_sums(features, key, f, feature=feature, weight=weight, placed=placed)
    return majority(state, f).select(key, "cnt", "sig")


def text_simhash(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    f: int = 64,
    width: int = SHINGLE_WIDTH,
    pattern: str = WORD_CHARS,
) -> DataFrame:
    """K5+K6: ``(id, shingles, sig)`` from 4-character shingles of the cleaned, lower-cased text.

    Each occurrence is a row of weight 1, so a shingle seen ``n`` times weighs ``n``.
    Few input partitions (one small file) are spread round-robin before the explode.
    """
    spark = docs.sparkSession
    par = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < par:
        docs = docs.repartition(par)
    rows = docs.select(F.col(id_col).alias("__id"), F.explode(char_shingles(F.col(text_col), width, pattern)).alias("feature"))
    state = bit_sums(rows, "__id", f, placed="together")
    return majority(state, f).select(F.col("__id").alias(id_col), F.col("cnt").alias("shingles"), "sig")


def _counted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, shingle, cnt)`` from rows ``(key, shingle)`` whose equal keys follow each other."""

    def give(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys = rows.column(0).dictionary_encode(null_encoding="encode")
        words = rows.column(1).dictionary_encode()
        code = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
        found, cnt = np.unique(code, return_counts=True)
        which, word = np.divmod(found, len(words.dictionary))
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(which)), words.dictionary.take(pa.array(word)), pa.array(cnt)], names=["__key", "shingle", "cnt"])

    open_rows: list[pa.RecordBatch] = []  # of the key that may go on
    for batch in batches:
        if batch.num_rows == 0:
            continue
        code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(code[1:] != code[:-1]) + 1
        if open_rows and open_rows[0].column(0)[0].as_py() == batch.column(0)[0].as_py():
            first = int(ends[0]) if len(ends) else batch.num_rows
            open_rows.append(batch.slice(0, first))
            batch, ends = batch.slice(first), ends[1:] - first
            if batch.num_rows == 0:
                continue
        if open_rows:
            yield give(pa.concat_batches(open_rows))
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield give(batch.slice(0, last))
        open_rows = [batch.slice(last)]
    if open_rows:
        yield give(pa.concat_batches(open_rows))


def shingle_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """K5: ``(id, shingle, cnt)``. A document's shingles stand together and are counted in place; only
    those of documents that share an id are shuffled."""
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    shared = cut_lineage(rows.groupBy(F.col("__key").alias("__same")).count().filter("count > 1").select("__same"))

    def shingles(part: DataFrame) -> DataFrame:
        return part.select("__key", F.explode(char_shingles(F.col("__text"))).alias("shingle"))

    whole, more = rows, None
    if not shared.isEmpty():
        same = F.col("__key").eqNullSafe(F.col("__same"))
        whole, more = rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")
    elif whole.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        whole = whole.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    out = T.StructType([T.StructField("__key", rows.schema["__key"].dataType), T.StructField("shingle", T.StringType()), T.StructField("cnt", T.LongType())])
    counts = shingles(whole).mapInArrow(_counted_runs, out)
    if more is not None:
        counts = counts.unionByName(shingles(more).groupBy("__key", "shingle").agg(F.count(F.lit(1)).alias("cnt")))
    return counts.withColumnRenamed("__key", id_col)


def duplicate_signatures(sigs: DataFrame, id_col: str = "doc_id", sig: str = "sig") -> DataFrame:
    """K8: rows whose signature is shared: ``(id, sig, copies, first_id)`` (first_id = smallest id)."""
    groups = sigs.groupBy(sig).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")).filter("copies > 1")
    return sigs.select(id_col, sig).join(groups, sig)


def from_signature(df: DataFrame, value: str, f: int, out: str = "sig") -> DataFrame:
    """Wrap precomputed integer signatures (masked to ``f`` bits, f <= 64)."""
    check_bits(f, 64)
    v = F.col(value).cast("long")
    if f < 64:
        v = v.bitwiseAND(F.lit((1 << f) - 1))
    return df.withColumn(out, v)


def embedding(sketch: DataFrame | None, f: int, key: str = "node") -> DataFrame:
    """``(key, bits ARRAY<INT>)``; error when no sketch was fitted."""
    if sketch is None:
        raise ValueError("there is no sketch to embed: fit first")
    return sketch.select(key, sig_bits_array(F.col("sig"), f).alias("bits"))
