"""Line dedup across documents: sorted line hashes, first occurrences, compressed keep bitmaps.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least
``min_chars`` code points that occurs in two or more documents stays only in the smallest doc_id
that holds it (all its lines there stay).

Lines become ``(128-bit key hash, doc, ref)`` rows, range-partitioned and sorted by all of them.
Because the document is part of the range key, a line that a third of all rows hold spreads over many
partitions. Each task streams its rows and knows the first document of each key, except for the key
that its first row continues from the partition before. Rows of that leading key are settled against
a table of the keys at partition ends, which has at most two rows for each partition. What comes out
per document is a zlib-compressed bitmap of lines to keep.

Edge cases: a null or empty text is one empty line; a null doc_id counts as the largest id, and all
rows without an id as one document; rows that share a doc_id are one document, so they never drop
each other's lines; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphsig.llm.common import SPACE_CHARS, doc_key, fresh, lower_ascii, text_key, text_of
from graphsig.session import cut_lineage

MIN_CHARS = 10
#: Kinds of rows that the sorted scan gives out.
DROP, OPEN, END = 0, 1, 2
SCAN_SCHEMA = "kind int, h1 long, h2 long, doc long, ref long"


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc, ref)`` of each line long enough; ref holds 31 bits of the text's hash over the
    line number, which tells apart rows that share a doc_id."""
    ref = F.shiftleft(text_key().bitwiseAND(F.lit(0x7FFFFFFF)), 32)
    lines = docs.select(doc_key().alias("doc"), ref.alias("r"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    keyed = lines.select("doc", F.col("r").bitwiseOR(F.col("pos").cast("long")).alias("ref"), line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.char_length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "ref")


def scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (h1, h2, doc, ref); keeps one key and document between batches.

    Rows of a later document than the key's first are drops. Rows of the partition's first key stay
    open, as its first document may lie before; the first and last keys are given out with the first
    document seen here.
    """
    lead = last = None  # (h1, h2, first document)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, ref = (batch.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
        upto = starts[1] if len(starts) > 1 else len(doc)
        if last is not None and (h1[0], h2[0]) == last[:2]:
            first[:upto] = last[2]
        if lead is None:
            lead = (h1[0], h2[0], first[0])
            yield _rows(END, h1[:1], h2[:1], first[:1], ref[:1])
        leading = (h1 == lead[0]) & (h2 == lead[1])
        late = ~leading & (doc != first)
        if leading.any():
            yield _rows(OPEN, h1[leading], h2[leading], doc[leading], ref[leading])
        if late.any():
            yield _rows(DROP, h1[late], h2[late], doc[late], ref[late])
        last = (h1[-1], h2[-1], first[-1])
    if last is not None and last[:2] != lead[:2]:
        one = lambda x: np.array([x], dtype=np.int64)
        yield _rows(END, one(last[0]), one(last[1]), one(last[2]), one(0))


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *map(pa.array, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "h1", "h2", "doc", "ref"])


def late_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc, ref)`` of all lines to drop."""
    order = ["h1", "h2", "doc", "ref"]
    # checkpointed first: a range partitioning reads its input twice, to sample it and to deal it out
    ranged = cut_lineage(line_rows(docs, min_chars)).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = cut_lineage(ranged.mapInArrow(scan_sorted, SCAN_SCHEMA))
    ends = seen.filter(F.col("kind") == END).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    settled = seen.filter(F.col("kind") == OPEN).join(F.broadcast(ends), ["h1", "h2"]).filter(F.col("doc") != F.col("first"))
    return seen.filter(F.col("kind") == DROP).select("doc", "ref").unionAll(settled.select("doc", "ref"))


def pack_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """Bits of the lines to keep, low bit first, compressed."""
    bits = np.ones(n_lines, dtype=np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept_lines(text: str, bitmap: bytes) -> str:
    """The text's lines whose bit is set, joined by line feeds."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    return "\n".join(line for line, bit in zip(text.split("\n"), bits.tolist(), strict=False) if bit)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, list[str]]:
    """``docs`` with the kept text in place of the text, and the names of three columns more: numbers of
    lines and of dropped lines, and a document's compressed bitmap (null: every line stays). Only hashes
    and line numbers are sorted; texts move once, by id, and go through one Python pass."""
    late = late_lines(docs, min_chars)
    doc, tag, gone, *added = fresh(docs, "g_doc", "g_tag", "gone", "n_lines", "n_dropped", "keep")
    listed = late.groupBy(F.col("doc").alias(doc), F.shiftright("ref", 32).alias(tag)).agg(
        F.collect_set(F.col("ref").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias(gone)
    )
    match = (doc_key() == F.col(doc)) & (text_key().bitwiseAND(F.lit(0x7FFFFFFF)) == F.col(tag))
    joined = docs.withColumn("text", text_of()).join(listed, match, "left").drop(doc, tag)
    names = docs.columns
    at_text, at_gone = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped, bitmaps = [], [], [], []
            for text, dropped in zip(batch.column(at_text), batch.column(at_gone), strict=True):
                text = text.as_py()
                n_lines.append(text.count("\n") + 1)
                bitmaps.append(pack_bitmap(n_lines[-1], dropped.values.to_numpy()) if dropped.is_valid else None)
                n_dropped.append(len(dropped) if dropped.is_valid else 0)
                texts.append(kept_lines(text, bitmaps[-1]) if dropped.is_valid else text)
            columns = list(batch.columns[:at_gone])
            columns[at_text] = pa.array(texts, pa.string())
            more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *added])

    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields])
    for name, kind in zip(added, (T.LongType(), T.LongType(), T.BinaryType()), strict=True):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema), added


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every document with its kept lines as text and its new length as ``n_chars``."""
    cut, _ = keep_bitmaps(docs, min_chars)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    marked, (n_lines, n_dropped, _) = keep_bitmaps(docs)
    return marked.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM k),
g AS (SELECT doc_id, i, line, length(key) >= 10 AND first <> doc_id AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
