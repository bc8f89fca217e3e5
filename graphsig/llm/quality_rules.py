"""Quality rules with adaptive fences from mergeable quantile sketches per language and source.

Each document gets a few integer measures, in hundredths. The values of documents that pass the base rules go
into log-linear histograms (values up to 31 exactly, above that the leading five binary digits, so a
relative error of at most 1/16). Such a histogram is a quantile sketch that merges by adding counts,
whatever the partitioning. Sketches are kept per (language, source), and merged for each language and for all documents.

Nothing is fixed beforehand about where good values end: a fence comes from the tail of the group's own sketch.

* Where the tail has a gap, the fence is its lower edge. Buckets with at least a thousandth of the group count;
  a gap lies between two neighbours of them beyond the third quartile, and is wide if the upper is ``GAP``
  times the lower (both ``GRAIN`` larger, so that small numbers make no gaps). Junk of up to a quarter of a
  group, far from the rest, is cut off wherever it lies.
* Elsewhere the fence goes as far beyond the 99th percentile as that lies beyond the 90th. The lower
  fence mirrors this with the first and the tenth.

The floor is one bucket: a fence lies at least a hundredth off. One symbol, one repeated line and one
repeated window are no sign of junk, so measures count what is beyond the first. Small groups lean on
their language and languages on all documents: a fence is the mean of the own one, weighted by the documents,
and the coarser one, weighted by ``PRIOR_DOCS``. There is no size at which a group starts to count.

Edge cases: null text counts as empty (no words, so it fails the base rules); null language or
source form groups of their own; repeated rows are judged alike; equal values are judged alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsig.llm.common import SPACE, SPACE_CHARS, doc_key, keep_rows, text_key, text_of
from graphsig.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """One measure: an integer SQL expression over the base counts, and the sides that are fenced."""

    name: str
    value: str
    upper: bool = True
    lower: bool = False


#: In hundredths of words, lines or words; mean word length in tenths of a code point.
RULES = (
    Rule("symbols", "greatest(n_symbols - 1, 0) * 100 div n_words"),
    Rule("word_length", "word_chars * 10 div n_words", lower=True),
    Rule("dup_lines", "greatest(n_dup_lines - 1, 0) * 100 div greatest(n_lines, 1)"),
    Rule("repeats", "greatest(n_repeat_words - 16, 0) * 100 div n_words"),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
GAP, GRAIN, PRIOR_DOCS = 4, 10, 100


def _after(array: Column, by: int) -> Column:
    """The array without its first ``by`` items."""
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def _repeat_words(windows: Column, width: int) -> Column:
    """Words covered by windows (hashes by start) that occur twice or more."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.zip_with(by_hash, _after(by_hash, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = F.zip_with(starts, _after(starts, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(covered, F.lit(0), lambda acc, x: acc + x)


def text_counts(docs: DataFrame) -> DataFrame:
    """``(__doc, __text, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words, base_failed)`` of every whole text, in one pass without a shuffle."""
    text = text_of()
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    base = docs.select(
        doc_key().alias("__doc"),
        text_key().alias("__text"),
        "doc_id",
        "lang",
        "source",
        F.transform(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"),
        F.char_length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        full.alias("lines"),
    )
    pair = lambda a, b: F.xxhash64(a, b)
    counts = ["__doc", "__text", "doc_id", "lang", "source", "word_chars", "n_symbols"]
    sized = base.select(
        *counts,
        "h",
        F.size("h").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # hashes of 2, 4 and 8 words from halves of the width before: three passes for any position
    h = F.col("h")
    sized = sized.withColumn("h", F.zip_with(h, _after(h, 1), pair))
    sized = sized.withColumn("h", F.zip_with(h, _after(h, 2), pair))
    sized = sized.withColumn("h", F.zip_with(h, _after(h, 4), pair))
    sized = sized.withColumn("h", F.slice(h, 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    counted = sized.withColumn("n_repeat_words", F.when(repeated, _repeat_words(h, WINDOW)).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.drop("h").withColumn("base_failed", failed)


def sketch(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(lang, source, rule, bucket, n)``: the histograms of documents that pass the base rules."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).alias("v")) for r in rules])
    long = counts.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("x")).select("lang", "source", "x.*")
    digits = F.greatest(F.char_length(F.bin("v")) - 5, F.lit(0))
    bucket = F.col("v") - F.pmod(F.col("v"), F.expr("shiftleft(1L, greatest(char_length(bin(v)) - 5, 0))"))
    return long.groupBy("lang", "source", "rule", F.when(digits > 0, bucket).otherwise(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(*keys, rule, docs, lo, hi)`` from each group's sketch alone."""
    group = Window.partitionBy(*keys, "rule")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    heavy = ranked.filter("n * 1000 >= total")
    after = F.lead("bucket").over(group.orderBy("bucket"))
    gaps = heavy.withColumn("after", after).filter("upto * 4 >= total * 3").withColumn("ratio", F.expr(f"(after + {GRAIN}) * 1000 div (bucket + {GRAIN})"))
    edge = gaps.groupBy(*keys, "rule").agg(F.max(F.when(F.col("ratio") >= 1000 * GAP, F.struct("ratio", (-F.col("bucket")).alias("edge")))).alias("gap"))
    quantile = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    tails = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("docs"), *(quantile(p).alias(f"q{p}") for p in (1, 10, 90, 99)))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "rule")]
    both = tails.alias("t").join(edge.alias("e"), reduce(lambda x, y: x & y, same), "left")
    hi = F.coalesce(-F.col("gap.edge"), 2 * F.col("q99") - F.col("q90")) + 1
    lo = F.greatest(2 * F.col("q1") - F.col("q10") - 1, F.lit(0))
    return both.select(*(F.col(f"t.{k}") for k in (*keys, "rule")), "docs", lo.alias("lo"), hi.alias("hi"))


def group_fences(sketches: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """``(f_lang, f_source, lo, hi)``: each group's fences by rule, drawn towards its language's, which are
    drawn towards everyone's. A handful of rows for each group."""
    own = fences(sketches, ("lang", "source")).alias("o")
    by_lang = fences(merge(sketches, "lang"), ("lang",)).alias("l")
    overall = fences(merge(sketches), ()).alias("a")

    def drawn(own: str, side: str, towards: str) -> Column:
        return F.expr(f"({own}.docs * {own}.{side} + {prior_docs} * {towards}) div ({own}.docs + {prior_docs})")

    joined = own.join(by_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rule") == F.col("l.rule")))
    joined = joined.join(overall, F.col("o.rule") == F.col("a.rule"))
    joined = joined.withColumn("up_lo", drawn("l", "lo", "a.lo")).withColumn("up_hi", drawn("l", "hi", "a.hi"))
    sides = [drawn("o", side, f"up_{side}").alias(side) for side in ("lo", "hi")]
    rows = joined.select(F.col("o.lang").alias("f_lang"), F.col("o.source").alias("f_source"), F.col("o.rule").alias("rule"), *sides)
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("rule", c))).alias(c)
    return rows.groupBy("f_lang", "f_source").agg(entries("lo"), entries("hi"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """Every row's counts with ``base_failed``, ``broken`` (names of rules outside the fences) and ``kept``.

    The counts (a few numbers for each row) are checkpointed once; sketches, fences and the join all
    read them. A group without fences holds only documents that failed the base rules.
    """
    counts = cut_lineage(text_counts(docs))
    bounds = cut_lineage(group_fences(sketch(counts, rules), prior_docs))
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    joined = counts.join(bounds, same, "left")
    # a document without words has base_failed and no measures
    outside = [
        F.when((F.expr(r.value) > F.element_at("hi", F.lit(r.name))) | (F.expr(r.value) < F.element_at("lo", F.lit(r.name))), F.lit(r.name))
        if r.upper and r.lower
        else F.when(F.expr(r.value) > F.element_at("hi", F.lit(r.name)), F.lit(r.name))
        if r.upper
        else F.when(F.expr(r.value) < F.element_at("lo", F.lit(r.name)), F.lit(r.name))
        for r in rules
    ]
    broken = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*outside)))
    return joined.withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("lo", "hi", "f_lang", "f_source")


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that every rule keeps, with all their columns."""
    return keep_rows(docs, judge(docs, **options).filter("kept").select("__doc", "__text").distinct())


def quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (
  SELECT doc_id, lang, source, unnest(['symbols', 'word_length', 'dup_lines', 'repeats']) AS rule,
         unnest([greatest(n_symbols - 1, 0) * 100 // n_words, word_chars * 10 // n_words,
                 greatest(n_dup_lines - 1, 0) * 100 // greatest(n_lines, 1), greatest(n_repeat_words - 16, 0) * 100 // n_words]) AS v
  FROM b WHERE NOT base_failed),
h AS (
  SELECT lang, source, rule, v - v % (1::BIGINT << greatest(length(bin(v)) - 5, 0)) AS bucket, count(*) AS n
  FROM m GROUP BY ALL),
lev AS (
  SELECT 2 AS level, lang, source, rule, bucket, n FROM h
  UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM h GROUP BY lang, rule, bucket
  UNION ALL SELECT 0, NULL, NULL, rule, bucket, sum(n) FROM h GROUP BY rule, bucket),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM lev),
g AS (
  SELECT level, lang, source, rule, bucket, upto, total,
         (lead(bucket) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) + 10) * 1000 // (bucket + 10) AS ratio
  FROM r WHERE n * 1000 >= total),
e AS (
  SELECT DISTINCT level, lang, source, rule,
         first_value(bucket) OVER (PARTITION BY level, lang, source, rule ORDER BY ratio DESC, bucket) AS edge
  FROM g WHERE upto * 4 >= total * 3 AND ratio >= 4000),
q AS (
  SELECT level, lang, source, rule, max(total)::BIGINT AS docs,
         min(bucket) FILTER (upto * 100 >= total) AS q1, min(bucket) FILTER (upto * 100 >= total * 10) AS q10,
         min(bucket) FILTER (upto * 100 >= total * 90) AS q90, min(bucket) FILTER (upto * 100 >= total * 99) AS q99
  FROM r GROUP BY level, lang, source, rule),
f AS (
  SELECT q.level, q.lang, q.source, q.rule, docs, coalesce(edge, 2 * q99 - q90) + 1 AS hi, greatest(2 * q1 - q10 - 1, 0) AS lo
  FROM q LEFT JOIN e ON e.level = q.level AND e.rule = q.rule AND e.lang IS NOT DISTINCT FROM q.lang AND e.source IS NOT DISTINCT FROM q.source),
u AS (
  SELECT f1.lang, f1.rule, (f1.docs * f1.hi + 100 * f0.hi) // (f1.docs + 100) AS hi, (f1.docs * f1.lo + 100 * f0.lo) // (f1.docs + 100) AS lo
  FROM f f1 JOIN f f0 ON f1.level = 1 AND f0.level = 0 AND f0.rule = f1.rule),
w AS (
  SELECT f.lang, f.source, f.rule, (docs * f.hi + 100 * u.hi) // (docs + 100) AS hi, (docs * f.lo + 100 * u.lo) // (docs + 100) AS lo
  FROM f JOIN u ON f.level = 2 AND u.rule = f.rule AND u.lang IS NOT DISTINCT FROM f.lang),
bad AS (
  SELECT DISTINCT m.doc_id FROM m
  JOIN w ON w.lang IS NOT DISTINCT FROM m.lang AND w.source IS NOT DISTINCT FROM m.source AND w.rule = m.rule
  WHERE m.v > w.hi OR m.rule = 'word_length' AND m.v < w.lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""
