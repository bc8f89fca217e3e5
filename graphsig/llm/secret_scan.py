"""Secret scans: base patterns, and strings that look drawn at random.

Two first-order Markov models over the characters of ``ALPHABET`` are trained from labelled samples,
one on random strings, one on ordinary identifiers. A run of ``CANDIDATE`` characters is a secret if
the sum of log-likelihood ratios over its transitions reaches ``LEAST`` and their mean ``LEAST_MEAN``.
Spans of the model are added where no base span lies; base spans always stay.

Spark has no function for all positions of a pattern. The pieces between matches (``split``) and the
matches (``regexp_extract_all``) come in the same order, so running sums of their lengths give the
positions.

Edge cases: a null text is empty and has no span; repeated rows are scanned each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsig.llm.common import text_of

KINDS = ("assign", "access", "hex", "model")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Longest runs, so asking for the least length in the pattern drops the same matches as after it.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST, LEAST_MEAN, SAMPLES = 15.0, 0.6, 4000
#: Parts of ordinary identifiers for the default labelled samples, in several languages.
PARTS = (
    "user name account number index count total value price order item customer address street city country region date time "
    "start stop begin end first last next previous current default option setting config server client request response message "
    "error warning status result query table column row field record document page line word text string letter character length "
    "size width height color image picture video audio player button window panel widget layout screen display render update "
    "insert delete create remove select filter group sort search find replace match pattern format parse build compile execute "
    "nombre cliente pedido precio fecha direccion mensaje nom adresse commande produit livraison zahlung kunde bestellung "
    "rechnung artikel internationalization responsibility understanding government information development environment "
    "entwicklung gesellschaft verantwortung communication organisation administration desarrollo informacion necesariamente"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """The default samples ``(text, secret)``: digests in hex, base 64 and capitals against parts
    joined in the usual styles. All of them follow from row numbers."""
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256))
    coded = F.translate(F.base64(F.unhex("h")), "=", "")
    random = F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring("h", 5, 24))).otherwise(coded)
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int") + 1)
    few = [part(k) for k in range(4)]
    plain = (
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", *few))
        .when(F.col("id") % 6 == 1, F.concat(few[0], *[F.initcap(x) for x in few[1:]]))
        .when(F.col("id") % 6 == 2, F.upper(F.concat_ws("_", *few[:3])))
        .when(F.col("id") % 6 == 3, F.concat(F.lit("/"), F.concat_ws("/", *few[:3]), F.lit("/v"), F.col("id") % 9))
        .when(F.col("id") % 6 == 4, F.concat_ws("-", F.concat(F.lit("20"), F.lpad((F.col("id") % 30).cast("string"), 2, "0")), *few[:3]))
        .otherwise(F.concat(*few))
    )
    return rows.select(random.alias("text"), F.lit(True).alias("secret")).unionAll(rows.select(plain.alias("text"), F.lit(False).alias("secret")))


def transitions(samples: DataFrame) -> DataFrame:
    """``(secret, a, b, n)``: how often character b follows a."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.struct(F.substring("text", i, F.lit(1)).alias("a"), F.substring("text", i + 1, F.lit(1)).alias("b")))
    return samples.filter(F.char_length("text") > 1).select("secret", F.explode(pairs).alias("p")).groupBy("secret", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios by (a, b) in the order of ``ALPHABET``; at most two counts for each pair
    of characters come to the driver."""
    size = len(ALPHABET)
    counts = {True: [[smooth] * size for _ in ALPHABET], False: [[smooth] * size for _ in ALPHABET]}
    for r in transitions(samples).filter(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect():
        counts[r["secret"]][ALPHABET.index(r["a"])][ALPHABET.index(r["b"])] += r["n"]
    random, plain = counts[True], counts[False]
    return [math.log(x / sum(p)) - math.log(y / sum(q)) for p, q in zip(random, plain, strict=True) for x, y in zip(p, q, strict=True)]


def running_starts(gaps: Column, matches: Column) -> Column:
    """Start of each match: the lengths of all gaps up to it and of all matches before it, in one
    fold over both arrays. Starts are collected as text, which appends at the speed of memory."""
    start = lambda acc, x: acc["at"] + F.char_length(x["g"])
    pairs = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    folded = F.aggregate(
        F.filter(pairs, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct((start(acc, x) + F.char_length(x["m"])).alias("at"), F.concat(acc["out"], F.lit(","), start(acc, x).cast("string")).alias("out")),
        lambda acc: acc["out"],
    )
    found = F.filter(F.split(folded, ","), lambda x: x != "")
    return F.transform(found, lambda x: x.cast("int"))


def spans(text: Column, pattern: str, kind: int, length_of: int = 0, least: int = 1) -> Column:
    """``array<struct(start, kind, end)>`` of matches whose group ``length_of`` has ``least`` characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = matches if not length_of else F.regexp_extract_all(text, F.lit(pattern), F.lit(length_of))
    rows = F.arrays_zip(running_starts(F.split(text, pattern, -1), matches).alias("s"), matches.alias("m"), group.alias("k"))
    kept = F.filter(rows, lambda x: F.char_length(x["k"]) >= least)
    return F.transform(kept, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.char_length(x["m"])).alias("end")))


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum over the token's transitions."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    folded = F.aggregate(
        at,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when((acc["last"] > 0) & (x > 0), acc["sum"] + F.element_at(table, (acc["last"] - 1) * size + x)).otherwise(acc["sum"]).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return folded


_TYPE = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds ``__base`` and ``__spans`` to ``docs``: base spans and all spans, by start and kind."""
    none = F.array().cast(_TYPE)
    t = F.col("__t")
    marked = docs.withColumn("__t", text_of()).withColumns({
        "__assign": F.when(t.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"), spans(t, ASSIGN, 0, 2, 6)).otherwise(none),
        "__access": F.when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS, 1)).otherwise(none),
        "__hex": F.when(t.rlike(HEX), spans(t, HEX, 2)).otherwise(none),
        "__tokens": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)),
    })
    marked = marked.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    random = F.transform("__tokens", lambda x: log_ratio(x, ratios))
    random = F.zip_with(random, F.col("__tokens"), lambda s, x: (s >= LEAST) & (s / (F.char_length(x) - 1) >= LEAST_MEAN))
    marked = marked.withColumn("__random", random)
    # positions only where the model found something
    found = F.zip_with(spans(t, CANDIDATE, 3), F.col("__random"), lambda x, r: F.when(r, x))
    apart = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.when(F.exists("__random", lambda r: r), F.filter(found, lambda x: x.isNotNull() & apart(x))).otherwise(none)
    marked = marked.withColumn("__spans", F.array_sort(F.concat("__base", added)))
    return marked.drop("__t", "__access", "__tokens", "__random", "__assign", "__hex")


def spell(found: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(spark)))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spell(F.col("__base")), 256).alias("base_sha256"),
        spell(F.col("__spans")).alias("spans"),
    )
