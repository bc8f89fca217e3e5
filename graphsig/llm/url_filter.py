"""URL filters: rules for hosts and paths, else logistic regression on hashed character n-grams.

A URL's host and path give n-grams of three to five characters with borders, marked by where they
come from and hashed to ``FEATURES`` columns. ``pyspark.ml`` fits the regression on a small table of
labelled URLs (a DataFrame of url and label; the default one is spelled out from word lists). All of
it runs in the JVM; the URLs are one projection without a shuffle.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is allowed unless a
rule fits; among rules that fit the longest wins, of equal length block before allow; repeated rows
are judged each; an empty table gives an empty result; other columns pass through, but for those
named like the columns of :data:`ADDED`, which are overwritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsig.llm.common import lower_ascii

FEATURES, SIZES, STRENGTH, ROUNDS, THRESHOLD = 1 << 14, (3, 4, 5), 0.01, 100, 0.7
#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words of hosts and paths for the default labelled table.
UNWANTED = (
    "casino poker bets betting gambling slots jackpot lottery pills viagra cialis pharmacy meds steroids adult porn xxx sex "
    "nude escort cams dating hookup spam farm linkfarm clickbait scam phishing malware warez torrent crack keygen serials "
    "replica fake cheap free payday loans credit cash win prize giveaway weightloss miracle ads adserver tracker popunder"
).split()
WANTED = (
    "weather nation other there station theory north south health library museum school university institute research science "
    "journal history garden kitchen travel mountain river forest ocean energy water music theatre gallery painting review "
    "notes letters engine software python data compiler network systems physics chemistry biology medicine nature animals "
    "market street city council parliament ministry justice report archive gazette tribune herald times post chronicle "
    "recipes baking bicycle railway bridge harbour island village community foundation society academy lessons stories "
    "thing reading writing cooking fishing building learning nothing everything washing english british fresh fish marsh dish "
    "although earth truth within thanks thousand thirty mention action tradition"
).split()
ENDINGS, PATHS = ("com", "net", "org"), ("", "/", "/en/12", "/de/7.html", "/es/340", "/fr/51/", "/blog/about", "/news?page=2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct(verdict, rule)``, or null. Rules are a short list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def ngrams(text: Column, mark: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """All n-grams of the text between ``^`` and ``$``; the whole where it is shorter. The text is split into
    characters, and each width is the one before with the character behind it, so time is linear in the text."""
    bounded = F.concat(F.lit("^"), text, F.lit("$"))
    chars = F.split(bounded, "")
    after = lambda by: F.slice(chars, by + 1, F.greatest(F.size(chars), F.lit(1)))
    grams, out = chars, []
    for n in range(2, max(sizes) + 1):
        grams = F.zip_with(grams, after(n - 1), lambda a, b: F.concat(a, b))
        if n in sizes:
            full = F.filter(grams, lambda g: g.isNotNull())
            own = F.when(F.char_length(bounded) < n, F.array(bounded)).otherwise(full)
            out.append(F.transform(own, lambda g: F.concat(F.lit(mark), g)))
    return reduce(F.concat, out)


def features(urls: DataFrame) -> DataFrame:
    """Adds ``__host``, ``__path`` and the hashed n-gram vector ``__x`` to ``urls(url)``."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = urls.withColumn("__host", host).withColumn("__path", path)
    grams = F.array_distinct(F.concat(ngrams(F.col("__host"), "h"), ngrams(F.col("__path"), "p")))
    hashed = HashingTF(inputCol="__grams", outputCol="__x", numFeatures=FEATURES, binary=True)
    return hashed.transform(split.withColumn("__grams", grams)).drop("__grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default table ``(url, label)``, 1 for unwanted: each word on a host with a neighbour word,
    over the endings and paths in turn, so these tell nothing by themselves."""
    words = lambda xs: F.split(F.lit(" ".join(xs)), " ")

    def urls(own: list[str], label: float) -> DataFrame:
        at = spark.range(1).select(F.posexplode(words(own)).alias("i", "word"))
        ways = at.select("i", "word", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        turn = F.col("i") + 5 * F.col("k")
        pick = lambda xs, n: F.element_at(words(xs), F.pmod(n, F.lit(len(xs))) + 1)
        host = (
            F.when(F.col("k") == 0, F.col("word"))
            .when(F.col("k") == 1, F.concat(F.lit("www."), F.col("word")))
            .when(F.col("k") == 2, F.concat_ws("-", "word", pick(own, F.col("i") + 7)))
            .otherwise(F.concat(F.lit("m."), pick(own, F.col("i") + 3), F.lit("-"), F.col("word")))
        )
        paths = F.array(*map(F.lit, PATHS))
        path = F.element_at(paths, F.pmod(turn, F.lit(len(PATHS))) + 1)
        return ways.select(F.concat(F.lit("https://"), host, F.lit(".example."), pick(list(ENDINGS), turn), path).alias("url"), F.lit(label).alias("label"))

    return urls(UNWANTED, 1.0).unionAll(urls(WANTED, 0.0))


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """The regression on ``(url, label)``; a small table, in one partition for the same sums each time."""
    regression = LogisticRegression(featuresCol="__x", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y", regParam=STRENGTH, maxIter=ROUNDS)
    return regression.fit(features(labelled).select("__x", "label").coalesce(1))


#: Columns that :func:`judge` adds.
ADDED = ("host", "path", "rule", "verdict", "score")


def judge(urls: DataFrame, model: LogisticRegressionModel, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``host, path, rule, verdict, score`` to ``urls``; score is the chance to be unwanted."""
    rows = urls.select(F.struct(*(c for c in urls.columns if c.lower() not in ADDED)).alias("row"), F.col("url"))
    scored = model.transform(features(rows))
    found = longest_rule(F.col("__host"), F.col("__path"), rules)
    score = F.when(F.col("__host") == "", F.lit(0.0)).otherwise(vector_to_array("__p")[1])
    marked = scored.withColumn("__rule", found).withColumn("__score", score)
    own = F.when(F.col("__score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(
        "row.*",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"),
        F.col("__score").alias("score"),
    )


def url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark))).drop("url", "score")
