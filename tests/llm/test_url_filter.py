"""URL scores against a plain-Python reading of the n-grams, their hash and the regression."""

import math

import pytest
from pyspark.sql import functions as F

from graphsig.llm import url_filter


def murmur3(data: bytes, seed: int = 42) -> int:
    """The published 32-bit hash, as a signed number."""
    full = (1 << 32) - 1
    rotate = lambda x, r: (x << r | x >> 32 - r) & full
    h, tail = seed, len(data) % 4
    mix = lambda k: rotate(k * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
    for i in range(0, len(data) - tail, 4):
        h = (rotate(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & full
    if tail:
        h ^= mix(int.from_bytes(data[-tail:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def grams(text: str, mark: str) -> set[str]:
    bounded = f"^{text}$"
    out = set()
    for n in url_filter.SIZES:
        out |= {mark + bounded[i : i + n] for i in range(max(1, len(bounded) - n + 1))}
    return out


def read(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), tail[:stop]


def test_murmur3_of_known_values():
    assert murmur3(b"", 0) == 0 and murmur3(b"hello", 0) == 0x248BFA47


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_scores_equal_brute_force(spark, model):
    urls = [r["url"] for r in url_filter.labelled_urls(spark).orderBy("url").limit(60).collect()]
    urls += ["http://É.example/straße", "HTTP://ABC.Org", "x://a", "ftp://日本語.jp/路径?x", "http://😀.org/😀", "http:///only/path", "nothing", "", None]
    urls += urls[:3]  # repeated rows are judged each
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), model).collect()
    assert sorted(r["url"] or "" for r in got) == sorted(u or "" for u in urls)
    weights, intercept = model.coefficients.toArray(), model.intercept
    for r in got:
        host, path = read(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        at = {murmur3(g.encode()) % url_filter.FEATURES for g in grams(host, "h") | grams(path, "p")}
        want = 1 / (1 + math.exp(-intercept - sum(weights[i] for i in at))) if host else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["score"] >= url_filter.THRESHOLD else "allow")


def test_tie_with_the_threshold_blocks(spark, model):
    table = spark.createDataFrame([("http://weather.org/a",)], "url string")
    score = url_filter.judge(table, model, rules=()).first()["score"]
    assert url_filter.judge(table, model, rules=(), threshold=score).first()["verdict"] == "block"


def test_empty_table_and_long_url(spark, model):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, model).count() == 0
    long = spark.range(1).select(F.concat(F.lit("http://a.org/"), F.repeat(F.lit("abcdefghij"), 20_000)).alias("url"))
    assert len(url_filter.judge(long, model).first()["path"]) == 200_001
