"""HTML extraction: all given pages against an independent reading, by the tree with and without its priors."""

import html
import re
import tracemalloc

import pytest

from graphsig.llm import site_style

PAGES = "page_id long, url string, html string"


def article(page):
    """The given pages' article by a plain pattern: the texts of its h1 and p elements."""
    inside = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", page or "", re.S)
    texts = re.findall(r"<(?:h1|p)\b[^>]*>(.*?)(?=<h1|<p[ >]|</h1>|</p>|</article>|\Z)", inside[1] if inside else "", re.S)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", t)).split()) for t in texts]
    return "\n\n".join(filter(None, texts))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")


def test_all_given_pages(given):
    want = {r["page_id"]: article(r["html"]) for r in given.collect()}
    assert {r["page_id"]: r["text"] for r in site_style.extract(given).collect()} == want


def test_tree_alone_recovers_the_given_pages(given):
    """Without tag and name priors the measured importance alone finds at least nine of ten articles."""
    want = {r["page_id"]: article(r["html"]) for r in given.collect()}
    got = {r["page_id"]: r["text"] for r in site_style.extract(given, priors=False).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_pages_inside_a_form():
    for around in ("<form id=aspnetForm>", "<form><fieldset>", "<form class='search'><div class='page'>"):
        page = f"<body>{around}<nav>Menu</nav><article><h1>One</h1><p>Two</p></article><form><p>Your mail</p></form></body>"
        assert site_style.main_text(page, {}) == "One\n\nTwo", around
    assert site_style.main_text("<body><div><h1>One</h1><p>Two</p></div><form><p>Send us mail</p></form></body>", {}) == "One\n\nTwo"


@pytest.mark.parametrize("tag", ["<div>", "<div class='comment'>", "<section id=a1>", "<form>"])
def test_deep_nesting_is_linear_in_memory(tag):
    page = tag * 100_000 + "x" + "</div>" * 10
    tracemalloc.start()
    found = site_style.blocks(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.text for b in found] == ["x"] and peak < 100e6


def test_very_long_and_odd_pages(spark):
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    rows = [(1, "x://h/1", long), (2, None, None), (3, "no url", ""), (3, "no url", ""), (None, "x://h/2", "<p>" + "y" * 500_000)]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "'mine' as own_host", "'mine' as listed", "7 as salt", "'old' as text", "'mine' as l_host")
    got = site_style.extract(table)
    assert got.columns == ["page_id", "url", "own_host", "listed", "salt", "l_host", "text"]
    texts = {(r["page_id"], r["own_host"], r["salt"]): len(r["text"]) for r in got.collect()}
    assert texts == {(1, "mine", 7): 1_499_999, (2, "mine", 7): 0, (3, "mine", 7): 0, (None, "mine", 7): 500_000} and got.count() == 5
    assert site_style.extract(table.limit(0)).count() == 0


def test_constant_heads_and_layouts_are_seen(spark):
    """Without any telling tag or name: a notice with a constant beginning goes, changing paragraphs stay."""
    page = "<body><div class='k1'>(c) our place · Words of day {i} here</div><div class='k2'><p>Story {i} one.</p>{more}</div></body>"
    rows = [(i, f"http://h.org/{i}", page.replace("{i}", str(i)).replace("{more}", f"<p>And so on {i}.</p>" * (1 + i % 4))) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("our place" not in t and t.startswith(f"Story {i} one.") for i, t in got.items())


def test_every_segment_of_a_block_counts(spark, monkeypatch):
    """A block whose first and last words change but whose middle is constant is mostly constant, on no page its article."""
    assert len(site_style.features("One. Two. Three · Four. One.")) == 4
    page = "<body><div class='k1'>Day {i} · Our place · Open at nine · Call us · Follow us · Seen {i} times</div><div class='k2'><p>Story {i} one. Then {i}. Last {i}.</p>{more}</div></body>"
    rows = [(i, f"http://h.org/{i}", page.replace("{i}", str(i)).replace("{more}", f"<p>And so on {i}.</p>" * (1 + i % 4))) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all("Our place" not in t and t.startswith(f"Story {i} one.") for i, t in got.items())
    monkeypatch.setattr(site_style, "LISTED", 0)  # joined by shuffle
    assert got == {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, PAGES)).collect()}
