"""HTML extraction with site style trees: what a host repeats is not the article.

Pages are cut into text blocks, each under the path of the elements around it (tag and class names,
without digits). The pages of a host merge into one tree of paths, in which all blocks take part.

* Content importance of a path: one less the mean entropy of its features over the pages that have it, log(pages
  with the feature) / log(pages with the path). A block's features are all its segments (cut at
  sentence ends and marks like a middle dot), so a constant notice among changing words counts by its share of them.
* Presentation importance of a branch: the same over the sequences of blocks that its pages have under it. A branch
  laid out alike on all pages has 0, an article with its changing paragraphs nearly 1.
* A path's composite importance is ``1 - BRANCH`` of its content's and ``BRANCH`` of its branch's. It is drawn
  towards that of the path on all hosts, as if ``PRIOR_PAGES`` pages more had been seen, so hosts with few
  pages are judged too. Copies of a page's article count once a host.

Tags and names are a weighted prior, added to the measured importance: ``INSIDE`` within an ``article`` or ``main``,
``BESIDE`` next to one, ``NAMED`` for menus, adverts, forms, notices, comments and
the like, which the contract of the main text leaves out. Names with ``has-``, ``with-`` or ``no-`` and names of wrappers
are no such sign, and a form around the article is none. Branches under ``KEEP`` are removed from each page; where nothing is
left of a page, its blocks without ``NAMED`` or ``BESIDE`` all stay.

The first pass gives out hashes only, drops a host's repeated articles by their hash and merges the rest by
counts, so a host with a third of all pages is many partial sums. What comes back to the pages is the list of their host's
paths under ``KEEP``: up to ``LISTED`` paths go to all tasks and no page is shuffled, more are joined by host and a salt, so the
pages of a host with a third of all rows spread over many tasks. Paths are hashed step by step, so memory is linear in the depth of nesting.

Edge cases: null or empty html gives an empty text; a null url is host ``''``; repeated rows are
extracted each; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsig.llm.common import fresh
from graphsig.session import cut_lineage

KEEP, BRANCH, PRIOR_PAGES, LEAST_PAGES, SALT = 0.78, 0.2, 4, 3, 64
INSIDE, BESIDE, NAMED = 0.75, -0.25, -0.5
#: Paths under KEEP, of all hosts together, that are sent to every task (some 16 bytes each); more are joined by shuffle.
LISTED = 1_000_000
#: Elements whose content is never text of the article. The first row holds raw text up to its end tag.
RAW = frozenset("script style textarea title noscript template svg math iframe xmp noembed noframes".split())
#: ASCII letters only, searched in the page itself: lower-casing it would move what follows some letters.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
NOISE = frozenset("head nav footer aside button select option menu dialog legend label datalist object video audio canvas".split())
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main "
    "header figure figcaption address hr center details summary form fieldset".split()
)
VOID = frozenset("hr".split())
MAIN = frozenset("article main".split())
#: Signs like names: whole pages stand in a form too.
FORMS = frozenset("form fieldset".split())
#: Elements around everything: their names tell of the page (``has-sidebar``), not of their content.
WHOLE = frozenset("html body main".split())
#: Class, id and role names that say what a branch is for; matched as whole names or their parts.
HINTS = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|popup|modal|overlay|cookies?|consent|gdpr|notice|notification|alert|"
    r"nav|navbar|navigation|menu|menubar|breadcrumbs?|pagination|pager|footer|sidebar|side|aside|masthead|toolbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|complementary|contentinfo)(?:$|[\s_-])"
)
#: Quotes count after an equals sign only, so an apostrophe elsewhere in a tag does not open a value.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A start tag that ends an open element of the second set, unless one of the third set is between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
}


@dataclass(slots=True)
class Block:
    path: int
    text: str
    noise: bool
    main: bool
    branch: int = 0  # the path of the element around its own
    hint: int = 0  # the innermost element around it whose name is a hint


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    noise: bool
    main: bool
    branch: int = 0
    hint: int = 0


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order. Inline elements are part of their block; unclosed and
    truncated markup is closed as browsers do."""
    page = page or ""
    stack = [_Open("", 0, False, False)]
    found: list[Block] = []
    text: list[str] = []
    outer = [0]  # of each hint, the next one around it
    around: dict[str, list[int]] = {"article": [], "main": [], "h1": []}  # hints around them

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                top = stack[-1]
                found.append(Block(top.path, words, top.noise, top.main, top.branch, top.hint))

    def close(until: int) -> None:
        flush()
        del stack[until:]

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS or tag in NOISE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end is None:
                break
            close_at = page.find(">", end.end())
            at = len(page) if close_at < 0 else close_at + 1
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE:
            continue
        flush()
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        names = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])).lower()
        top = stack[-1]
        noise = top.noise or tag in NOISE or (tag == "header" and not top.main)
        hint = top.hint
        if tag in FORMS or names and tag not in WHOLE and HINTS.search(names):
            outer.append(hint)
            hint = len(outer) - 1
        if tag in around and not noise and (tag != "article" or hint == top.hint):
            around[tag].append(hint)
        shown = tag + "".join("." + x for x in sorted(set(re.sub(r"\d+", "", names).split())))
        path = _hash(f"{top.path}/{shown}")
        stack.append(_Open(tag, path, noise, top.main or tag in MAIN, top.path, hint))
    flush()
    if len(outer) > 1:
        void = _wrappers(found, around, outer)
        clear = [True]  # whether all hints from here outwards are void
        for i in range(1, len(outer)):
            clear.append(i in void and clear[outer[i]])
        for b in found:
            b.noise = b.noise or not clear[b.hint]
    return found


def _wrappers(found: list[Block], around: dict[str, list[int]], outer: list[int]) -> set[int]:
    """Elements whose names tell of the page: they hold its ``main`` (or else its only ``article`` without
    such names of its own), its ``h1`` or, where it has none, most of the text. Teasers and comments are often articles too, so one of several says nothing."""
    single = [around[tag][0] for tag in (("main", "h1") if around["main"] else ("article", "h1")) if len(around[tag]) == 1]
    if single:
        void = set()
        for i in single:
            while i and i not in void:
                void.add(i)
                i = outer[i]
        return void
    length = [0] * len(outer)
    for b in found:
        if not b.noise:
            length[b.hint] += len(b.text)
    whole = sum(length)
    for i in range(len(outer) - 1, 0, -1):  # an outer hint comes before those inside it
        length[outer[i]] += length[i]
    return {i for i in range(1, len(outer)) if 2 * length[i] > whole}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_SEGMENT = re.compile(r"\s*[·|•»«—–]\s*|(?<=[.!?])\s+")


def features(text: str) -> set[int]:
    """Hashes of all segments of the block."""
    return {_hash(x) or 1 for x in _SEGMENT.split(text) if x}


def branch_key(path: int) -> int:
    """The key of a path's presentation among the paths."""
    return _hash(f"{path}>")


def _page_rows(page: str | None) -> tuple[int, list[int], list[int], list[int]]:
    """What the page's article is, and ``(path, content, branch)`` of its features and layouts: content 0
    stands for the page itself."""
    found = blocks(page)
    own = [b for b in found if not b.noise]
    rows, layout = set(), {}
    for b in found:
        key = branch_key(b.branch)
        rows.add((b.path, 0, key))
        rows.update((b.path, f, key) for f in features(b.text))
        layout.setdefault(key, []).append(b.path)
    for key, paths in layout.items():
        rows |= {(key, 0, 0), (key, _hash(repr(paths)) or 1, 0)}
    rows = sorted(rows)
    return _hash(repr([(b.path, b.text) for b in own])), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def path_contents(pages: DataFrame) -> DataFrame:
    """``(host, path, content, branch)`` hashes, each once for each distinct article of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_key(url) for url in batch.column(0).to_pylist()]
            columns = list(zip(*(_page_rows(page.as_py()) for page in batch.column(1)), strict=True)) or [()] * 4
            many = pa.list_(pa.int64())
            arrays = [pa.array(hosts, pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, many) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "path", "content", "branch"])

    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    once = rows.mapInArrow(run, "host long, page long, path array<long>, content array<long>, branch array<long>").dropDuplicates(["host", "page"])
    return once.select("host", F.explode(F.arrays_zip("path", "content", "branch")).alias("x")).select("host", "x.*")


def importance(counts: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, path, pages, entropy)`` from ``(*keys, path, content, n)``: the mean over contents,
    each as often as it occurs, of log n / log pages."""
    real = F.col("content") != 0
    sums = counts.groupBy(*keys, "path").agg(
        F.max(F.when(~real, F.col("n"))).alias("pages"),
        F.sum(F.when(real, F.col("n"))).alias("uses"),
        F.sum(F.when(real, F.col("n") * F.log(F.col("n").cast("double")))).alias("spread"),
    )
    entropy = F.when(F.col("pages") > 1, F.col("spread") / F.col("uses") / F.log(F.col("pages").cast("double"))).otherwise(F.lit(0.0))
    return sums.select(*keys, "path", "pages", entropy.alias("entropy"))


def path_importance(pages: DataFrame, prior_pages: int = PRIOR_PAGES, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, path, importance)`` of every path with text, seen on at least ``least_pages`` pages of the host or,
    like that, on all hosts."""
    own = cut_lineage(path_contents(pages).groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n"), F.max("branch").alias("branch")))
    everywhere = importance(own.groupBy("path", "content").agg(F.sum("n").alias("n")))
    total = everywhere.select(F.col("path").alias("t_path"), F.col("pages").alias("t_pages"), F.col("entropy").alias("t_entropy"))
    both = importance(own, "host").join(total, F.col("path") == F.col("t_path"))
    prior = F.when(F.col("t_pages") >= least_pages, F.lit(prior_pages)).otherwise(F.lit(0))
    weight = F.col("pages") + prior
    mixed = 1 - (F.col("pages") * F.when(F.col("pages") > 1, F.col("entropy")).otherwise(F.col("t_entropy")) + prior * F.col("t_entropy")) / weight
    seen = F.greatest("pages", "t_pages") >= least_pages
    scored = cut_lineage(both.select("host", "path", F.when(seen, mixed).otherwise(F.lit(1.0)).alias("own")))
    inner = own.filter("content = 0 and branch <> 0").select("host", "path", "branch")
    around = scored.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("own").alias("laid"))
    joined = inner.join(scored, ["host", "path"]).join(around, (F.col("host") == F.col("b_host")) & (F.col("branch") == F.col("b_path")))
    # text that changes everywhere is no less important for a layout that does not
    whole = F.when(F.col("own") >= 1.0, F.lit(1.0)).otherwise((1 - BRANCH) * F.col("own") + BRANCH * F.col("laid"))
    return joined.select("host", "path", whole.alias("importance"))


def main_text(page: str | None, measured: dict[int, float], keep: float = KEEP, priors: bool = True) -> str:
    """The page's blocks in branches of enough importance, joined by empty lines. ``measured`` has the paths under
    ``keep``; without ``priors`` the tree alone decides."""
    found = blocks(page)
    beside = any(b.main and not b.noise for b in found)

    def prior(b: Block) -> float:
        return NAMED if b.noise else INSIDE if b.main else BESIDE if beside else 0.0

    kept = [b for b in found if measured.get(b.path, 1.0) + (prior(b) if priors else 0.0) >= keep]
    if not kept and priors:  # a page of repeated branches only
        kept = [b for b in found if not b.noise and (b.main or not beside)]
    return "\n\n".join(b.text for b in kept)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split("[/?#]", rest, maxsplit=1)[0].lower()


def host_key(url: str | None) -> int:
    """The host's hash as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(host_of(url).encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def extract(pages: DataFrame, keep: float = KEEP, priors: bool = True, **options) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``; a column named text before is overwritten."""
    low = path_importance(pages, **options).filter(F.col("importance") < keep)
    entry = F.struct("path", F.col("importance").cast("double").alias("importance"))
    own, salt, listed, l_host, l_salt = fresh(pages, "own_host", "salt", "listed", "l_host", "l_salt")
    lists = cut_lineage(low.groupBy(F.col("host").alias(l_host)).agg(F.collect_list(entry).alias(listed)))
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    keyed = pages.drop("text").withColumn(own, F.xxhash64(host))
    same = F.col(own) == F.col(l_host)
    if (lists.agg(F.sum(F.size(listed))).first()[0] or 0) <= LISTED:  # the pages stay where they are
        joined = keyed.join(F.broadcast(lists), same, "left").drop(own, l_host)
    else:
        # a host's pages are dealt over SALT keys, its one list goes to each of them
        lists = lists.withColumn(l_salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = keyed.withColumn(salt, F.pmod(F.xxhash64("url", "html"), F.lit(SALT)).cast("int"))
        joined = salted.join(lists, same & (F.col(salt) == F.col(l_salt)), "left").drop(own, l_host, salt, l_salt)
    out = joined.drop("html", listed).schema.add("text", "string")
    at, paths = joined.columns.index("html"), joined.columns.index(listed)
    others = [i for i in range(len(joined.columns)) if i not in (at, paths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, row in zip(batch.column(at), batch.column(paths), strict=True):
                measured = {x["path"]: x["importance"] for x in row.as_py() or ()}
                texts.append(main_text(page.as_py(), measured, keep, priors))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(texts, pa.string())], names=out.names)

    return joined.mapInArrow(run, out)


def html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
