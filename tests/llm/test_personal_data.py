"""Personal data: base spans against the plain patterns, added spans against disguises planted at known places."""

import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphsig.llm import personal_data as pd

DOCS = "doc_id long, text string, spans string, kind int"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """Base spans with the patterns as the contract spells them."""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, good) in enumerate(tests) for m in re.finditer(p, text or "") if good(m)]
    return sorted(found)


def base(text):
    return [(s, k, e) for s, k, e, b in pd.spans_of(text) if b]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@@..-_%+0123 14()ü", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "+1 (988) 555-2485", "10.2.255.3", "256.1.1.1", "a.b@c-d.e", "@", ".", "1", " ", "x", "é", "+", "@x.y", "4111111111111111"]), max_size=14))
def test_base_spans_of_joined_identifiers(parts):
    assert base("".join(parts)) == brute("".join(parts))


DISGUISED = [
    ("email", "joe.smith [at] host3 [dot] example [dot] com"),
    ("email", "joe at host dot example dot org"),
    ("email", "joe(at)host(punkt)de"),
    ("email", "josé".replace("é", "e") + " {arroba} correo {punto} es"),
    ("email", "anna dot lee at mail dot net"),
    ("email", "joe@exаmple.com"),
    ("email", "ｊｏｅ＠ｈｏｓｔ．ｏｒｇ"),
    ("email", "joe@host[.]example[.]com"),
    ("email", "jo​e@ho­st.org"),
    ("ip", "10[.]20[.]30[.]40"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "１９２.１６８.０.１"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "4111–1111–1111–1111"),
    ("card", "quatre un un un 1111 un un un un 1111"),
    ("phone", "plus one five five five zero one two three four five six"),
    ("phone", "+49 null eins sieben 555 1234"),
    ("phone", "+1 (988) 555‑2485"),
    ("phone", "plus double four triple seven 123 four five six"),
]


@pytest.mark.parametrize(("kind", "hidden"), DISGUISED)
def test_disguises_are_found_where_they_stand(kind, hidden):
    for left, right in (("", ""), ("Écrivez à: ", ", merci."), ("xyz; ", " \n next"), ("𝒳 ‑ ", "!")):
        text = left + hidden + right
        found = [(pd.KINDS[k], text[s:e], b) for s, k, e, b in pd.spans_of(text)]
        assert (kind, hidden, False) in found, (text, found)


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com for more", "meet at noon", "point taken at work. Dot.", "un deux trois", "one, two, three", "we at home (at) all", "1 or 2 [at] 3",
        "№ １２３", "joe @ host.org", "version 1.2.3", "null null sieben", "see (www.example.com) at once", "der Punkt ist da", "x at y", "zero dot five percent", "", " ",
    ],
)
def test_ordinary_texts_get_no_spans(text):
    assert pd.spans_of(text) == []


def test_added_spans_keep_base_ones():
    text = "x.42@mail.example.com point taken, joe@host.example[.]com"
    assert [(text[s:e], b) for s, _, e, b in pd.spans_of(text)] == [("x.42@mail.example.com", True), ("joe@host.example", True), ("joe@host.example[.]com", False)]
    assert pd.redacted(text) == "[email] point taken, [email]"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc", max_size=30), st.data())
def test_tapes_lead_back_to_the_source(source, data):
    """Every character of the rewritten text comes from where it was, or from the place it replaces."""
    cuts = sorted(data.draw(st.sets(st.integers(0, len(source)), max_size=8)))
    places = [(a, b, data.draw(st.sampled_from(["", "X", "YZ"]))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
    tape = pd.Tape(source, places)
    want, done = [], 0
    for a, b, new in places:
        want += [(c, i, i + 1) for i, c in enumerate(source[done:a], done)] + [(c, a, b) for c in new]
        done = b
    want += [(c, i, i + 1) for i, c in enumerate(source[done:], done)]
    assert tape.text == "".join(c for c, _, _ in want)
    for i in range(len(want)):
        for j in range(i + 1, len(want) + 1):
            assert tape.back(i, j) == (want[i][1], want[j - 1][2])


def test_look_alikes_are_one_ascii_character_or_none():
    assert all(len(c) == 1 and not c.isascii() and (new == "" or new.isascii() and len(new) == 1) for c, new in pd.LETTERS.items())
    assert not {c for c in "äöüßéèêçñíóúÄÖÜÉ"} & set(pd.LETTERS)
    assert all(pd.LETTERS[c] == str(unicodedata.decimal(c)) for c in "٣३３𝟗")


def test_query_columns(spark):
    rng = random.Random(6)
    parts = [h for _, h in DISGUISED] + ["a@b.cd", "10.0.0.1", "+1 (988) 555-2485", "4111 1111 1111 1111", "word", "\n", "é", "ten words more"]
    texts = [" ; ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "x" * 300_000, "1" * 300_000, "at " * 100_000, "a@" * 100_000, "one " * 50_000, texts[0], texts[0]]
    table = spark.createDataFrame([(i, t, "mine", 3) for i, t in enumerate(texts)] + [(None, "a@b.cd", "", 1)], DOCS).repartition(3)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pd.find(table).collect()}
    assert [found[i] for i in range(len(texts))] == [pd.spans_of(t or "") for t in texts] and found[None] == [(0, 0, 6, True)]
    row = pd.find(table).filter("doc_id = 0").select(F.sha2(pd.spell(F.filter("spans", lambda x: x["base"])), 256).alias("h"), pd.spell(F.col("spans")).alias("s")).first()
    assert row["h"] == hashlib.sha256(",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e in brute(texts[0])).encode()).hexdigest()
    assert row["s"] == ",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, k, e, _ in pd.spans_of(texts[0]))
    clean = {r["doc_id"]: (r["text"], r["spans"], r["kind"]) for r in pd.redact(table).collect()}
    assert clean[None] == ("[email]", "", 1) and clean[60] == (None, "mine", 3) and clean[0][0] == pd.redacted(texts[0])
    assert pd.find(table.limit(0)).count() == pd.redact(table.limit(0)).count() == 0


def test_given_documents_get_base_spans_alone(spark):
    """None of the given documents is disguised, so nothing is added there."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for r in rows:
        assert [(s, k, e) for s, k, e, _ in pd.spans_of(r["text"] or "")] == brute(r["text"])
