"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphsig.llm import token_alignment as ta

DOCS = "doc_id long, text string, n_links string, pairs int"
BYTES = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
BYTES |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(BYTES.values()))}


@pytest.fixture(scope="module")
def coders():
    """The tokenizers as a user would call them, one text at a time, from the files the contract names."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))

    def bytes_a(i):
        return bytes(BYTES[c] for c in a.id_to_token(i))

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def code(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x, y = [(i, bytes_a(i)) for i in x], [(i, bytes_b(i)) for i in y]
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])

    return code


def brute(texts, code):
    """Rows as the contract has them, by a walk over both lists."""
    rows, linked = [], []
    for text in texts:
        x, y = code(text)
        groups, links, i, j, at_a, at_b, left, right = [], [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b:
                at_a += len(x[i][1])
                left.append(x[i][0])
                i += 1
            else:
                at_b += len(y[j][1])
                right.append(y[j][0])
                j += 1
            if at_a == at_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        rows.append((len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        linked.append(links)
    count = Counter(p for links in linked for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    scores = [(sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for links in linked]
    return [(*r[:4], *s, r[4]) for r, s in zip(rows, scores, strict=True)]


def texts():
    rng = random.Random(3)
    words = "the tokenizer éclair Straße naïve 12345 don't we'll ‘quoted’ emoji🙂 漢字仮名 Привет <|endoftext|> <s> </s> x_y/z a\tb <0x41> İstanbul nbsp here".split(" ")
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out += [None, "", " ", "   ", "\n\n \n", "  lead", "trail  ", "a  b   c", "has ▁ piece mark", "tab\t\tx\n\n  y", "​zero‍", "é ́x", "a\x00b\x1c c", "﹏ ＡＢＣ １２３", "𝒳𝒴 ൧൨"]
    out += ["x" * 300_000, " " * 20_000 + "end", "word " * 60_000, "é" * 5_000, out[0], out[0]]
    return out


@pytest.mark.parametrize(("work", "stretch"), [(ta.WORK, ta.STRETCH), (7, 50), (1000, 4096)])
def test_alignment_equals_a_plain_walk(spark, coders, work, stretch):
    some = texts()
    if work == 7:
        some = [t for t in some if len(t or "") < 2000]  # seven ends a piece: as many steps as the text has tokens
    table = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(some)], DOCS).repartition(3)
    aligned = ta.align(table, ta.default_files(), work, stretch).cache()
    scored = ta.score_links(aligned, ta.pair_counts(aligned), ta.vocabulary_size(ta.default_files().b))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    got = {r[0]: tuple(r[1:]) for r in scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest).collect()}
    assert [got[i] for i in range(len(some))] == brute(some, coders)
    assert got[some.index("has ▁ piece mark")] == (0, 0, 0, 0, 0, 0, "") and got[some.index(None)][-1] == ""


def test_without_ids_and_rows(spark):
    table = spark.createDataFrame([(None, "one two", "", 1)] * 2, DOCS)
    aligned = ta.align(table, ta.default_files())
    scored = ta.score_links(aligned, ta.pair_counts(aligned), 32000).collect()
    assert [(r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in scored] == [(None, 2, 2, 4)] * 2
    assert ta.score_links(ta.align(table.limit(0), ta.default_files()), ta.pair_counts(ta.align(table.limit(0), ta.default_files())), 32000).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_merge_path_divides_into_equal_pieces(x, y, work):
    a, b = np.array(sorted(x), dtype=np.int64), np.array(sorted(y), dtype=np.int64)
    i, j = ta.merge_path(a, b, work)
    assert (np.diff(i + j)[:-1] == work).all() and (i[-1], j[-1]) == (len(a), len(b))
    merged = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        assert sum(side == 0 for _, side in merged[: p + q]) == p
    la, lb = ta.align_ends(a, b, work)
    assert a[la].tolist() == b[lb].tolist() == sorted(x & y)


def test_linked_pairs_are_bounded_by_the_vocabularies(coders):
    f = ta.default_files()
    assert ta.pair_bound(ta.Coders(f.a, f.b)) < 400_000
