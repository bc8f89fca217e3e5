"""Language ID by error-correcting output codes over character n-grams.

Each language has a codeword of ``BITS`` or more bits. For each bit a binary classifier holds the
log-odds of hashed n-grams (one to three lower-cased letters with word borders) between the languages
with a one and those with a zero, from counts over every training text. A text's margin for a bit is
its n-grams' mean log-odds. Decoding adds up a logistic loss for each codeword, weighted by how well
the bit's classifier separates the training languages, and takes the least. A text is ambiguous if
the runner-up comes within ``AMBIGUOUS`` of it.

Counts are summed in Spark by language and n-gram; the driver holds only the weights, which are
bits times ``BUCKETS`` numbers.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows without lang teach
nothing; with no training row every text is ``und``; with one language all texts with letters get
it; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
BITS, SMOOTH, SHARPNESS, AMBIGUOUS = 15, 0.5, 12.0, 0.2
CHUNK = 1 << 20
UND = "und"


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the text's n-grams by bucket; all zero without a letter. Long texts go by chunks
    that overlap by two characters, so no n-gram is lost or counted twice."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    text = text or ""
    any_letter = False
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 2) : at + CHUNK].lower()
        new = part if at == 0 else part[2:]
        letter = _letters(part)
        any_letter = any_letter or bool(letter.any())
        codes = np.where(letter, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 32).astype(np.uint64)
        if at == 0:
            codes = np.r_[np.uint64(32), codes]
        skip = len(codes) - len(new) - (at == 0)
        one = codes
        two = one[:-1] * np.uint64(0x1F35) + one[1:]
        three = two[:-1] * np.uint64(0x1F35) + one[2:]
        for order, grams in enumerate((one[skip:], two[max(0, skip - 1) :], three[max(0, skip - 2) :])):
            last = one[len(one) - len(grams) :]
            real = grams[(last != 32) | (order > 0)]
            mixed = (real + np.uint64(order + 1)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return out if any_letter else np.zeros(BUCKETS, dtype=np.int64)


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


_TABLE: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < 0x10000
    if low.all():
        return _TABLE[0][codes]
    return np.fromiter((ch.isalpha() for ch in text), dtype=bool, count=len(text))


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """(n, bits) of 0 and 1: random columns from a fixed seed, with each column splitting the
    languages; among draws the one with the largest least distance."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int64)
    if n <= 5:  # every split of the languages once
        patterns = [[(p >> (i - 1)) & 1 if i else 1 for i in range(n)] for p in range((1 << (n - 1)) - 1)]
        return np.array(patterns, dtype=np.int64).T
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    rng, best, score = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, size=(n, bits))
        code[0, code.sum(axis=0) == 0] = 1
        code[0, code.sum(axis=0) == n] = 0
        least = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if least > score:
            best, score = code, least
    return best


@dataclass
class Model:
    """Languages in order, their codewords (languages, bits), classifiers (buckets, bits) and the
    weights of the bits."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / max(1, counts.sum())

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword."""
        signed = (2 * self.code - 1) * margins[None, :] * SHARPNESS
        return np.logaddexp(0, -signed) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text)
        if not self.langs or not counts.any():
            return UND, 0.0, True
        losses = self.losses(self.margins(counts))
        order = np.argsort(losses, kind="stable")
        odds = np.exp(-(losses - losses[order[0]]) * self.code.shape[1])
        close = len(order) > 1 and losses[order[1]] - losses[order[0]] < AMBIGUOUS * self.trust.sum() / self.code.shape[1]
        return self.langs[order[0]], float(1 / odds.sum()), bool(close)


def fit(totals: dict[str, np.ndarray]) -> Model:
    """Classifiers from n-gram counts by language."""
    langs = sorted(totals)
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((BUCKETS, 1)), np.ones(1))
    rates = np.stack([(totals[x] + SMOOTH) / (totals[x].sum() + SMOOTH * BUCKETS) for x in langs])
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        ones, zeros = code[:, b] == 1, code[:, b] == 0
        if ones.any() and zeros.any():
            weights[:, b] = np.log(rates[ones].mean(axis=0)) - np.log(rates[zeros].mean(axis=0))
    # a bit counts by the least margin that a training language has on its own side, on average text
    own = (2 * code - 1) * (rates @ weights)
    trust = np.clip(own.min(axis=0), 1e-3, None)
    return Model(langs, code, weights, trust / trust.sum())


def training_counts(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` of ``rows(text, lang)``: each task adds up its texts, Spark the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                totals[lang] += ngram_counts(text.as_py())
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bucket", "n"])

    taught = rows.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return taught.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame) -> Model:
    """The model of ``rows(text, lang)``: one small array of counts comes back for each language."""
    packed = training_counts(rows).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    totals = {}
    for r in packed.toLocalIterator():
        totals[r["lang"]] = np.zeros(BUCKETS, dtype=np.int64)
        for x in r["c"]:
            totals[r["lang"]][x["bucket"]] = x["n"]
    return fit(totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            lang, score, close = list(zip(*found, strict=True)) or ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
