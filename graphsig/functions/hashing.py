"""Column functions for MD5 feature hashes, bit vectors and signature packing.

A signature of ``f`` bits is kept MSB first in 64-bit words: word ``i`` holds bits
``64*i .. min(64*i+64, f)-1``; the last word may be narrower. ``f <= 64`` gives one BIGINT
(signed reinterpretation at 64), ``f > 64`` an ARRAY<BIGINT>.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

HashExpr = Callable[[Column, int], list[Column]]


def check_bits(f: int, max_bits: int = 128) -> None:
    """f must be a multiple of 8; MD5 yields 16 bytes, so at most 128 bits."""
    if f % 8:
        raise ValueError(f"signatures have whole bytes, not {f} bits")
    if not 8 <= f <= max_bits:
        raise ValueError(f"{f} bits asked for; 8 to {max_bits} are possible")


def word_widths(f: int) -> list[int]:
    return [min(64, f - 64 * i) for i in range((f + 63) // 64)]


def md5_words(value: Column, f: int) -> list[Column]:
    """Last ``f/8`` bytes of MD5(utf-8 value) as big-endian words (BIGINT)."""
    check_bits(f)
    digest = F.md5(value.cast("string"))
    start = 33 - f // 4
    words = []
    for i, width in enumerate(word_widths(f)):
        chunk = F.substring(digest, start + 16 * i, width // 4)
        words.append(F.conv(chunk, 16, -10).cast("long"))
    return words


def sha512_words(value: Column, f: int) -> list[Column]:
    """Last ``f/8`` bytes of SHA-512 for ``f`` up to 512 (MD5 runs out at 128)."""
    check_bits(f, 512)
    digest = F.sha2(value.cast("string"), 512)
    start = 129 - f // 4
    return [
        F.conv(F.substring(digest, start + 16 * i, width // 4), 16, -10).cast("long")
        for i, width in enumerate(word_widths(f))
    ]


def sha256_words(value: Column, f: int) -> list[Column]:
    """Last ``f/8`` bytes of SHA-256 (f up to 256)."""
    check_bits(f, 256)
    digest = F.sha2(value.cast("string"), 256)
    start = 65 - f // 4
    return [
        F.conv(F.substring(digest, start + 16 * i, width // 4), 16, -10).cast("long")
        for i, width in enumerate(word_widths(f))
    ]


#: The same last ``f/8`` bytes as one string of hex digits, for tasks that take the bits apart themselves.
HEX_DIGITS: dict[HashExpr, HashExpr] = {
    md5_words: lambda value, f: F.substring(F.md5(value.cast("string")), 33 - f // 4, f // 4),
    sha256_words: lambda value, f: F.substring(F.sha2(value.cast("string"), 256), 65 - f // 4, f // 4),
    sha512_words: lambda value, f: F.substring(F.sha2(value.cast("string"), 512), 129 - f // 4, f // 4),
}


def masked_int_words(int_hash: Callable[[Column], Column]) -> HashExpr:
    """Adapt a hash returning an unsigned integer (e.g. ``F.xxhash64``) masked to f <= 64 bits."""

    def words(value: Column, f: int) -> list[Column]:
        check_bits(f, 64)
        h = int_hash(value).cast("long")
        if f < 64:
            h = h.bitwiseAND(F.lit((1 << f) - 1))
        return [h]

    return words


def bit_at(words: Sequence[Column], k: int, f: int) -> Column:
    """Bit ``k`` (0 = most significant) of the f-bit vector held in ``words``, as INT 0/1."""
    widths = word_widths(f)
    i, pos = divmod(k, 64)
    shift = widths[i] - 1 - pos
    return F.shiftrightunsigned(words[i], shift).bitwiseAND(F.lit(1)).cast("int")


def word_spans(f: int) -> list[tuple[int, int]]:
    """(first bit, width) of each word."""
    return [(64 * i, w) for i, w in enumerate(word_widths(f))]


def pack_word_sql(sums: str, total: str, start: int, width: int) -> str:
    """SQL fold packing majority bits ``start .. start+width-1`` of an array of sums into one BIGINT.

    A higher-order fold keeps generated code small whatever ``f`` is (f unrolled CASEs overflow the
    64 KB method limit at f = 128).
    """
    return (
        f"aggregate(slice({sums}, {start + 1}, {width}), CAST(0 AS BIGINT), "
        f"(acc, s) -> shiftleft(acc, 1) | IF(2 * s > {total}, CAST(1 AS BIGINT), CAST(0 AS BIGINT)))"
    )


def bits_of_words_sql(words: str, f: int) -> str:
    """SQL ARRAY<BIGINT> of the f bits (MSB first) held in an array column of words.

    The words are bound by an outer ``transform`` first: an optimizer that inlines the column that
    computes them would otherwise put their hash inside the inner lambda, once for each bit.
    """
    last = word_widths(f)[-1]
    width = f"IF(k DIV 64 = {len(word_widths(f)) - 1}, {last}, 64)"
    bits = (
        f"transform(sequence(0, {f - 1}), k -> CAST(shiftrightunsigned(element_at(bound, CAST(k DIV 64 + 1 AS INT)), "
        f"CAST({width} - 1 - k % 64 AS INT)) & 1 AS BIGINT))"
    )
    return f"element_at(transform(array({words}), bound -> {bits}), 1)"


def words_to_sig(words: Sequence[Column], f: int) -> Column:
    return words[0] if f <= 64 else F.array(*words)


def sig_words(sig: Column, f: int) -> list[Column]:
    """Split a signature column back into its words."""
    if f <= 64:
        return [sig]
    return [sig.getItem(i) for i in range(len(word_widths(f)))]


def sig_bits_string(sig: Column, f: int) -> Column:
    """Zero-padded binary string, MSB first (the reference's padded ``format(v, 'b')``)."""
    parts = []
    for word, width in zip(sig_words(sig, f), word_widths(f)):
        b = F.bin(word)
        parts.append(F.lpad(b, width, "0") if width < 64 else F.lpad(b, 64, "0"))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def sig_bits_array(sig: Column, f: int) -> Column:
    """ARRAY<INT> of 0/1, MSB first: the embedding row of a node (one small lambda, any f)."""
    words = F.array(*sig_words(sig, f))
    widths = word_widths(f)

    def bit(k: Column) -> Column:
        wi = F.floor(k / 64).cast("int")
        width = F.when(wi == len(widths) - 1, F.lit(widths[-1])).otherwise(F.lit(64))
        shift = (width - 1 - (k % 64)).cast("int")
        word = F.element_at(words, wi + 1)
        return F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.lit(1)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(f - 1)), bit)
