"""A small, independent plain-Python statement of the SimHash semantics the tests check against.

Fixed values shared with the engine: MD5 digests, the last f/8 bytes, MSB-first bits, majority with
ties giving 0, 4-character shingles of lower-cased word characters (pattern below).
"""

import hashlib

def simhash(features, f):
    """features: iterable of (token, weight)."""
    sums = [0] * f
    total = 0
    for tok, w in features:
        digest = hashlib.md5(tok.encode("utf-8")).digest()[-f // 8 :]
        value = int.from_bytes(digest, "big")
        total += w
        for k in range(f):
            if (value >> (f - 1 - k)) & 1:
                sums[k] += w
    out = 0
    for k in range(f):
        out = (out << 1) | (1 if 2 * sums[k] > total else 0)
    return out


def signed(value, f):
    if f == 64 and value >= 1 << 63:
        return value - (1 << 64)
    return value


def closed_neighbourhoods(pairs):
    nb = {}
    for a, b in pairs:
        a, b = str(a), str(b)
        if a == b:
            continue
        nb.setdefault(a, {a}).add(b)
        nb.setdefault(b, {b}).add(a)
    return nb


def node_sketch(pairs, f):
    return {n: signed(simhash([(x, 1) for x in s], f), f) for n, s in closed_neighbourhoods(pairs).items()}


def _is_word_char(ch):
    """Letters, digits and underscore; CJK characters are letters."""
    return ch == "_" or ch.isalnum()


def shingles(text, width=4):
    """Shift the cleaned characters against themselves; a short text is one shingle."""
    chars = [ch for ch in text.lower() if _is_word_char(ch)]
    if len(chars) <= width:
        return ["".join(chars)]
    return ["".join(window) for window in zip(*(chars[i:] for i in range(width)))]


def text_simhash(text, f=64):
    counts = {}
    for s in shingles(text):
        counts[s] = counts.get(s, 0) + 1
    return signed(simhash(counts.items(), f), f)
