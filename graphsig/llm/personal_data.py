"""Personal data in texts, also where it is written so that plain patterns miss it.

Base spans are the matches of four patterns: email, ip, card (12 to 19 digits that pass Luhn) and phone
(9 to 15 digits), leftmost and non-overlapping for each kind; matches that fail their check are dropped.

The method adds spans by offset-preserving transducers. Each rewrites a text and remembers, as one step
for each rewritten place, which source characters it came from:

1. letters: look-alikes of other scripts, compatibility forms and digits of any script become ASCII;
   dashes and spaces become plain; characters of no width go;
2. at and dot: ``[at]``, ``(dot)``, ``name at host dot org`` and their French, German and Spanish forms
   become ``@`` and ``.``, where an address results. A bare ``at`` counts only if a dot of the domain is
   disguised too, so ``look at example.com`` stays as it is; a bare ``dot`` only where the domain has no plain one before it;
3. dots between digits, spelled or not, likewise;
4. digits: runs of spelled digits (four languages, ``double``, ``triple``, ``plus``) become digits.

The base patterns then run on the rewritten text. A match that touches a rewritten place is mapped back
through the transducers to source characters, last one first, and added unless a base span of its kind
holds it or overlaps it without lying in it. Texts without anything to rewrite are scanned once.

All scans are linear in the text: local parts of addresses are read backwards from the ``@``, and digit
runs start only where no digit stands before.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; a null doc_id stays null;
an empty table gives an empty result. :func:`find` reads doc_id and text alone; :func:`redact` passes
other columns through, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# -------------------------------------------------------------------------------------- base patterns

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its start fails from everywhere in it, so matches start at runs.
_IP = re.compile(r"([0-9](?<![0-9][0-9])[0-9]*)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        local = text[end:at]
        start = end + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        end = domain.end() if domain else at + 1
        at = text.find("@", end)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255" for p in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


PATTERNS: tuple[Callable[[str], Iterator[tuple[int, int]]], ...] = (emails, addresses, cards, phones)


# ------------------------------------------------------------------------------------------ transducers


class Tape:
    """A rewritten text and the way back to its source: one step for each rewritten place."""

    def __init__(self, source: str, places: Iterable[tuple[int, int, str]]):
        """``places``: ``(start, end, text instead)``, ascending and apart."""
        parts: list[str] = []
        self.at: list[int] = []  # where each rewritten place starts here
        self.after: list[int] = []  # and ends
        self.spans: list[tuple[int, int]] = []  # its source characters
        done = here = 0
        for start, end, new in places:
            parts += (source[done:start], new)
            here += start - done
            self.at.append(here)
            here += len(new)
            self.after.append(here)
            self.spans.append((start, end))
            done = end
        self.text = "".join([*parts, source[done:]]) if parts else source

    def touched(self, start: int, end: int) -> bool:
        """Whether the span holds a rewritten place, or what is left of one."""
        k = bisect_right(self.after, start)
        return k < len(self.at) and (self.at[k] < end)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of a span that is not empty."""
        return self._source(start)[0], self._source(end - 1)[1]

    def _source(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.at, place) - 1
        while k >= 0 and self.after[k] == self.at[k] and self.at[k] == place:
            k -= 1  # rewritten to nothing just before this character
        if k >= 0 and place < self.after[k]:
            return self.spans[k]
        k = bisect_right(self.at, place) - 1
        shift = self.spans[k][1] - self.after[k] if k >= 0 else 0
        return place + shift, place + shift + 1


# Letters of other scripts that look like ASCII ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "。": ".", "•": ".", "∙": ".",
}


def _letter_table() -> dict[str, str]:
    """ASCII character of each look-alike, compatibility form, foreign digit, dash and space; those of
    no width become nothing."""
    table = dict(LOOK_ALIKES)
    for low, high in ((0x2010, 0x2100), (0x2460, 0x2500), (0x2100, 0x2150), (0xFE50, 0xFE70), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
        for code in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                table[chr(code)] = plain
    for code in range(0x80, 0x20000):
        c = chr(code)
        if c.isdecimal():
            table[c] = str(unicodedata.decimal(c))
    dashes = [*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D]
    spaces = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
    no_width = [0xAD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
    return table | {chr(c): to for codes, to in ((dashes, "-"), (spaces, " "), (no_width, "")) for c in codes}


LETTERS = _letter_table()
_LETTER = re.compile("[" + "".join(re.escape(c) for c in LETTERS if c < "\U00010000") + "\U00010000-\U0001ffff]")

# Words for at, dot and digits in English, French, German and Spanish.
AT_WORDS = "at|arobase|arroba|klammeraffe|ät"
DOT_WORDS = "dot|point|punkt|punto"
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES = {"double": 2, "triple": 3}

_IN_BRACKETS = r"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{0})[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}"
_AT = re.compile(rf"(?P<marked>{_IN_BRACKETS.format(AT_WORDS + '|@')})|(?P<bare>[ \t]{{1,3}}(?:{AT_WORDS})[ \t]{{1,3}})|@", re.IGNORECASE)
_MARKED_DOT = _IN_BRACKETS.format(DOT_WORDS + r"|\.")
_BARE_DOT = rf"[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}"
_LABEL = "[A-Za-z0-9-]+"
#: A domain whose dots are bare words or in brackets and then plain, or in brackets and plain.
_DISGUISED = re.compile(
    rf"{_LABEL}(?:(?:(?:{_MARKED_DOT}|{_BARE_DOT}){_LABEL})+(?:\.{_LABEL})*|(?:(?:{_MARKED_DOT}|\.){_LABEL})+)", re.IGNORECASE
)
_DOT = re.compile(rf"{_MARKED_DOT}|{_BARE_DOT}", re.IGNORECASE)
_LOCAL_DOT = re.compile(rf"[A-Za-z0-9_%+-]({_MARKED_DOT}|[ \t]{{1,3}}dot[ \t]{{1,3}})[A-Za-z0-9_%+-]{{1,64}}\Z", re.IGNORECASE)


def may_be_disguised(text: str) -> bool:
    """Whether the text has a bracket or a word for dot, without which nothing there is rewritten."""
    lower = text.lower()
    return any(c in text for c in "[({<") or any(w in lower for w in DOT_WORDS.split("|"))


def disguised_addresses(text: str) -> list[tuple[int, int, str]]:
    """Places of at and dot forms that make up an address."""
    out: list[tuple[int, int, str]] = []
    if not may_be_disguised(text):
        return out
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        if start < end or not start or text[start - 1] not in _LOCAL:
            continue
        domain = _DISGUISED.match(text, m.end())
        if not domain:
            continue
        dots = [(d.start(), d.end(), ".") for d in _DOT.finditer(text, domain.start(), domain.end())]
        if not dots and not m["marked"]:
            continue
        before: list[tuple[int, int, str]] = []
        at, low = start, max(end, start - 200)
        while dot := _LOCAL_DOT.search(text[low:at]):
            before.append((low + dot.start(1), low + dot.end(1), "."))
            at = low + dot.start(1)
        sign = [] if m[0] == "@" else [(start, m.end(), "@")]
        out += [*reversed(before), *sign, *dots]
        end = domain.end()
    return out


_PIECE = re.compile(r"[^\W\d_]+|[0-9]+")
_LAST_PIECE = re.compile(r"(?:(?<![^\W\d_])[^\W\d_]{1,8}|[0-9])\Z")


def disguised_dots(text: str) -> list[tuple[int, int, str]]:
    """Places of dot forms between digits, spelled or not."""
    out: list[tuple[int, int, str]] = []
    if not may_be_disguised(text):
        return out
    number = lambda piece: piece is not None and (piece[0].isdigit() or piece[0].lower() in DIGIT_WORDS)
    for m in _DOT.finditer(text):
        if number(_LAST_PIECE.search(text[max(0, m.start() - 10) : m.start()])) and number(_PIECE.match(text, m.end(), m.end() + 10)):
            out.append((m.start(), m.end(), "."))
    return out


_GAP = re.compile(r"[ ,/()-]{1,3}|\.")


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Places of spelled digits in runs of digits, and of what stands between them."""
    out: list[tuple[int, int, str]] = []
    words = _PIECE.findall(text.lower())
    near = lambda w: w in DIGIT_WORDS or w in TIMES or w[0].isdigit()
    last = len(words) - 1
    if not any(w in DIGIT_WORDS and (i < last and near(words[i + 1]) or i and near(words[i - 1])) for i, w in enumerate(words)):
        return out
    run: list[tuple[int, int, str | None]] = []  # start, end, and the digits of a word
    plus = times = None

    def close() -> None:
        nonlocal run, plus, times
        if len(run) > 1 and any(new for _, _, new in run):
            if plus:
                out.append((plus[0], run[0][0], "+"))
            for k, (start, end, new) in enumerate(run):
                if k and (new or run[k - 1][2]) and text[run[k - 1][1] : start] != ".":
                    out.append((run[k - 1][1], start, ""))
                if new:
                    out.append((start, end, new))
        run, plus, times = [], None, None

    for m in _PIECE.finditer(text):
        word, before = m[0].lower(), times[1] if times else run[-1][1] if run else plus[1] if plus else None
        if before is not None and not _GAP.fullmatch(text, before, m.start()):
            close()
        if word in TIMES and not times:
            times = (m.start(), m.end(), TIMES[word])
        elif word in DIGIT_WORDS:
            run.append((times[0] if times else m.start(), m.end(), str(DIGIT_WORDS[word]) * (times[2] if times else 1)))
            times = None
        elif word[0].isdigit() and not times:
            run.append((m.start(), m.end(), None))
        else:
            close()
            plus = (m.start(), m.end()) if word == "plus" else None
    close()
    return out


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), LETTERS[m[0]]) for m in _LETTER.finditer(text) if m[0] in LETTERS]


TRANSDUCERS = (look_alikes, disguised_addresses, disguised_dots, spelled_digits)


def spans_of(text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, kind, end, base)`` of all spans, ascending."""
    base = [[(s, e) for s, e in find_(text)] for find_ in PATTERNS]
    out = [(s, k, e, True) for k, spans in enumerate(base) for s, e in spans]
    tapes: list[Tape] = []
    for rewrite in TRANSDUCERS:
        places = rewrite(tapes[-1].text if tapes else text)
        if places:
            tapes.append(Tape(tapes[-1].text if tapes else text, places))
    if tapes:
        for k, find_ in enumerate(PATTERNS):
            for s, e in find_(tapes[-1].text):
                new = False
                for tape in reversed(tapes):
                    new |= tape.touched(s, e)
                    s, e = tape.back(s, e)
                if new and not any(x < e and s < y and not (s <= x and y <= e and (s, e) != (x, y)) for x, y in _near(base[k], s, e)):
                    out.append((s, k, e, False))
    return sorted(out)


def _near(spans: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans, ascending and apart, that may overlap ``start`` to ``end``."""
    k = max(0, bisect_right(spans, (start,)) - 1)
    while k < len(spans) and spans[k][0] < end:
        yield spans[k]
        k += 1


# ---------------------------------------------------------------------------------------------- Spark

SPANS = "array<struct<start:int,kind:int,end:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every whole text, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "kind", "end", "base"), s, strict=True)) for s in spans_of(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else redacted(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str) -> str:
    parts, done = [], 0
    for start, kind, end, _ in spans_of(text):
        if end > done:
            parts += (text[done : max(start, done)], f"[{KINDS[kind]}]" if start >= done else "")
            done = end
    return "".join([*parts, text[done:]])


def spell(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    found = find(docs)
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, range(4)), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"), added)
