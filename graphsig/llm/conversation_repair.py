"""Conversation structure repair by dynamic programming over turns sorted within their conversation.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role and text hash). A row
is kept, gets another role, or is deleted, and empty turns may be inserted anywhere, so that the role
initials read ``(s?(ua)+)?``. The cheapest edits are found, of equally cheap ones those whose initials
(D, I, K, R) are least as a string.

Method. Light rows without texts are dealt by conversation and sorted; ``mapInArrow`` streams them and
carries the state of the program from one Arrow batch to the next: for each of the four places in the
pattern (start, after s, u, a) the cheapest cost and the rank of its edit string among the four. Edit
strings of the same rows are never prefixes of each other, because each ends with an edit of the last row,
so the ranks decide all ties. Costs are taken from the least, and places that cannot be on a cheapest way
any more are closed; only a few different states remain, and each (state, row kind) is worked out once
and then looked up, with its backpointers in one integer. A conversation that ends within ``HOLD`` rows is
traced back at once. A giant one spills: its rows leave the task with their backpointers as rows of the
checkpointed table, the end of the conversation as a last row, and a second stream, sorted backwards,
traces them. No task ever holds more than ``HOLD`` rows of a conversation, and what is spilled lies in the shared folder.

Rows that repeat an earlier turn (same role and text) are found by a partial aggregate of the first turn of
each (conversation, role, text hash), joined with salts, so that one often repeated turn spreads over
tasks. Texts move once, to the rows that keep them, joined on keys that no two rows share.

Edge cases: a null conv_id is a conversation of its own, with all rows that have none; null turns come
first; null roles and texts are one space. Equal rows (same turn, role and text) are one row with a
multiplicity: the first may stay, the others are duplicates. Very long texts are only hashed on the way. An
empty table gives an empty result. Only conv_id, turn, role and text are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsig.llm.common import SPACE, SPACE_CHARS
from graphsig.session import cut_lineage

#: Rows of a conversation that a task holds before it spills them.
HOLD = 50_000
#: Salts of repeated turns.
SALTS = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Places in the pattern; what may come next there is s, u or a.
START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: Kinds of rows: must go, sound, truncated.
BAD, SOUND, CUT = range(3)
CLOSED = 10**6


def inserted(place: int) -> int:
    """Where an inserted turn leads: there is one choice everywhere."""
    return A if place == U else U


def step_options() -> dict[tuple[int, int, str], list[tuple[str, int, int]]]:
    """``(edits, cost, place after)`` of one row by (place, kind, initial): up to two inserted turns, then
    the edit of the row itself. Two insertions lead to every place that more would."""
    out = {}
    for place in range(4):
        for kind in (BAD, SOUND, CUT):
            for initial in "sua?":
                ways, at = [], place
                for n in range(3):
                    before, cost = "I" * n, n * INSERT
                    ways.append((before + "D", cost + DELETE, at))
                    if kind != BAD:
                        extra = TRUNCATED if kind == CUT else 0
                        if initial in NEXT[at]:
                            ways.append((before + "K", cost + KEEP + extra, NEXT[at][initial]))
                        ways.append((before + "R", cost + REROLE + extra, inserted(at)))
                    at = inserted(at)
                out[place, kind, initial] = ways
    return out


OPTIONS = step_options()
#: All edits of one row; a backpointer is their number and the place before, four of them in an integer.
EDITS = sorted({way[0] for ways in OPTIONS.values() for way in ways})


@lru_cache(maxsize=100_000)
def step(costs: tuple[int, ...], ranks: tuple[int, ...], kind: int, initial: str) -> tuple[int, tuple[int, ...], tuple[int, ...], int]:
    """``(least cost added, costs from there, ranks, backpointers)`` after a row."""
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for place in range(4):
        if costs[place] < CLOSED:
            for edits, cost, to in OPTIONS[place, kind, initial]:
                way = (costs[place] + cost, ranks[place], edits, place)
                if best[to] is None or way < best[to]:
                    best[to] = way
    # from a, every turn that start could take is deleted for 2 more at most, and s could take none for less
    if best[A] is not None:
        for place, more in ((START, DELETE), (S, 0)):
            if best[place] is not None and best[place][0] > best[A][0] + more:
                best[place] = None
    open_ = [p for p in range(4) if best[p] is not None]
    least = min(best[p][0] for p in open_)
    order = sorted(open_, key=lambda p: best[p][1:3])
    back = 0
    for p in open_:
        back |= (EDITS.index(best[p][2]) * 4 + best[p][3]) << (8 * p)
    return (
        least,
        tuple(best[p][0] - least if best[p] else CLOSED for p in range(4)),
        tuple(order.index(p) if best[p] else 0 for p in range(4)),
        back,
    )


FIRST = ((0, CLOSED, CLOSED, CLOSED), (0, 0, 0, 0))


def ending(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, str]:
    """The place after the last row, and the turns inserted behind it."""
    ways = []
    for place, tail in ((START, ""), (A, ""), (U, "I"), (S, "II")):
        if costs[place] < CLOSED:
            ways.append((costs[place] + len(tail) * INSERT, ranks[place], tail, place))
    return min(ways)[3], min(ways)[2]


def undo(back: int, place: int) -> tuple[str, int]:
    """The edits that led to ``place``, and the place before."""
    code = back >> (8 * place) & 255
    return EDITS[code >> 2], code & 3


def roles_of(edits: str, place: int, role: str) -> tuple[list[str], int]:
    """The turns that the edits of one row put out from ``place``, as ``I:role`` where inserted and
    ``K:role`` where the row stays, and the place after."""
    out = []
    for e in edits:
        if e == "I":
            place = inserted(place)
            out.append("I:" + ("user" if place == U else "assistant"))
        elif e == "K":
            place = NEXT[place][role[:1]]
            out.append("K:" + role)
        elif e == "R":
            place = inserted(place)
            out.append("K:" + ("user" if place == U else "assistant"))
    return out, place


# ---------------------------------------------------------------------------------------- light rows


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _id(rows: DataFrame) -> Column:
    """The conversation's id as a long or a string."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return F.col("conv_id").cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "string")


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Light rows ``(c, t, role, h1, h2, n, kind, dup)`` of ``(conv_id, turn, role, text, n)``: n equal rows
    are one; ``dup`` marks those whose role and text an earlier turn has."""
    text = _space("text")
    last = F.right(F.rtrim(text, F.lit(SPACE_CHARS)), F.lit(1))
    blank = ~text.rlike(f"[^{SPACE}]")
    kind = F.when(blank, BAD).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    hashed = rows.select(
        _id(rows).alias("c"), F.col("turn").cast("long").alias("t"), _space("role").alias("role"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), kind.alias("kind"), F.col("n").cast("long").alias("n"),
    )
    light = cut_lineage(hashed.groupBy("c", "t", "role", "h1", "h2", "kind").agg(F.sum("n").alias("n")))
    same = ["c", "role", "h1", "h2"]
    often = light.groupBy(*same).agg(F.min(F.struct("t")).alias("first"), F.count(F.lit(1)).alias("turns"))
    often = often.filter("turns > 1").drop("turns").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = light.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).alias("l")
    match = F.col("l.salt") == F.col("o.salt")
    for k in same:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = salted.join(often.alias("o"), match, "left")
    first = F.col("first")["t"]
    return joined.select("l.*", (F.col("first").isNotNull() & ~first.eqNullSafe(F.col("l.t"))).alias("dup")).drop("salt")


ORDER = ["c", "t", "role", "h1", "h2"]
TRACED = "c {c}, t long, role string, h1 long, h2 long, kind int, dup boolean, n long, seq long, back array<long>, place int, edits array<string>"


def _traced_schema(kind: str) -> pa.Schema:
    c = pa.int64() if kind == "bigint" else pa.string()
    fields = [("c", c), ("t", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("kind", pa.int32()), ("dup", pa.bool_()), ("n", pa.int64())]
    return pa.schema([*fields, ("seq", pa.int64()), ("back", pa.list_(pa.int64())), ("place", pa.int32()), ("edits", pa.list_(pa.string()))])


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _copies(kind: int, dup: bool, n: int) -> Iterator[int]:
    """The kinds of n equal rows: of all but the first, the role and text were seen."""
    yield BAD if dup else kind
    for _ in range(n - 1):
        yield BAD


def traced(light: DataFrame, hold: int = HOLD) -> DataFrame:
    """Light rows with their number in the conversation and the edits of each of their copies. ``place`` of a
    conversation's last row, which stands for its end, has the tail's edits."""
    id_type = light.schema["c"].dataType.simpleString()
    schema = _traced_schema(id_type)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs, ranks, held, seq, spilled, started = None, *FIRST, [], 0, False, False
        out: list[tuple] = []

        def close() -> list[tuple]:
            place, tail = ending(costs, ranks)
            end = (conv, None, None, None, None, None, None, 0, seq, None, place, [tail])
            if spilled:
                return [*held, end]
            done = [end]
            for row in reversed(held):
                edits, place = _undo_row(row[9], place)
                done.append((*row[:9], None, place, edits))
            return done

        for batch in batches:
            for row in _rows_of(batch):
                if not started or row[0] != conv:
                    if started:
                        out += close()
                    conv, costs, ranks, held, seq, spilled, started = row[0], *FIRST, [], 0, False, True
                initial = row[2][:1] if row[2][:1] in ("s", "u", "a") else "?"
                back = []
                for kind in _copies(row[5], row[6], row[7]):
                    _, costs, ranks, b = step(costs, ranks, kind, initial)
                    back.append(b)
                held.append((*row, seq, back, None, None))
                seq += 1
                if len(held) >= hold:
                    out, held, spilled = out + held, [], True
                if len(out) >= 10_000:
                    yield _batch(out, schema)
                    out = []
        if started:
            out += close()
        yield _batch(out, schema)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = START
        for batch in batches:
            out = []
            for row in _rows_of(batch):
                if row[9] is None:  # the conversation's end
                    place = row[10]
                    out.append(row)
                else:
                    edits, place = _undo_row(row[9], place)
                    out.append((*row[:9], None, place, edits))
            yield _batch(out, schema)

    text = TRACED.format(c=id_type)
    one = light.select("c", "t", "role", "h1", "h2", "kind", "dup", "n")
    seen = cut_lineage(one.repartition("c").sortWithinPartitions(*ORDER).mapInArrow(forward, text))
    giant = seen.filter(F.col("back").isNotNull()).select(F.col("c").alias("g")).distinct()
    here = seen["c"].eqNullSafe(giant["g"])
    rest = seen.join(giant, here, "left_anti")
    back = seen.join(giant, here, "left_semi").repartition("c").sortWithinPartitions("c", F.desc("seq")).mapInArrow(backward, text)
    return rest.unionByName(back)


def _undo_row(back: list[int], place: int) -> tuple[list[str], int]:
    edits = []
    for b in reversed(back):
        e, place = undo(b, place)
        edits.append(e)
    return edits[::-1], place


# ------------------------------------------------------------------------------------------- results


def edited(rows: DataFrame, hold: int = HOLD) -> DataFrame:
    """Every row with its number in the conversation, its faults, its edits and, where it stays, its text."""
    done = cut_lineage(traced(sorted_rows(rows), hold))
    text = _space("text")
    keys = {"k_c": _id(rows), "k_t": F.col("turn").cast("long"), "k_role": _space("role"), "k_h1": F.xxhash64(text), "k_h2": F.xxhash64(F.lit(1), text)}
    texts = rows.select(*(v.alias(k) for k, v in keys.items()), text.alias("text")).groupBy(*keys).agg(F.first("text").alias("text"))
    stays = F.exists("edits", lambda e: e.rlike("[KR]"))
    match = stays & (F.col("k_h1") == F.col("h1")) & (F.col("k_h2") == F.col("h2")) & (F.col("k_role") == F.col("role"))
    match = match & F.col("k_c").eqNullSafe(F.col("c")) & F.col("k_t").eqNullSafe(F.col("t"))
    joined = done.join(texts, match, "left")
    return joined.select("c", "seq", "t", "role", "kind", "dup", "n", "edits", "text")


REPORT = "conv_id {c}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id {c}, position long, turn long, role string, text string"


def _stream(edits: list[str], role: str | None, place: int) -> tuple[list[str], int]:
    out = []
    for e in edits:
        roles, place = roles_of(e, place, role or "")
        out += roles
    return out, place


def repair(rows: DataFrame, hold: int = HOLD) -> DataFrame:
    """The repaired conversations: ``(conv_id, position, turn, role, text)``; inserted turns have no turn
    number and an empty text. ``rows`` has conv_id, turn, role and text."""
    done = edited(rows.withColumn("n", F.lit(1)), hold)
    id_type = done.schema["c"].dataType.simpleString()
    schema = pa.schema([("conv_id", pa.int64() if id_type == "bigint" else pa.string()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, position, started = None, START, 0, False
        for batch in batches:
            out = []
            for c, _, t, role, _, _, _, edits, text in _rows_of(batch):
                if not started or c != conv:
                    conv, place, position, started = c, START, 0, True
                roles, place = _stream(edits, role, place)
                for r in roles:
                    kept = r[0] == "K"
                    out.append((c, position, t if kept else None, r[2:], text if kept else ""))
                    position += 1
            yield _batch(out, schema)

    return done.repartition("c").sortWithinPartitions("c", "seq").mapInArrow(run, REPAIRED.format(c=id_type))


def report(rows: DataFrame, hold: int = HOLD) -> DataFrame:
    """One row for each conversation: faults by kind, adjacent turns whose roles cannot follow each other,
    the cost and initials of the edits, and the digest of the repaired turns, streamed in order."""
    done = edited(rows, hold)
    id_type = done.schema["c"].dataType.simpleString()
    longs = [(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
    schema = pa.schema([("conv_id", pa.int64() if id_type == "bigint" else pa.string()), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started = None, False
        blank = duplicate = truncated = illegal = cost = place = 0
        before, audit, digest, first = None, [], hashlib.sha256(), True

        def row() -> tuple:
            return conv, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

        for batch in batches:
            out = []
            for c, _, _, role, kind, dup, n, edits, text in _rows_of(batch):
                if not started or c != conv:
                    if started:
                        out.append(row())
                    conv, started = c, True
                    blank = duplicate = truncated = illegal = cost = place = 0
                    before, audit, digest, first = None, [], hashlib.sha256(), True
                if n:
                    initial = role[:1]
                    illegal += before is not None and before + initial not in ("su", "ua", "au")
                    illegal += n - 1  # the same role twice
                    before = initial
                    # a blank text is blank first, whatever it repeats
                    blank += n if kind == BAD else 0
                    duplicate += 0 if kind == BAD else n if dup else n - 1
                    stays = kind == CUT and not dup
                    truncated += stays
                    cost += TRUNCATED if stays and edits[0][-1] in "KR" else 0
                roles, place = _stream(edits, role, place)
                for e in edits:
                    audit.append(e)
                    cost += sum(map(price.__getitem__, e))
                for r in roles:
                    digest.update((("" if first else "\n") + r[2:] + ":").encode())
                    if r[0] == "K":
                        digest.update(text.encode())
                    first = False
            yield _batch(out, schema)
        if started:
            yield _batch([row()], schema)

    return done.repartition("c").sortWithinPartitions("c", "seq").mapInArrow(run, REPORT.format(c=id_type))


def gaps(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps)``: turn numbers missing between the first and the last."""
    t = F.col("turn").cast("long")
    spread = F.max(t) - F.min(t) + 1 - F.count_distinct(t)
    return rows.groupBy(_id(rows).alias("conv_id")).agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``: rows ``(conv_id, turn, role, text, n)``."""
    at = F.pmod(F.crc32(F.concat_ws(":", _space("conv_id"), _space("turn"))), F.lit(20))
    text = F.when(at == 1, F.lit("")).when(at == 2, F.regexp_replace(_space("text"), "[.!?]", "")).otherwise(_space("text"))
    role = F.when(at == 4, F.lit("user")).otherwise(_space("role"))
    return conversations.filter(at != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(at == 3, 2).otherwise(1).alias("n"))


def conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return damaged_report(conversations)


def damaged_report(conversations: DataFrame, hold: int = HOLD) -> DataFrame:
    rows = damage(conversations)
    every = conversations.select(_id(conversations).alias("k")).distinct()
    found, missing = report(rows, hold), gaps(rows).withColumnRenamed("conv_id", "g")
    joined = every.join(missing, F.col("k").eqNullSafe(F.col("g")), "left").join(found, F.col("k").eqNullSafe(F.col("conv_id")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("k").alias("conv_id"),
        *map(number, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
