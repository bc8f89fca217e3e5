"""Chat formatting: collapse of cumulative snapshots, then rendering of what is maximal.

Chat logs often hold a conversation again after each turn. Every turn gets a 128-bit hash of its
position, role and text; the running XOR over a conversation's turns is the hash of each prefix.
Conversations that are equal as a whole keep the smallest conv_id; those whose whole hash is a
proper prefix of a longer one go by an anti-join. The rest is rendered with turn markers.

Prefixes are made distinct before the anti-join and equal conversations are merged first, so one
conversation or first turn that a third of all logs share is one row on either side.

Edge cases: rows repeated as a whole are one turn; turns are in the order of turn (null first), role
and text; a null role or text is empty; rows without a conv_id form one conversation; markers inside
texts and roles are broken by a space, so neither can open or close a turn; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphsig.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, pos, p1, p2)``: each turn with the hash of the turns up to it."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("pos", F.row_number().over(order))
    one, two = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit(1), "pos", "role", "text")
    return placed.withColumn("p1", F.bit_xor(one).over(upto)).withColumn("p2", F.bit_xor(two).over(upto))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, copies)``: conversations that no other one repeats or goes on from."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("w")).select("conv_id", "w.*")
    whole = last.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    # a proper prefix: some conversation holds it and goes on
    nxt = F.lead("pos").over(Window.partitionBy("conv_id").orderBy("pos"))
    inner = prefixes.withColumn("next", nxt).filter("next is not null").select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "copies")


def _clean(text: Column) -> Column:
    """Markers with a space inside. Nothing is taken out, so what stood around a marker cannot form another."""
    broken = lambda marker: F.lit(marker.replace("<|", "< |"))
    return F.replace(F.replace(text, F.lit(OPEN), broken(OPEN)), F.lit(CLOSE), broken(CLOSE))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(role), F.lit("\n"), _clean(text), F.lit(CLOSE), F.lit("\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, copies, text)`` of each maximal conversation; copies counts equal ones."""
    prefixes = cut_lineage(prefix_hashes(turns).select("conv_id", "turn", "role", "text", "pos", "p1", "p2"))
    kept = cut_lineage(maximal(prefixes)).withColumnRenamed("conv_id", "__conv")
    lines = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "conv_id", "n_turns", "copies", F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("line")).alias("x")
    )
    grouped = lines.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("text"))


def chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
c AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, turns FROM c GROUP BY n_turns, turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c WHERE n_turns > 1))
SELECT w.conv_id, w.n_turns, w.copies,
       list_reduce(list_transform(w.turns, lambda x: '<|im_start|>' || replace(replace(x.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
         || replace(replace(x.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10)), lambda a, b: a || b) AS text
FROM w ANTI JOIN p ON w.turns = p.turns
"""
