"""Chat formatting with cumulative-snapshot collapse.

A logged conversation that is the beginning of a longer one is a snapshot of it. Rolling hashes
over turn prefixes find snapshots by an anti-join, and only maximal conversations are rendered.
Until then only hashes travel, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, stored

UNKNOWN_ROLE = "unknown"
BLOCK_TURNS = 256
TURN_START, TURN_END = "<|start|>", "<|end|>"


def _turn_hash() -> Column:
    role, text = F.coalesce("role", F.lit(UNKNOWN_ROLE)), F.coalesce("text", F.lit(""))
    return F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)


def _rolled(last: Column, h: Column) -> Column:
    return F.sha2(F.concat(last, h), 256)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id and prefixes: the rolling hash after each turn, in turn order (32 bytes a turn).

    Ties of turn numbers are ordered by hash, null turn numbers come first. A turn without a conv_id is a conversation of its own.
    Hashes are rolled in blocks of BLOCK_TURNS, so that growing the result copies one block at a time.
    """
    named = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", _turn_hash().alias("h")).alias("t"))
    ordered = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    none, blank = F.array().cast("array<string>"), F.lit("")

    def roll(acc: Column, t: Column) -> Column:
        now = _rolled(acc["last"], t["h"])
        return F.struct(now.alias("last"), F.concat(acc["seen"], F.array(now)).alias("seen"))

    def roll_block(acc: Column, at: Column) -> Column:
        block = F.slice("ts", at * BLOCK_TURNS + 1, F.lit(BLOCK_TURNS))
        rolled = F.aggregate(block, F.struct(acc["last"].alias("last"), none.alias("seen")), roll)
        return F.struct(rolled["last"].alias("last"), F.concat(acc["seen"], F.array(rolled["seen"])).alias("seen"))

    blocks = F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / BLOCK_TURNS).cast("int"))
    start = F.struct(blank.alias("last"), F.array().cast("array<array<string>>").alias("seen"))
    prefixes = F.aggregate(blocks, start, roll_block, lambda acc: F.flatten(acc["seen"]))
    alone = turns.filter("conv_id is null").select("conv_id", F.array(_rolled(blank, _turn_hash())).alias("prefixes"))
    return ordered.select("conv_id", prefixes.alias("prefixes")).unionByName(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, whole (the hash of all turns), n_turns and n_copies of conversations that are the beginning of no longer one.

    Of equal conversations the smallest conv_id stays and n_copies counts them all; conv_id is null where none of them has one.
    """
    logged = stored(prefix_hashes(turns), "prefix-hashes")
    whole = (
        logged.select(F.element_at("prefixes", -1).alias("whole"), "conv_id", F.size("prefixes").alias("n_turns"))
        .groupBy("whole")
        .agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count("*").alias("n_copies"))
    )
    shorter = logged.select(
        F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("shorter")
    ).distinct()
    return whole.join(shorter, F.col("whole") == F.col("shorter"), "left_anti").select("conv_id", "whole", "n_turns", "n_copies")


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a turn mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: maximal conversations in turn order between turn marks.

    A null role is ``unknown``, a null text empty; turn marks inside texts are defused. Each row with a null conv_id is a conversation of its
    own, of one turn. Repeated turn rows are turns of their own; ties of turn numbers are ordered by role and text. An empty table gives an empty
    result; columns other than conv_id, turn, role and text are ignored. A conversation's turns
    meet in one row, since its rendering is one string.
    """
    with scratch(turns.sparkSession) as block:
        kept = stored(maximal(turns), "maximal-conversations")
        chosen = kept.filter("conv_id is not null").select(F.col("conv_id").alias("kept_id"), "n_turns", "n_copies")
        said_as = [F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
        said = turns.select("conv_id", "turn", *said_as).join(chosen, F.col("conv_id") == F.col("kept_id"))
        ordered = said.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
        part = lambda t: F.concat(F.lit(TURN_START), _plain(t["role"]), F.lit("\n"), _plain(t["text"]), F.lit(TURN_END + "\n"))
        named = ordered.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies", F.array_join(F.transform("ts", part), "").alias("chat"))
        unnamed = kept.filter("conv_id is null").select(F.col("whole").alias("kept_whole"), "n_copies")
        own = turns.filter("conv_id is null").select("conv_id", _rolled(F.lit(""), _turn_hash()).alias("whole"), F.struct(*said_as).alias("t"))
        alone = own.join(unnamed, F.col("whole") == F.col("kept_whole")).groupBy("conv_id", "whole", "n_copies").agg(F.min("t").alias("t"))
        return block.keep(named.unionByName(alone.select("conv_id", F.lit(1).cast("bigint").alias("n_turns"), "n_copies", part(F.col("t")).alias("chat"))))
