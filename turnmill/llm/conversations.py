"""Conversations put together from message rows.

Rows are spread over tasks by (conversation, time segment), never by conversation alone, so one that is never
closed is many small groups. In a segment the messages are sorted by start and read by a finite-state automaton;
the states of segments are merged (the automaton only ever adds what it has seen, so merging is a bitwise or),
with partial aggregation before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, number, strip

CALLER = ("customer", "caller", "client", "user", "member")
AGENT = ("agent", "advisor", "rep", "operator", "bot")
SEGMENT_MS = 600_000
#: Segments under one upper segment when positions are summed up.
FAN = 1024

# What a message is, as bits; the states of the automaton are sets of the same bits.
SAID_CALLER, SAID_AGENT, SAID_OTHER, BROKEN, SAID_IVR = 1, 2, 4, 8, 16


def role_of(speaker: Column) -> Column:
    s = F.lower(strip(speaker))
    return F.when(s.isin(*CALLER), "caller").when(s.isin(*AGENT), "agent").when(s == "ivr", "ivr")


def _prepared(messages: DataFrame) -> DataFrame:
    start = number(F.col("start_ms"))
    start = F.when(start >= 0, start)
    return messages.select(
        "message_id", "conversation_id", role_of(F.col("speaker")).alias("role"),
        F.when(~is_blank(F.col("text")), strip(F.col("text"))).alias("text"), start.alias("start"),
    ).where(F.col("conversation_id").isNotNull()).select(
        "*",
        # messages without a start are spread by their text, blank ones by their id
        F.when(F.col("text").isNull(), -1 - F.pmod(F.xxhash64("message_id"), F.lit(64)))
        .when(F.col("start").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(64)))
        .otherwise(F.floor(F.col("start") / SEGMENT_MS)).cast("long").alias("segment"),
    )


def _symbol() -> Column:
    seen = (F.when(F.col("role") == "caller", SAID_CALLER).when(F.col("role") == "agent", SAID_AGENT)
            .when(F.col("role") == "ivr", SAID_IVR).otherwise(SAID_OTHER | BROKEN))
    return F.when(F.col("text").isNull(), 0).otherwise(seen.bitwiseOR(F.when(F.col("start").isNull(), BROKEN).otherwise(0))).cast("int")


def _step(state: Column, symbol: Column) -> Column:
    """One move of the automaton: what was seen is added; both sides at one start lead to BROKEN, which is kept."""
    both = symbol.bitwiseAND(SAID_CALLER | SAID_AGENT) == (SAID_CALLER | SAID_AGENT)
    return state.bitwiseOR(symbol).bitwiseOR(F.when(both, BROKEN).otherwise(0))


def segment_states(messages: DataFrame) -> DataFrame:
    """The state in which the automaton leaves each segment."""
    at = (_prepared(messages).groupBy("conversation_id", "segment", "start")
          .agg(F.bit_or(_symbol()).alias("symbol")))
    runs = at.groupBy("conversation_id", "segment").agg(F.array_sort(F.collect_list(F.struct("start", "symbol"))).alias("run"))
    return runs.select(
        "conversation_id", "segment",
        F.aggregate("run", F.lit(0), lambda s, m: _step(s, m["symbol"])).alias("state"),
    )


def _defect(state: Column) -> Column:
    said = state.bitwiseAND(SAID_CALLER | SAID_AGENT)
    return (F.when(state.bitwiseAND(SAID_CALLER | SAID_AGENT | SAID_OTHER) == 0, "empty")
            .when(state.bitwiseAND(BROKEN) != 0, "broken").when(said != (SAID_CALLER | SAID_AGENT), "no_reply"))


def verdicts(messages: DataFrame) -> DataFrame:
    """conversation_id, defect (null: sound) for every conversation.

    Rows without conversation_id belong to none and are left out. A conversation with blank messages only is empty.
    Delivered again, a message changes no state, so repeats need no extra shuffle here. An empty table gives none.
    """
    return (segment_states(messages).groupBy("conversation_id").agg(F.bit_or("state").alias("state"))
            .select("conversation_id", _defect(F.col("state")).alias("defect")))


def dropped(messages: DataFrame) -> DataFrame:
    """The conversations that are dropped, and why: empty, broken or no_reply."""
    return verdicts(messages).where(F.col("defect").isNotNull())


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """The sound conversations: conversation_id, position (from 0), role, text, start_ms, message_id, deliveries.

    Order: start, then announcement, then text, then message_id. Deliveries of a message are one row with the smallest
    message_id and their number. Positions are sums over segments and upper segments plus the place within the
    segment, so no task holds a whole conversation.
    """
    one = (_prepared(messages).where(F.col("text").isNotNull() & F.col("start").isNotNull() & F.col("role").isNotNull())
           .groupBy("conversation_id", "segment", "role", "text", "start")
           .agg(F.min("message_id").alias("message_id"), F.count("*").alias("deliveries")))
    sound = verdicts(messages).where(F.col("defect").isNull()).select("conversation_id")
    counts = one.groupBy("conversation_id", "segment").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("segment") / FAN))
    counts = counts.join(sound, "conversation_id")
    uppers = counts.groupBy("conversation_id", "upper").agg(F.sum("n").alias("n"))
    up = uppers.select("conversation_id", "upper", F.coalesce(
        F.sum("n").over(Window.partitionBy("conversation_id").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    low = counts.select("conversation_id", "upper", "segment", F.coalesce(
        F.sum("n").over(Window.partitionBy("conversation_id", "upper").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("then"))
    offsets = low.join(up, ["conversation_id", "upper"]).select("conversation_id", "segment", (F.col("first") + F.col("then")).alias("offset"))
    within = Window.partitionBy("conversation_id", "segment").orderBy("start", F.col("role") != "ivr", "text", "message_id")
    return (one.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["conversation_id", "segment"])
            .select("conversation_id", (F.col("offset") + F.col("place")).cast("long").alias("position"), "role", "text",
                    F.col("start").alias("start_ms"), "message_id", F.col("deliveries").cast("long").alias("deliveries")))
