"""Keyed streams: keypad entries in session windows and a speech gate with hangover.

Every operator runs on a stream and on a table alike; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_DIGITS = 24


def entry_of(keys: Column) -> Column:
    """What a run of keys enters: up to the first "#", after the last "*" before it, MAX_DIGITS at most; null if nothing."""
    s = F.substring_index(keys, "#", 1)
    return F.nullif(F.substring(F.substring_index(s, "*", -1), 1, MAX_DIGITS), F.lit(""))


def keypad_entries(keys: DataFrame, session: str = "session", at: str = "at", key: str = "key", pause: str = "4 seconds", late: str = "10 seconds") -> DataFrame:
    """session, began, ended, digits: keys with less than `pause` between them are one entry; empty entries are dropped.

    Keys later than `late` behind the newest are dropped on a stream. Keys of one instant go by key.
    """
    w = (keys.withWatermark(at, late) if keys.isStreaming else keys).groupBy(session, F.session_window(at, pause).alias("w"))
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(key).alias("k")))), lambda x: x["k"]), "")
    return (w.agg(run.alias("keys")).select(session, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), entry_of(F.col("keys")).alias("digits")).where(F.col("digits").isNotNull()))


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """keys, began, n, total: counts and sums of `value` in tumbling windows."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("began"), "n", "total")


def gate(frames: pd.DataFrame, state: tuple, threshold: float, onset_ms: int, hangover_ms: int, frame_ms: int) -> tuple[list[tuple], tuple]:
    """Speech turns that end within the frames, and the state after them: (speaking, loud_ms, quiet_ms, began_ms).

    Loud frames for onset_ms begin a turn; quiet ones for hangover_ms end it; a loud frame resets the silence and a quiet
    one the pending onset.
    """
    speaking, loud, quiet, began = state
    out = []
    for ts, rms in sorted(zip(frames["ts_ms"].tolist(), frames["rms"].tolist())):
        if rms is not None and rms >= threshold:
            loud, quiet = loud + frame_ms, 0
            if not speaking and loud >= onset_ms:
                speaking, began = True, ts + frame_ms - loud
        else:
            if speaking:
                quiet += frame_ms
                if quiet >= hangover_ms:
                    out.append((began, ts + frame_ms - quiet))
                    speaking, quiet = False, 0
            loud = 0
    return out, (speaking, loud, quiet, began)


def speech_turns(frames: DataFrame, threshold: float = 0.02, onset_ms: int = 100, hangover_ms: int = 100, frame_ms: int = 20) -> DataFrame:
    """session, began_ms, ended_ms of the speech turns in frames (session, ts_ms, rms). A turn that is still going on gives no row."""
    schema = "session string, began_ms long, ended_ms long"
    if not frames.isStreaming:
        def batch(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            turns, _ = gate(f, (False, 0, 0, 0), threshold, onset_ms, hangover_ms, frame_ms)
            return pd.DataFrame([(key[0], a, b) for a, b in turns], columns=["session", "began_ms", "ended_ms"])

        return frames.groupBy("session").applyInPandas(batch, schema)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (False, 0, 0, 0)
        all_ = list(parts)
        turns, s = gate(pd.concat(all_), s, threshold, onset_ms, hangover_ms, frame_ms) if all_ else ([], s)
        state.update(s)
        yield pd.DataFrame([(key[0], a, b) for a, b in turns], columns=["session", "began_ms", "ended_ms"])

    return frames.groupBy("session").applyInPandasWithState(step, schema, "speaking boolean, loud long, quiet long, began long", "append", GroupStateTimeout.NoTimeout)
