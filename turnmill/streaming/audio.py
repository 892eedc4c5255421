"""Audio and text frames: sizes, chunks with a short tail, scripted frames, loudness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a sample of 16 bits.
SAMPLE = 2


def bytes_of_ms(ms: Column, rate: int) -> Column:
    return (ms * rate * SAMPLE / 1000).cast("long")


def ms_of_bytes(n: Column, rate: int) -> Column:
    return F.floor(n * 1000 / (rate * SAMPLE)).cast("long")


def chunks(df: DataFrame, column: str, size: int) -> DataFrame:
    """df with `frame` (from 0) and `chunk`: pieces of `size` bytes or characters, the last one shorter. Null and empty values give no row."""
    n = F.ceil(F.length(column) / size).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    piece = F.transform(at, lambda i: F.struct(i.cast("long").alias("frame"), F.substring(F.col(column), i * size + 1, F.lit(size)).alias("chunk")))
    return df.where(F.length(column) > 0).select("*", F.inline(piece))


def rms(pcm: Column) -> Column:
    """Loudness of little-endian 16-bit samples between 0 and 1; 0 for nothing, null for null; a half sample at the end is left out."""
    def one(b: bytes | None) -> float | None:
        if b is None:
            return None
        x = np.frombuffer(bytes(b)[: len(b) // SAMPLE * SAMPLE], "<i2").astype(np.float64)
        return float(np.sqrt(np.mean(x * x)) / 32768) if len(x) else 0.0

    def batch(s: pd.Series) -> pd.Series:
        return s.map(one).astype("float64")

    return F.pandas_udf(batch, "double", F.PandasUDFType.SCALAR)(pcm)


def scripted_frames(spark: SparkSession, script: list[tuple[int, int, int]], frame_ms: int = 20) -> DataFrame:
    """ts_ms, rms of a script of (silence before, speech, silence after) in milliseconds, on a clock of frame_ms."""
    rows, at = [], 0
    for lead, speech, tail in script:
        rows += [(at, lead, 0.0), (at + lead, speech, 0.5), (at + lead + speech, tail, 0.0)]
        at += lead + speech + tail
    d = spark.createDataFrame(rows or [(0, 0, 0.0)], "began long, ms long, rms double").where(f"ms >= {frame_ms}")
    return d.select(F.explode(F.sequence(F.col("began"), F.col("began") + F.col("ms") - frame_ms, F.lit(frame_ms).cast("long"))).alias("ts_ms"), "rms")


def may_interrupt(events: DataFrame, enabled: bool = True, least_ms: int = 250) -> DataFrame:
    """events (session, at_ms, played_ms) that cut in, with the steps that follow, in order: playback, speech and the turn are stopped.

    Nothing cuts in while it is switched off or before least_ms were played; null counts as nothing played.
    """
    d = events.where(F.coalesce(F.col("played_ms") >= least_ms, F.lit(False)) & F.lit(enabled))
    return d.select("*", F.posexplode(F.lit(["clear_playback", "cancel_speech", "cancel_turn"])).alias("step", "action"))
