"""Ordered analytics that stay balanced when one key holds a large part of all rows.

A key's rows are cut into buckets of the order column. Windows run within (key, bucket); what a bucket needs from the ones
before it comes from a small table with a row per bucket. Results equal those of one window per key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def lagged(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str, width: float) -> DataFrame:
    """df with `name`: `value` of the row before (by order, then ties) within the keys; null for the first.

    Null order values come first, in a bucket of their own. A null value is carried as null.
    """
    b = df.withColumn("_bucket", F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62))).cast("long"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).asc_nulls_first(), *ties)
    inner = b.withColumn("_n", F.row_number().over(w)).withColumn("_own", F.lag(value).over(w))
    ends = (b.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value), F.struct(F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), *ties)).alias("_last")))
    carried = ends.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    on = [inner[k].eqNullSafe(carried[k]) for k in keys] + [inner["_bucket"] == carried["_bucket"]]
    return (inner.join(carried, on, "left").select(*[inner[c] for c in inner.columns], carried["_carry"])
            .withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")[value]).otherwise(F.col("_own"))).drop("_bucket", "_n", "_own", "_carry"))


def running_sum(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, width: float) -> DataFrame:
    """df with `name`: the sum of `value` from the key's first row up to this one, by order, then ties; nulls add nothing."""
    b = df.withColumn("_bucket", F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62))).cast("long")).withColumn("_v", F.coalesce(value, F.lit(0)))
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = b.withColumn("_own", F.sum("_v").over(w))
    sums = b.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_s"))
    carried = sums.select(*keys, "_bucket", F.coalesce(F.sum("_s").over(_before(keys)), F.lit(0)).alias("_carry"))
    on = [inner[k].eqNullSafe(carried[k]) for k in keys] + [inner["_bucket"] == carried["_bucket"]]
    return (inner.join(carried, on).select(*[inner[c] for c in inner.columns], carried["_carry"])
            .withColumn(name, F.col("_own") + F.col("_carry")).drop("_bucket", "_v", "_own", "_carry"))


def gap_turns(words: DataFrame, key: str, start: str, end: str, ties: list[str], gap: float, width: float = 600_000.0) -> DataFrame:
    """words with `turn`: a pause of `gap` or more between a word's start and the end before it begins a new turn (from 0).

    A missing time counts as no pause.
    """
    w = lagged(words, [key], start, ties, end, "_prev_end", width)
    new = F.coalesce((F.col(start) - F.col("_prev_end") >= gap).cast("int"), F.lit(0))
    return running_sum(w.withColumn("_new", new), [key], start, ties, F.col("_new"), "turn", width).drop("_new", "_prev_end").withColumn("turn", F.col("turn").cast("long"))


def rising(df: DataFrame, key: str, order: str, ties: list[str], value: str, threshold: float) -> DataFrame:
    """df with `rising`: the last three values strictly increase and the last is at least half the threshold."""
    w = Window.partitionBy(key).orderBy(order, *ties)
    v = F.col(value)
    up = (F.lag(v, 2).over(w) < F.lag(v, 1).over(w)) & (F.lag(v, 1).over(w) < v) & (v >= threshold / 2)
    return df.withColumn("rising", F.coalesce(up, F.lit(False)))


def history(df: DataFrame, key: str, order: str, ties: list[str], value: str, k: int) -> DataFrame:
    """df with `history`: the k values before the row, oldest first; the current one is left out."""
    w = Window.partitionBy(key).orderBy(order, *ties).rowsBetween(-k, -1)
    return df.withColumn("history", F.collect_list(value).over(w))


def round_robin(df: DataFrame, stratum: str, row: str, n: int, seed: int) -> DataFrame:
    """n rows by turns over the strata: each stratum's first row by hash, then each one's second, and so on."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), row), row)
    per = Window.partitionBy(stratum, "_part").orderBy(F.xxhash64(F.lit(seed), row), row)
    # no stratum gives more than n rows: a first cut in parts of each keeps the last window small
    parts = df.withColumn("_part", F.pmod(F.hash(row), F.lit(32))).withColumn("_k", F.row_number().over(per)).where(F.col("_k") <= n)
    return (parts.withColumn("_depth", F.row_number().over(w)).where(F.col("_depth") <= n).orderBy("_depth", stratum).limit(n)
            .select(*df.columns, F.col("_depth").alias("depth")))


def top_k(df: DataFrame, key: str, score: Column, ties: list[str], k: int, parts: int = 64) -> DataFrame:
    """The k rows of highest score per key, with `rank`: first within parts of the key, then over the survivors."""
    s = df.withColumn("_score", score).withColumn("_part", F.pmod(F.xxhash64(*ties), F.lit(parts)))
    w1 = Window.partitionBy(key, "_part").orderBy(F.col("_score").desc_nulls_last(), *ties)
    w2 = Window.partitionBy(key).orderBy(F.col("_score").desc_nulls_last(), *ties)
    return (s.withColumn("_k", F.row_number().over(w1)).where(F.col("_k") <= k).withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .drop("_part", "_k", "_score"))


def runs(df: DataFrame, order: str, value: str, width: float) -> DataFrame:
    """df with `first`: 1 where the row before (by order, over all rows) has another value, else 0; nulls are one value."""
    d = lagged(df, [], order, [], value, "_previous", width)
    lowest = df.agg(F.min(order).alias("_lowest"))  # the first row has none before it
    return (d.crossJoin(F.broadcast(lowest)).withColumn("first", F.when(F.col("_previous").eqNullSafe(F.col(value)) & (F.col(order) > F.col("_lowest")), 0).otherwise(1))
            .drop("_previous", "_lowest"))


def contiguous(df: DataFrame, key: str, index: str, first: int = 0) -> DataFrame:
    """key, n, contiguous: whether the rows of a key carry each number from `first` on exactly once. Null numbers are no number."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.countDistinct(index).alias("different"))
    ok = (F.col("lo") == first) & (F.col("hi") == F.col("n") + first - 1) & (F.col("different") == F.col("n"))
    return g.select(key, "n", F.coalesce(ok, F.lit(False)).alias("contiguous"))


def set_digest(df: DataFrame, key: str, member: str) -> DataFrame:
    """key, ids, digest: key, "-" and 16 digits of the sha256 of the key and its distinct members in order. Null members are left out.

    The digest reads its members one after the other; a key's task streams them, so its memory does not grow with them.
    """
    d = df.select(F.col(key).cast("string").alias("key"), F.col(member).cast("string").alias("member")).where(F.col("key").isNotNull() & F.col("member").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, h = None, 0, hashlib.sha256()
        for b in batches:
            out = []
            for k, m in zip(b["key"], b["member"]):
                if k != now:
                    if now is not None:
                        out.append((now, n, f"{now}-{h.hexdigest()[:16]}"))
                    now, n, h = k, 0, hashlib.sha256(k.encode())
                h.update(m.encode())
                n += 1
            yield pd.DataFrame(out, columns=["key", "ids", "digest"])
        if now is not None:
            yield pd.DataFrame([(now, n, f"{now}-{h.hexdigest()[:16]}")], columns=["key", "ids", "digest"])

    return d.repartition("key").sortWithinPartitions("key", "member").mapInPandas(run, "key string, ids long, digest string").withColumnRenamed("key", key)


def latest(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str, width: float) -> DataFrame:
    """df with `name`: the last `value` that is not null from the key's first row up to this one."""
    b = df.withColumn("_bucket", F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62))).cast("long")).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = b.withColumn("_own", F.last("_v", ignorenulls=True).over(w))
    place = F.struct(F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), *ties)
    ends = b.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_l"))
    carried = ends.select(*keys, "_bucket", F.last("_l", ignorenulls=True).over(_before(keys)).alias("_carry"))
    on = [inner[k].eqNullSafe(carried[k]) for k in keys] + [inner["_bucket"] == carried["_bucket"]]
    return (inner.join(carried, on).select(*[inner[c] for c in inner.columns], carried["_carry"])
            .withColumn(name, F.coalesce("_own", "_carry")).drop("_bucket", "_v", "_own", "_carry"))
