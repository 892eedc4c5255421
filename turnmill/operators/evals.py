"""Scores of predictions against labels, and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    """total, measured, exact, accuracy. A row without prediction is unmeasured only if any row of the run has one."""
    answered = F.col(predicted).isNotNull()
    ok = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    a = cases.agg(F.count("*").alias("total"), F.count_if(answered).alias("answered"), F.count_if(ok).alias("exact"))
    measured = F.when(F.col("answered") > 0, F.col("answered")).otherwise(F.col("total"))
    return a.select("total", measured.alias("measured"), "exact", F.bround(F.col("exact") / F.nullif(measured, F.lit(0)), 4).alias("accuracy"))


def per_label(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    ok = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    return (cases.groupBy(F.col(expected).alias("label")).agg(F.count("*").alias("total"), F.count_if(ok).alias("exact"))
            .withColumn("accuracy", F.bround(F.col("exact") / F.col("total"), 4)))


def confusions(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    return cases.where(F.col(expected) != F.col(predicted)).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """Two variants of one set of cases: cases, compared, agreed, agreement, skipped, largest gap of the scores."""
    j = a.select(key, F.col(value).alias("va"), F.col(score).alias("sa")).join(b.select(key, F.col(value).alias("vb"), F.col(score).alias("sb")), key, "full")
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    same = F.coalesce(F.col("va") == F.col("vb"), F.lit(False))
    return j.agg(F.count("*").alias("cases"), F.count_if(both).alias("compared"), F.count_if(same).alias("agreed"), F.count_if(~both).alias("skipped"),
                 F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_gap")).withColumn("agreement", F.bround(F.col("agreed") / F.nullif(F.col("compared"), F.lit(0)), 4))


def latency(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Per stage: n, p50, p95, p99 (nearest rank), largest."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(stage).agg(F.count(value).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("largest"))


def passed(value: Column, threshold: float, lower_is_better: bool) -> Column:
    """Whether a metric keeps its threshold; equal keeps it."""
    return value <= threshold if lower_is_better else value >= threshold


def index_percentiles(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Per key, for each name the value at place floor(n * fraction) of the order, from 0; nulls are left out.

    Counted over the different values of a key, so a task holds these and not the rows.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy(value)
    c = n.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    return c.groupBy(key).agg(*[F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * f)), F.col(value))).alias(name) for name, f in at.items()])


def _answered() -> Column:
    return F.col("predicted").isNotNull() & ~F.col("unavailable") & ~F.col("timed_out")


def measured(cases: DataFrame) -> DataFrame:
    """cases (expected, predicted, unavailable, timed_out, ms) with `unmeasured`: never served, or timed out in a run that answered something."""
    any_ = cases.agg(F.coalesce(F.max(_answered()), F.lit(False)).alias("any_answered"))
    return cases.crossJoin(F.broadcast(any_)).withColumn("unmeasured", F.col("unavailable") | (F.col("timed_out") & F.col("any_answered"))).drop("any_answered")


def routing(cases: DataFrame) -> DataFrame:
    """cases, unmeasured, exact, category_correct (what stands before the first dot), p95_ms of the answers, over all cases."""
    m = ~F.col("unmeasured")
    top = lambda c: F.substring_index(c, ".", 1)
    ms = F.when(m & _answered(), F.col("ms"))
    return measured(cases).withColumn("answer_ms", ms).agg(
        F.count("*").alias("cases"), F.count_if("unmeasured").alias("unmeasured"), F.count_if(m & (F.col("predicted") == F.col("expected"))).alias("exact"),
        F.count_if(m & (top("predicted") == top("expected"))).alias("category_correct"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY answer_ms)").cast("long").alias("p95_ms"))


def ranked_confusions(cases: DataFrame) -> DataFrame:
    """expected, predicted ("<none>" for no answer), n, rank: measured cases that went wrong, most frequent first, then by name."""
    wrong = measured(cases).where(~F.col("unmeasured") & ~F.col("predicted").eqNullSafe(F.col("expected")))
    n = wrong.groupBy("expected", F.coalesce("predicted", F.lit("<none>")).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "expected", "predicted")))  # a row per pair of labels


def ledger_total(ms: tuple[str, ...], us: tuple[str, ...] = ()) -> Column:
    """Milliseconds of all stages; those in microseconds are rounded half to even. Null stages count 0."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ms] + [F.bround(F.coalesce(F.col(c), F.lit(0)) / 1000) for c in us]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def stage_latency(ledgers: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """stage, n, p50, p95, p99, largest, breaches: the columns named by budgets turned to rows; a breach is above the stage's budget."""
    long_ = ledgers.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("ms"), F.lit(b).alias("budget")) for s, b in budgets.items()])))
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)").cast("long")
    return long_.groupBy("stage").agg(F.count("ms").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("ms").alias("largest"), F.count_if(F.col("ms") > F.col("budget")).alias("breaches"))


def budget(stages: DataFrame, ms: str, ceiling: int, sane: float = 1.25) -> DataFrame:
    """total, slack, plausible: the stages' sum, what is left of the ceiling, and whether the sum is at most `sane` times it."""
    t = stages.agg(F.coalesce(F.sum(ms), F.lit(0)).cast("long").alias("total"))
    return t.select("total", (F.lit(ceiling) - F.col("total")).cast("long").alias("slack"), (F.col("total") <= sane * ceiling).alias("plausible"))


def report_passed(metrics: DataFrame, ok: str) -> DataFrame:
    """passed: whether all metrics did, failed: how many didn't; null counts as failed, no metric as passed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return metrics.agg(F.coalesce(F.min(good), F.lit(True)).alias("passed"), F.count_if(~good).alias("failed"))
