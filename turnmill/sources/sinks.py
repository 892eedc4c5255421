"""Sinks: partitioned call logs with a quarantine, and a content-addressed vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

# Columns that hold raw content and may not be logged.
RAW_COLUMNS = frozenset("text content transcript utterance raw raw_text body message prompt completion audio payload instruction".split())


def guard(df: DataFrame) -> DataFrame:
    """df, if none of its columns may hold raw content."""
    bad = sorted(set(c.lower() for c in df.columns) & RAW_COLUMNS)
    if bad:
        raise ValueError(f"raw content may not be logged: {bad}")
    return df


def write_call_logs(records: DataFrame, path: str, fmt: str = "json", most_quarantined: float = 0.05) -> dict[str, float]:
    """Writes clean records under source=/date= and {record_id, reason} of the others under _quarantine, if there are any.

    records: record_id, source, at (timestamp), quarantined, reason and what is to be kept. They are evaluated once, into the shared
    folder; an empty input or a rate above most_quarantined raises before anything at `path` is touched.
    """
    staged = written(records.sparkSession, records.withColumn("date", F.date_format("at", "yyyy-MM-dd")), "call-logs")
    n = staged.agg(F.count("*").alias("seen"), F.count_if("quarantined").alias("quarantined")).first()
    if not n["seen"]:
        raise ValueError("nothing was read")
    rate = round(n["quarantined"] / n["seen"], 4)
    if rate > most_quarantined:
        raise ValueError(f"quarantine rate {rate} is above {most_quarantined}")
    w = staged.where(~F.col("quarantined")).drop("quarantined", "reason").write.mode("overwrite").partitionBy("source", "date")
    (w.option("compression", "gzip").json(path) if fmt == "json" else w.parquet(path))
    if n["quarantined"]:
        guard(staged.where("quarantined").select("record_id", "reason")).write.mode("overwrite").option("compression", "gzip").json(path.rstrip("/") + "/_quarantine")
    return {"seen": n["seen"], "emitted": n["seen"] - n["quarantined"], "quarantined": n["quarantined"], "rate": rate}


def write_taxonomy(nodes: DataFrame, path: str, taxonomy: str = "taxonomy_id") -> None:
    """One JSON object per taxonomy: its id and its nodes in order of intent_id; a taxonomy is one document, so its nodes are one row."""
    cols = [c for c in nodes.columns if c != taxonomy]
    nodes.groupBy(taxonomy).agg(F.array_sort(F.collect_list(F.struct("intent_id", *[c for c in cols if c != "intent_id"]))).alias("nodes")).write.mode("overwrite").json(path)


def push_once(df: DataFrame, path: str, key: str, order: str) -> int:
    """Appends rows whose key the table at `path` lacks; of several new ones the first by `order` stays. Returns how many.

    Null keys are never pushed. Pushing the same rows again adds none, so a repeated or restarted run is harmless.
    """
    spark = df.sparkSession
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")
    if exists(spark, path):
        first = first.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    new = written(spark, first, "push")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_vectors(spark: SparkSession, texts: DataFrame, cache: str, model: str, encode) -> DataFrame:
    """text, vector for each different text: those the table at `cache` lacks (by sha256 of the text and model) are encoded once
    and appended, the rest is read. encode: DataFrame(sha, text) -> DataFrame(sha, vector)."""
    want = texts.select("text").where(F.col("text").isNotNull()).distinct().withColumn("sha", F.sha2("text", 256))
    old = spark.read.parquet(cache).where(F.col("model") == model).select("sha", "vector") if exists(spark, cache) else None
    missing = want if old is None else want.join(old, "sha", "left_anti")
    encode(missing.select("sha", "text")).select("sha", "vector").withColumn("model", F.lit(model)).write.mode("append").parquet(cache)
    return want.join(spark.read.parquet(cache).where(F.col("model") == model).select("sha", "vector"), "sha").select("text", "vector")
