"""What a source may be used for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles, and the roles granted to each source; the last three are unrestricted.
ROLES = ("transcript_ingestion", "redaction_corpus", "intent_mining", "nlu_ground_truth", "slot_extraction_ground_truth", "trajectory_benchmark", "multi_turn_benchmark", "judge_evaluation")
GRANTED = {
    "aixblock": ("transcript_ingestion", "redaction_corpus", "intent_mining"),
    "bitext": ("nlu_ground_truth", "slot_extraction_ground_truth", "judge_evaluation"),
    "natcs": ("transcript_ingestion", "nlu_ground_truth", "judge_evaluation"),
    "synthetic": ROLES,
    "generic_csv": ROLES,
    "live_capture": ROLES,
}


def matrix(spark: SparkSession) -> DataFrame:
    """source, role: one row per grant."""
    return spark.createDataFrame([(s, r) for s, rs in GRANTED.items() for r in rs], "source string, role string")


def require_role(records: DataFrame, role: str) -> DataFrame:
    """records, if all of their sources have the role; the first row of another source fails the job. Null sources fail too."""
    may = sorted(s for s, rs in GRANTED.items() if role in rs)
    ok = F.coalesce(F.col("source").isin(may), F.lit(False))
    return records.withColumn("source", F.when(ok, F.col("source")).otherwise(F.raise_error(F.concat(F.coalesce("source", F.lit("null")), F.lit(f" may not be used for {role}; {', '.join(may) or 'none'} may")))))


def sources_for(grants: DataFrame) -> DataFrame:
    """role, sources: the sources of each role in order, joined by commas."""
    return grants.groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def denied(grants: DataFrame) -> DataFrame:
    """source, role of all roles a source doesn't have; the table of grants is fixed and small."""
    roles = grants.agg(F.collect_set("role").alias("roles"))
    return grants.groupBy("source").agg(F.collect_set("role").alias("has")).crossJoin(F.broadcast(roles)).select("source", F.explode(F.array_except("roles", "has")).alias("role"))
