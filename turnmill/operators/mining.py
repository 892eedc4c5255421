"""Labelled corpora and vectors mined into an intent hierarchy with volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_slug, is_blank
from ..functions.vectors import dot, minus, set_cosine, unit

MIN_ROWS = 5


def derivation(row_key: Column) -> Column:
    """Whether a row is in the half the hierarchy is derived from: the first byte of its key's sha256 is even."""
    return F.conv(F.substring(F.sha2(row_key, 256), 2, 1), 16, 10).cast("int") % 2 == 0


def labelled_counts(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """category, intent (slugs), n, slots (sorted distinct names of {{placeholders}} in the instruction).

    Rows without either label are left out; pairs with fewer than min_rows rows as well.
    """
    d = rows.where(~is_blank(F.col("category")) & ~is_blank(F.col("intent")))
    names = F.transform(F.regexp_extract_all(F.coalesce("instruction", F.lit("")), F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), ascii_slug)
    return (d.select(ascii_slug(F.col("category")).alias("category"), ascii_slug(F.col("intent")).alias("intent"), names.alias("names"))
            .groupBy("category", "intent").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("slots"))
            .where(F.col("n") >= min_rows))


def adopt_taxonomy(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """node rows: intent_id, level, parent_id, label, utterance_count, share_of_total, slots, complexity, feasibility."""
    leaves = labelled_counts(rows, min_rows)
    complexity = F.least(F.lit(1.0), 0.25 + 0.15 * F.size("slots"))
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    l2 = leaves.select(F.concat_ws(".", "category", "intent").alias("intent_id"), F.lit(2).alias("level"), F.col("category").alias("parent_id"), title(F.col("intent")).alias("label"), "n", "slots", complexity.alias("complexity"))
    l1 = leaves.groupBy("category").agg(F.sum("n").alias("n")).select(
        F.col("category").alias("intent_id"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"), title(F.col("category")).alias("label"), "n",
        F.array().cast("array<string>").alias("slots"), F.lit(0.25).alias("complexity"))
    # one row per label: the sum over leaves in one task is small
    total = F.sum(F.when(F.col("level") == 2, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return l1.unionByName(l2).withColumn("total", total).select(
        "intent_id", "level", "parent_id", "label", F.col("n").alias("utterance_count"), F.bround(F.col("n") / F.col("total"), 6).alias("share_of_total"),
        F.array_join("slots", ",").alias("slots"), F.bround("complexity", 4).alias("complexity"), F.bround(F.greatest(F.lit(0.0), 1 - F.col("complexity")), 4).alias("feasibility"))


def quadrant(share: Column, complexity: Column, at: float = 0.05, hard: float = 0.5) -> Column:
    """Where an intent belongs by its share of the volume and its complexity; thresholds are inclusive."""
    high, complex_ = share >= at, complexity >= hard
    return F.when(high & ~complex_, "immediate_migration").when(high, "phased_agentic").when(~complex_, "self_service_scripted").otherwise("direct_agent_route")


def mean_vector(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """The mean of the vectors per key, as `mean`; partial sums per dimension are added before the shuffle."""
    d = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    one = d.groupBy(*keys) if keys else d.groupBy()
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def centred(df: DataFrame, vector: str) -> DataFrame:
    """df with the vector centred on the corpus mean and brought to length one; the mean is one row, so it is broadcast."""
    return df.crossJoin(F.broadcast(mean_vector(df, vector, []))).withColumn(vector, unit(minus(F.col(vector), F.col("mean")), 1e-12)).drop("mean")


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, centroid of length one, size."""
    m = mean_vector(df, vector, [label]).select(label, unit(F.col("mean")).alias("centroid"))
    return m.join(df.groupBy(label).agg(F.count("*").alias("size")), label)


def nearest(df: DataFrame, vector: str, cents: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """df with `nearest`, `score`, `margin` (best minus second best cosine) over all centroids.

    Centroids go to every task as one array: refused above `most` of them.
    """
    table = cents.select(F.col(label).alias("label"), F.col("centroid")).limit(most + 1)
    rows = table.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("cs"), F.count("*").alias("n"))
    rows = rows.select(F.when(F.col("n") <= most, F.col("cs")).otherwise(F.raise_error(F.lit(f"more than {most} centroids"))).alias("cs"))
    scored = df.crossJoin(F.broadcast(rows)).withColumn("s", F.transform("cs", lambda c: F.struct(dot(F.col(vector), c["centroid"]).alias("score"), c["label"].alias("label"))))
    best = F.array_sort("s", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    return (scored.withColumn("s", best).withColumn("nearest", F.get("s", F.lit(0))["label"]).withColumn("score", F.get("s", F.lit(0))["score"])
            .withColumn("margin", F.col("score") - F.get("s", F.lit(1))["score"]).drop("s", "cs"))


def hashed_embedding(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, embedding: counts of words and word pairs by hash, of length one; texts without words, null ones too, give zeros.

    Words are counted per key and slot before vectors are built; the key must be unique.
    """
    d = df.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)).alias("w"))
    d = d.withColumn("pairs", F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    n = d.select(key, F.explode(F.concat("w", "pairs")).alias("g")).groupBy(key, F.pmod(F.xxhash64("g"), F.lit(dim)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    one = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("len"), F.lit(0.0)))
    return df.select(key).join(one, key, "left").select(key, v.alias("embedding"))


def vocabulary(text: Column, stop: list[str]) -> Column:
    """Distinct content words: placeholders out, lower case, three letters or more, no stop words."""
    s = F.regexp_replace(text, r"\[[A-Z0-9_]+_\d+\]", " ")
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z']{3,}"), F.lit(0))), F.array(*[F.lit(w) for w in stop]))


def pair_overlap(docs: DataFrame, key: str, words: str, pairs: int, seed: int = 11) -> DataFrame:
    """Mean binary cosine over a fixed number of sampled pairs of documents: n_pairs, mean_overlap.

    Each document draws a partner slot by hash; those of one slot meet in hash order as neighbours, so no pair list grows.
    """
    d = docs.where(F.size(words) > 0).withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_slot", F.pmod("_h", F.lit(max(1, pairs))))
    w = Window.partitionBy("_slot").orderBy("_h", key)
    return (d.withColumn("_other", F.lead(words).over(w)).where(F.col("_other").isNotNull())
            .agg(F.count("*").alias("n_pairs"), F.avg(set_cosine(F.col(words), F.col("_other"))).alias("mean_overlap")))


def coverage(df: DataFrame, assigned: Column, filler: Column) -> DataFrame:
    """assigned, meant, coverage: filler is neither covered nor missed; null conditions are false."""
    real = ~F.coalesce(filler, F.lit(False))
    d = df.agg(F.count_if(real & F.coalesce(assigned, F.lit(False))).alias("assigned"), F.count_if(real).alias("meant"))
    return d.withColumn("coverage", F.bround(F.col("assigned") / F.nullif(F.col("meant"), F.lit(0)), 6))
