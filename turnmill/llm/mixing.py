"""Sources mixed to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their sums meet the margins: the sources' target
shares, and the languages' and topics' natural shares of what the sources with a target hold. Documents are then drawn
systematically by their cell's calibrated weight: a cell's documents are ordered by hash, and each is used as often as
a whole number is passed by the running sum. Running sums go over hash buckets, so no task holds a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import TOKENIZER, with_tokens

ROUNDS = 200
#: Documents per hash bucket of a running sum.
BUCKET = 10_000
#: The table of cells goes to the driver; more cells than this are refused.
MOST_CELLS = 1_000_000


def language(lang: Column) -> Column:
    """Two lower-case letters: "EN" and "en-US" are "en"; others, also null, are "und"."""
    s = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(s.isNull() | (s == ""), "und").otherwise(s)


def source_sizes(share: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: its share of the total, at most `most`; what a source lacks goes to the others by their shares."""
    size = {s: 0.0 for s in share}
    open_, left = {s for s in share if share[s] > 0 and most.get(s, 0) > 0}, total
    while open_ and left > 1e-9 * total:
        part = sum(share[s] for s in open_)
        give = {s: left * share[s] / part for s in open_}
        for s in list(open_):
            room = most[s] - size[s]
            if give[s] >= room:
                give[s] = room
                open_.discard(s)
            size[s] += give[s]
        left = total - sum(size.values())
    return size


def rake(cells: pd.DataFrame, sizes: dict[str, float], rounds: int = ROUNDS) -> np.ndarray:
    """Uses per document of each cell (its weight over its tokens), from cells with source, language, topic, tokens, most."""
    if not len(cells):
        return np.zeros(0)
    tokens = cells["tokens"].to_numpy(float)
    cap = tokens * cells["most"].to_numpy(float)
    total = sum(sizes.values())
    held = tokens.sum()
    w = tokens.copy()
    codes = {}
    for k in ("source", "language", "topic"):
        code, names = pd.factorize(cells[k])
        if k == "source":
            aim = np.array([sizes.get(s, 0.0) for s in names])
        else:
            aim = np.bincount(code, tokens, len(names)) * (total / held if held else 0)
        codes[k] = (code, aim)
    for _ in range(rounds):
        worst = 0.0
        for k in ("language", "topic", "source"):  # the sources' shares are met last
            code, aim = codes[k]
            now = np.bincount(code, w, len(aim))
            f = np.divide(aim, now, out=np.zeros_like(aim), where=now > 0)
            worst = max(worst, float(np.abs(f[aim > 0] - 1).max(initial=0)))
            w = np.minimum(w * f[code], cap)
        if worst < 1e-9:
            break
    code, aim = codes["source"]
    for _ in range(50):  # what caps took from a source goes to its other cells
        now = np.bincount(code, w, len(aim))
        f = np.divide(aim, now, out=np.zeros_like(aim), where=now > 0)
        if np.abs(f[aim > 0] - 1).max(initial=0) < 1e-9:
            break
        w = np.minimum(w * f[code], cap)
    return np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(records, report).

    records: doc_id, source, tokens, uses for every record used at least once. report: source, target_share,
    actual_share, target_tokens, actual_tokens, records, uses, available_tokens for every target. total_tokens: size
    wanted, by default what the sources with a target hold. A source may be used max_repeats times at most; what it then
    lacks is made up by the others in proportion to their shares. Sources without a target are not used, targets without
    documents are reported with 0. Null and empty texts, null doc_id and null source are never used; no documents
    give an empty mix.
    """
    spark = documents.sparkSession
    t = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]  # fixed table of targets
    share = {r["source"]: float(r["target_share"] or 0) for r in t}
    repeats = {r["source"]: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in t}
    docs = documents.where(F.col("source").isin(*share) & F.col("doc_id").isNotNull()).select(
        "doc_id", "source", language(F.col("lang")).alias("language"), F.coalesce(F.lower(F.trim("domain_hint")), F.lit("none")).alias("topic"), "text")
    sized = with_tokens(docs, ["doc_id", "source", "language", "topic"], tokenizer).where("tokens > 0")
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of source, language and topic")
    cells = cells.sort_values(["source", "language", "topic"], ignore_index=True)
    cells["most"] = cells["source"].map(repeats).fillna(0)
    held = cells.groupby("source")["tokens"].sum().to_dict()
    total = float(total_tokens if total_tokens is not None else sum(held.values()))
    sizes = source_sizes(share, {s: float(held[s]) * repeats[s] for s in held}, total)
    cells["rate"] = rake(cells, sizes)
    cells["buckets"] = np.maximum(1, -(-cells["docs"] // BUCKET)).astype(np.int64)
    cells["cell"] = np.arange(len(cells))
    table = spark.createDataFrame(cells[["source", "language", "topic", "cell", "rate", "buckets"]].astype({"cell": "int64", "rate": "float64"}) if len(cells) else [],
                                  "source string, language string, topic string, cell long, rate double, buckets long")
    h = F.xxhash64(F.lit(seed), "doc_id")
    drawn = (sized.join(F.broadcast(table), ["source", "language", "topic"])  # at most MOST_CELLS rows
             .withColumn("h", h).withColumn("bucket", F.pmod("h", F.col("buckets"))))
    sums = drawn.groupBy("cell", "bucket").agg(F.sum("rate").alias("part"))
    offsets = sums.select("cell", "bucket", (F.sum("part").over(Window.partitionBy("cell").orderBy("bucket")) - F.col("part")).alias("offset"))
    running = F.sum("rate").over(Window.partitionBy("cell", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.pmod(F.xxhash64(F.lit(seed), "cell"), F.lit(1000)) / 1000.0
    placed = drawn.withColumn("run", running).join(offsets, ["cell", "bucket"]).withColumn("end", F.col("offset") + F.col("run") + start)
    uses = F.floor(F.round("end", 6)) - F.floor(F.round(F.col("end") - F.col("rate"), 6))
    records = placed.select("doc_id", "source", "tokens", uses.cast("long").alias("uses")).where("uses > 0")
    wanted = spark.createDataFrame([(s, share[s], sizes[s], int(held.get(s, 0))) for s in share], "source string, target_share double, target_tokens double, available_tokens long")
    used = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"), F.count("*").alias("records"), F.sum("uses").alias("uses"))
    zero = F.lit(0).cast("long")
    r = wanted.join(used, "source", "left").select("source", "target_share", "target_tokens", "available_tokens", F.coalesce("actual_tokens", zero).alias("actual_tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("uses", zero).alias("uses"))
    all_tokens = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    return records, r.withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.nullif(all_tokens, zero), F.lit(0.0)))
