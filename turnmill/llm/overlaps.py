"""Records of evaluation splits that also stand in training, alike or nearly so.

A weighted cosine join. Words weigh by their rarity (document frequencies over all rows, counted in a table of fixed
size by hash, so what is sent around does not grow). In a pair that differs in at most EDITS words, each side keeps all
but EDITS of its words, hence at least the squared norm without its EDITS heaviest words: that is the bound an exact dot product
must reach. A side's words are ordered by weight; the two heaviest that a pair has in common stand among the EDITS + 2 heaviest of either
side, so inverted lists are kept for every two of these. Before texts meet in a list, what their dot product can be at most - the
two words and the smaller residual norm of the words behind them - is held against the bound. Exact dot products and word edits
decide at the end; the texts themselves travel once, the lists hold their hashes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import label_key
from ..tables import written

EDITS = 3
MIN_WORDS = 5
SLOTS = 1 << 16

_NOT_WORD = re.compile(r"[^\w]|_")


def plain_words(text: str | None) -> list[str]:
    """Words without letter case, accents and punctuation; what has no letter or digit is no word."""
    if not text:
        return []
    s = unicodedata.normalize("NFKD", text.casefold())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return [w for w in (_NOT_WORD.sub("", x) for x in s.split()) if w]


def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def word_edits(a: list[str], b: list[str], most: int) -> int:
    """Words changed, added or dropped between a and b; most + 1 stands for all above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]), far)
        row = new
    return row[-1]


_TEXTS = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("intent", T.StringType()), T.StructField("train", T.BooleanType()),
    T.StructField("split", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("words", T.StringType()), T.StructField("key", T.StringType()),
])


def _texts(pairs: DataFrame) -> DataFrame:
    """Rows that can be in a pair, their words joined by spaces; key: all letters in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [plain_words(t) for t in b["instruction"]]
            b["words"] = [" ".join(w) for w in ws]
            b["key"] = ["".join(w) for w in ws]
            yield b.loc[[len(w) >= MIN_WORDS for w in ws], [f.name for f in _TEXTS]]

    split = F.lower(F.trim("split"))
    return (pairs.select("row_id", label_key(F.col("intent")).alias("intent"), split.alias("split"), F.col("source"), "instruction")
            .where(F.col("row_id").isNotNull() & F.col("intent").isNotNull() & F.col("instruction").isNotNull() & split.isin("train", "dev", "test"))
            .withColumn("train", F.col("split") == "train").mapInPandas(run, _TEXTS))


def _weights(texts: DataFrame) -> np.ndarray:
    """Weight by slot of the hashed vocabulary, from the counts over all rows; SLOTS numbers whatever the input's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, rows = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for t in b["words"]:
                for w in set(t.split(" ")):
                    n[_slot(w)] += 1
                rows += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(n[at], rows)})

    counted = texts.select("words").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS)
    total = 0
    for slot, n in zip(counted["slot"], counted["n"]):
        if slot < 0:
            total = n
        else:
            df[slot] = n
    return np.log1p((total + 1) / (df + 1)).astype(np.float64)


_POSTED = T.StructType([
    T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()), T.StructField("train", T.BooleanType()), T.StructField("eval", T.BooleanType()),
    T.StructField("list", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("head", T.FloatType()), T.StructField("rest", T.FloatType()), T.StructField("least", T.FloatType()),
])


def _posted(sides: DataFrame, weight: np.ndarray, edits: int) -> DataFrame:
    """The lists of each text: intent and two words; head: their squared weights, rest: those of the words behind, least: the bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h1, h2, train, ev, intent, words, key in zip(b["h1"].tolist(), b["h2"].tolist(), b["train"].tolist(), b["eval"].tolist(), b["intent"], b["words"], b["key"]):
                ws = words.split(" ")
                seen: dict[str, int] = {}
                tokens = []
                for w in ws:  # a repeated word is another token each time
                    seen[w] = seen.get(w, 0) + 1
                    tokens.append((-weight[_slot(w)], w, seen[w]))
                tokens.sort()
                sq = [t[0] ** 2 for t in tokens]
                total, least = sum(sq), sum(sq[edits:])
                first, behind = tokens[: edits + 2], total - np.cumsum(sq)
                for j in range(1, len(first)):
                    for i in range(j):
                        name = f"{intent}\t{first[i][1]} {first[i][2]}\t{first[j][1]} {first[j][2]}"
                        out.append((h1, h2, train, ev, name, len(ws), sq[i] + sq[j], behind[j], least))
                out.append((h1, h2, train, ev, f"{intent}\t={key}", -1, 0.0, 0.0, -1.0))  # alike but for spacing, whatever the number of words
            yield pd.DataFrame(out, columns=[f.name for f in _POSTED])

    named = sides.mapInPandas(run, _POSTED)
    return named.select("h1", "h2", "train", "eval", F.xxhash64("list").alias("l1"), F.hash("list").alias("l2"), "n", "head", "rest", "least")


def _met(posted: DataFrame, edits: int) -> DataFrame:
    """a1, a2, b1, b2: hashes of the texts that meet in a list and can reach the bound.

    Lists are cut by the number of words, so that two common words of a hot intent are many lists.
    """
    step = edits + 1
    at = F.when(F.col("n") < 0, F.lit(-1)).otherwise(F.floor(F.col("n") / step)).cast("int")
    left = posted.where("train").select("l1", "l2", at.alias("part"), *[F.col(c).alias(f"{c}_a") for c in ("h1", "h2", "n", "head", "rest", "least")])
    around = F.when(F.col("n") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.floor((F.col("n") - edits) / step).cast("int"), F.floor((F.col("n") + edits) / step).cast("int")))
    right = posted.where("eval").select("l1", "l2", F.explode(around).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("h1", "h2", "n", "rest", "least")])
    # a word's weight is the same on either side; the bounds are single precision, hence the allowance
    reach = (F.col("head_a") + F.least("rest_a", "rest_b")) * 1.0001 >= F.greatest("least_a", "least_b")
    return (left.join(right, ["l1", "l2", "part"]).where((F.abs(F.col("n_a") - F.col("n_b")) <= edits) & reach)
            .select(F.col("h1_a").alias("a1"), F.col("h2_a").alias("a2"), F.col("h1_b").alias("b1"), F.col("h2_b").alias("b2")).distinct())


def cross_split_pairs(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """row_a, row_b (smaller first), edits, cosine: every pair of a train row and a dev or test row of one intent whose
    instructions (MIN_WORDS words or more) are equal but for case, accents, punctuation and spacing, or differ besides
    in at most `edits` words.

    Rows without row_id, intent, split or instruction and shorter ones are in no pair. Each row counts by itself;
    equal texts are compared once and joined to their rows at the end. An empty table gives no pair. At most MIN_WORDS - 2 edits.
    """
    if edits > MIN_WORDS - 2:
        raise ValueError(f"at most {MIN_WORDS - 2} edits: two words must stay in common")
    texts = written(pairs.sparkSession, _texts(pairs).select("*", F.xxhash64("intent", "words").alias("h1"), F.hash("intent", "words").alias("h2")), "words")
    weight = _weights(texts)
    # one row for each different text
    sides = texts.groupBy("h1", "h2").agg(F.any_value("intent").alias("intent"), F.any_value("words").alias("words"), F.any_value("key").alias("key"), F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"))
    met = _met(_posted(sides, weight, edits), edits)
    scored_schema = "a1 long, a2 int, b1 long, b2 int, edits int, cosine double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a1, a2, b1, b2, wa, wb in zip(b["a1"].tolist(), b["a2"].tolist(), b["b1"].tolist(), b["b2"].tolist(), b["words_a"], b["words_b"]):
                a, c = wa.split(" "), wb.split(" ")
                va, vb, heavy = {}, {}, []
                for ws, v in ((a, va), (c, vb)):
                    for w in ws:
                        v[w] = v.get(w, 0) + 1
                    sq = sorted((weight[_slot(w)] ** 2 for w in ws), reverse=True)
                    heavy.append((sum(sq), sum(sq[:edits])))
                dot = sum(min(k, vb[w]) * weight[_slot(w)] ** 2 for w, k in va.items() if w in vb)
                cosine = dot / (heavy[0][0] * heavy[1][0]) ** 0.5
                alike = wa.replace(" ", "") == wb.replace(" ", "")
                if not alike and dot < max(s - h for s, h in heavy) - 1e-9:
                    continue
                e = 0 if alike else word_edits(a, c, edits)
                if e <= edits:
                    out.append((a1, a2, b1, b2, e, round(cosine, 6)))
            yield pd.DataFrame(out, columns=["a1", "a2", "b1", "b2", "edits", "cosine"])

    of = lambda x: sides.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("words").alias(f"words_{x}"))
    scored = met.join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"]).mapInPandas(score, scored_schema)
    ra = texts.where("train").select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("row_id").alias("ra"))
    rb = texts.where("not train").select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("row_id").alias("rb"))
    return (scored.join(ra, ["a1", "a2"]).join(rb, ["b1", "b2"])
            .select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"),
                    F.col("ra").alias("train_row"), F.col("rb").alias("eval_row"), "edits", "cosine"))


def overlap_report(pairs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per split and source of the evaluation row: rows, rows with a partner in train, pairs, exact pairs."""
    rows = pairs.select(F.col("row_id").alias("eval_row"), F.lower(F.trim("split")).alias("split"), "source").where(F.col("split").isin("dev", "test"))
    linked = cross_split_pairs(pairs, edits).groupBy("eval_row").agg(F.count("*").alias("pairs"), F.count_if(F.col("edits") == 0).alias("exact"))
    return (rows.join(linked, "eval_row", "left").groupBy("split", "source")
            .agg(F.count("*").alias("rows"), F.count("pairs").alias("overlapping_rows"),
                 F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_pairs")))
