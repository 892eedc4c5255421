"""Long spans that stand verbatim in more than one document.

Two documents that share a passage of LEAST characters share the smallest hashed K-gram of one of its windows (K + W - 1
= LEAST), so texts meet only where they share such an anchor. The stretches around a shared anchor, which hold the windows of
LEAST characters whose smallest K-gram it is, form a group, equal stretches once. Groups are packed into shards; each shard is a compressed FM-index (a
wavelet tree over the Burrows-Wheeler transform), and its stretches are streamed through backward search, which reports those
that match another document over LEAST characters or more. A group of one stretch that many documents carry is shared as it is. Anchors
in more than HOT documents are cut into their windows of LEAST characters and met by 128-bit hashes of these, so no group holds
more than HOT stretches. The join of anchors is salted, that of stretches is left to the skew join of adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex

LEAST = 200
K, W = 100, 101
HOT = 2000
#: Parts of the rows of one anchor in the join.
SALTS = 4
#: Characters after which a shard's index is built.
SHARD_CHARS = 1_000_000
#: Characters of short texts that are hashed at once.
TOGETHER = 1 << 15

_B = 0x9E3779B97F4A7C15  # odd


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64."""
    p = np.array([[_B], [pow(_B, -1, 1 << 64)]], np.uint64).repeat(n + 1, axis=1)
    p[:, 0] = 1
    return np.cumprod(p, axis=1, dtype=np.uint64)


def _gram_hashes(a: np.ndarray, powers: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every k-gram: polynomial prefix sums, brought to the power 0, then mixed."""
    n = len(a)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(salt)) * powers[0, :n], out=h[1:])
    m = n - k + 1
    x = (h[k:] - h[:-k]) * powers[1, :m]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


_POSITION = (1 << 24) - 1


def anchors(a: np.ndarray, lengths: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash, first and last window with it) of the smallest K-gram of each window of W K-grams;
    leftmost among equals.

    a holds texts of LEAST characters or more, one behind the other; no window reaches into the next text.
    """
    h = _gram_hashes(a, powers, K)
    m = len(h)
    v = (h & np.uint64(~_POSITION & 0xFFFFFFFFFFFFFFFF)) | (np.arange(m, dtype=np.uint64) & np.uint64(_POSITION))
    size = 1
    while size * 2 <= W:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if W > size:
        v = np.minimum(v[: len(v) - (W - size)], v[W - size :])
    ends = np.cumsum(lengths)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[ends[:-1]] = True
    beyond = np.zeros(len(a) + 1, np.int8)
    beyond[ends - (LEAST - 1)] = 1
    beyond[ends] = -1
    runs = np.flatnonzero(new)
    keep = np.cumsum(beyond, dtype=np.int8)[runs] == 0
    at, after = runs[keep], np.append(runs[1:], len(v))[keep]
    # the position's upper part is that of the window
    low = (v[at] & np.uint64(_POSITION)).astype(np.int64)
    pos = at + ((low - at) & _POSITION)
    text = np.searchsorted(ends, at, side="right")
    begin = (ends - lengths)[text]
    return text, pos - begin, h[pos].view(np.int64), at - begin, np.minimum(after - 1, ends[text] - LEAST) - begin


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """hash, doc_id, run (the first window with the anchor and, in the lowest eight bits, the number of those behind it)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _powers(2 * TOGETHER)
        for b in batches:
            docs, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            lengths = np.array([len(t) for t in texts], np.int64)
            many = np.flatnonzero(lengths >= LEAST)
            # texts of about TOGETHER characters at a time
            part = np.cumsum(lengths[many]) // TOGETHER
            ids, runs, hs = [], [], []
            for i in np.split(many, np.flatnonzero(np.diff(part)) + 1):
                if not len(i):
                    continue
                a = _points("".join([texts[k] for k in i]))
                if len(a) + 1 > powers.shape[1]:
                    powers = _powers(2 * len(a))
                t, _, h, first, last = anchors(a, lengths[i], powers)
                ids.append(docs[i[t]])
                runs.append(first << 8 | (last - first))
                hs.append(h)
            if ids:
                yield pd.DataFrame({"hash": np.concatenate(hs), "doc_id": np.concatenate(ids), "run": np.concatenate(runs)})

    return docs.mapInPandas(run, "hash long, doc_id long, run long")


def _salted(rows: DataFrame, met: DataFrame) -> DataFrame:
    """rows joined to met by hash; rows of a hot hash are spread over SALTS tasks, the other side is repeated for each."""
    met = met.withColumnRenamed("hash", "met").withColumn("salt", F.explode(F.lit(list(range(SALTS))).cast("array<bigint>")))
    return rows.join(met, (F.col("hash") == F.col("met")) & (F.pmod("doc_id", F.lit(SALTS).cast("long")) == F.col("salt"))).drop("met", "salt")


def _cut(docs: DataFrame, meetings: DataFrame) -> DataFrame:
    """r (the anchor), doc_id, start, text (null for the windows of hot anchors, whose r is their first hash), check."""
    per_doc = meetings.groupBy("doc_id").agg(F.collect_list(F.struct("run", "hash", "hot")).alias("at"))
    schema = "r long, doc_id long, start int, text string, check long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _powers(1 << 14)
        for b in batches:
            rs, ids, starts, texts, checks = [], [], [], [], []
            for doc, text, at in zip(b["doc_id"].tolist(), b["text"].tolist(), b["at"]):
                windows: set[int] = set()
                for x in at:
                    a = x["run"] >> 8
                    last = a + (x["run"] & 255)
                    if x["hot"]:
                        windows.update(range(a, last + 1))
                    else:
                        rs.append(x["hash"]), ids.append(doc), starts.append(a), texts.append(text[a : last + LEAST]), checks.append(0)
                if windows:
                    pts = _points(text)
                    if len(pts) + 1 > powers.shape[1]:
                        powers = _powers(2 * len(pts))
                    h1, h2 = _gram_hashes(pts, powers, LEAST), _gram_hashes(pts, powers, LEAST, 0x51ED27)
                    w = np.array(sorted(windows), np.int64)
                    rs += h1[w].view(np.int64).tolist()
                    checks += h2[w].view(np.int64).tolist()
                    ids += [doc] * len(w)
                    starts += w.tolist()
                    texts += [None] * len(w)
            yield pd.DataFrame({"r": np.array(rs, np.int64), "doc_id": np.array(ids, np.int64), "start": np.array(starts, np.int32), "text": pd.Series(texts, dtype=object), "check": np.array(checks, np.int64)})

    return docs.join(per_doc, "doc_id").mapInPandas(run, schema)


def _search(stretches: DataFrame) -> DataFrame:
    """r, k1, k2, a, e: covered parts of each different stretch, found by backward search in its shard; a window without
    text is covered whole where it stands in several documents."""
    schema = "r long, k1 long, k2 long, a int, e int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: list[tuple]) -> pd.DataFrame:
            texts = [_points(t[2]) for t in rows]
            index = FMIndex(texts, np.array([t[3] for t in rows]), np.array([t[4] for t in rows], bool))
            t, a, e = index.shared_passages(LEAST)
            return pd.DataFrame({"r": np.array([rows[k][0] for k in t], np.int64), "k1": np.array([rows[k][1][0] for k in t], np.int64), "k2": np.array([rows[k][1][1] for k in t], np.int64), "a": a.astype(np.int32), "e": e.astype(np.int32)})

        held: list[tuple] = []  # whole groups of two stretches or more
        group: list[tuple] = []
        chars = 0
        for b in batches:
            alone: list[tuple] = []
            for row in [*zip(b["r"].tolist(), zip(b["k1"].tolist(), b["k2"].tolist()), b["text"].tolist(), b["owner"].tolist(), b["multi"].tolist())]:
                if row[2] is None:
                    alone.append(row)
                    continue
                if group and row[0] != group[0][0]:
                    if len(group) == 1:
                        alone += group
                    else:
                        held += group
                        chars += sum(len(x[2]) for x in group)
                    group = []
                    if chars >= SHARD_CHARS:
                        yield found(held)
                        held, chars = [], 0
                group.append(row)
            yield whole(alone)
        if len(group) == 1:
            yield whole(group)
            group = []
        if held or group:
            yield found(held + group)

    def whole(rows: list[tuple]) -> pd.DataFrame:
        rows = [(r, *k, LEAST if text is None else len(text)) for r, k, text, _, multi in rows if multi]
        r, k1, k2, e = np.array([x for x in rows if x[3] >= LEAST], np.int64).reshape(-1, 4).T
        return pd.DataFrame({"r": r, "k1": k1, "k2": k2, "a": np.zeros(len(r), np.int32), "e": e.astype(np.int32)})

    # few bytes for much work: the number of tasks is given, so that adaptive execution doesn't join them by bytes
    tasks = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stretches.repartition(tasks, "r").sortWithinPartitions("r").mapInPandas(run, schema)


def shared_passages(documents: DataFrame) -> DataFrame:
    """doc_id, start, end: maximal stretches (code points, end excluded) covered by passages of LEAST characters or more
    that also stand in another document.

    Null and shorter texts share nothing, rows without doc_id are left out, rows of one doc_id are one document. Texts
    are compared as they are, whole. An empty table gives no row.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= LEAST))
    rows = _anchor_rows(docs)
    met = (rows.groupBy("hash").agg(F.min("doc_id").alias("r"), F.max("doc_id").alias("other"), F.count("*").alias("n"))
           .where("r < other").select("hash", (F.col("n") > HOT).alias("hot")))
    cut = _cut(docs, _salted(rows, met).select("doc_id", "run", "hash", "hot"))
    # 128 bits name a stretch
    named = cut.withColumns({"k1": F.when(F.col("text").isNull(), F.col("check")).otherwise(F.xxhash64("text")), "k2": F.coalesce(F.shiftleft(F.hash("text").cast("long"), 32) + F.crc32(F.encode("text", "UTF-8")), F.lit(0))})
    stretches = (named.groupBy("r", "k1", "k2").agg(F.first("text").alias("text"), F.min("doc_id").alias("owner"), (F.min("doc_id") < F.max("doc_id")).alias("multi"))
                 .where(F.col("text").isNotNull() | F.col("multi")))
    hits = _search(stretches)  # windows of hot anchors go through, so that the stretches are cut and shuffled once
    spans = named.select("r", "k1", "k2", "doc_id", "start").join(hits, ["r", "k1", "k2"]).select("doc_id", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("e")).alias("e"))
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "e"))),
        F.array().cast("array<struct<a:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["a"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(x))))
    return (spans.groupBy("doc_id").agg(merged.alias("m")).select("doc_id", F.inline("m"))
            .select("doc_id", F.col("a").alias("start"), F.col("e").alias("end")))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document with a shared passage."""
    return shared_passages(documents).select("doc_id").distinct()


def shared_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, passages, shared_chars, shared_ratio for every document; 0 where nothing is shared."""
    s = shared_passages(documents).groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_chars")).join(s, "doc_id", "left")
            .select("doc_id", "n_chars", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
            .withColumn("shared_ratio", F.when(F.col("n_chars") > 0, F.bround(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))))
