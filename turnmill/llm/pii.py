"""Personal information in free text: found by a character-level BiLSTM-CRF, replaced by typed placeholders.

The model is fitted to a bounded sample of rows (TRAIN_ROWS, the smallest by hash) whose spans patterns and cues label; it can be
saved, loaded and passed to every query. Every text is cut into windows at sentence ends, long ones into overlapping windows; all
are decoded, equal ones of a task once (digits are one symbol, letters with accents those without). What is decoded comes
out: of overlapping windows each place belongs to the one in which it lies more central, spans are reconciled over the whole
text by the heaviest set without overlaps, their limits moved to whole words without outer marks, and those without the
bare form of their entity (no "@" in an email, a digit in a name) refused. One narrow pass over all rows, no shuffle.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_rules import label_spans, spelled_digits
from .tagger import Tagger, encode, spans_of, tags_of, train

#: Rows of each table in the training sample.
TRAIN_ROWS = {"records": 1500, "pairs": 4000}
#: Training windows of the first round, with and without spans; the second round adds those of the sample decoded wrongly.
FIRST = {"with": 4500, "plain": 3000}
WINDOW, OVERLAP = 320, 64
TRAIN_WINDOW, TRAIN_OVERLAP = 160, 64
HIDDEN, EPOCHS = 20, 4

# over symbols: sentence ends, line ends and separators
_CUT = re.compile(rb"(?<=[0A-Za-z]{2}[.?!]) +|\n+| [|/] |; ")


def windows(symbols: bytes, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the windows: sentences, and overlapping stretches of long ones, cut between words.

    Every character but those of the cuts is in one; first to last (excluded) are the places that lie in no other more centrally.
    """
    out = []
    a = first = 0
    for e, after in [*(m.span() for m in _CUT.finditer(symbols)), (len(symbols), 0)]:
        while e - a > size:
            end = max(symbols.rfind(b" ", a + size - overlap // 4, a + size), a + size - overlap // 4)
            start = symbols.find(b" ", end - overlap, end - overlap * 3 // 4) + 1 or end - overlap
            mid = (start + end) // 2
            out.append((a, end, first, mid))
            a, first = start, mid
        if e > a:
            out.append((a, e, first, e))
        a = first = after
    return out


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The set of spans without overlaps of the greatest weight, found over the whole text; ties go to earlier ends."""
    s = sorted(set(spans), key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in s]
    best: list[float] = [0.0]
    take: list[bool] = []
    before: list[int] = []
    for k, x in enumerate(s):
        j = bisect_right(ends, x[0], 0, k)
        before.append(j)
        with_ = best[j] + x[3]
        take.append(with_ > best[k])
        best.append(max(best[k], with_))
    out, k = [], len(s)
    while k:
        if take[k - 1]:
            out.append(s[k - 1][:3])
            k = before[k - 1]
        else:
            k -= 1
    return out[::-1]


_MARKS = " \t\r\n\xa0,;:.!?\"'*|<>\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019"
_ABBREVIATED = re.compile(r"(?:(?<!\w)\w|str|avda|blvd|st|rd|ave)\.$", re.I)


def _limits(text: str, a: int, e: int, kind: str) -> tuple[int, int]:
    """The span from whole word to whole word, without outer spaces and marks."""
    while a < e and (text[a] in _MARKS or text[a] in "()[]{}" and kind != "phone" or text[a] in "-/"):
        a += 1
    while e > a and (text[e - 1] in _MARKS or text[e - 1] in "([{-/" or text[e - 1] in ")]}" and kind not in ("phone", "email")) and not (text[e - 1] == "." and _ABBREVIATED.search(text, a, e)):
        e -= 1
    if a < e:
        while a > 0 and text[a].isalnum() and (text[a - 1].isalnum() or (kind == "email" and text[a - 1] in "._+-" and a > 1 and text[a - 2].isalnum())):
            a -= 1
        while e < len(text) and text[e - 1].isalnum() and (text[e].isalnum() or (kind == "email" and text[e] in "._-@" and e + 1 < len(text) and text[e + 1].isalnum())):
            e += 1
        if kind == "phone" and text[a].isdigit() and a and text[a - 1] in "(+":
            a -= 1
    return a, e


_AT_WORD = re.compile(r"@|\bat\b|\barroba\b|\barobase\b", re.I)


def _form_ok(text: str, a: int, e: int, kind: str) -> bool:
    """Whether a decoded span has the bare form of its entity; a number behind letters and a hyphen is a reference."""
    s = text[a:e]
    if kind == "email":
        return bool(_AT_WORD.search(s)) and len(s) >= 6
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    if kind == "person":
        return letters >= 2 and not digits and not any(c in "[]@{}<>_" for c in s)
    if kind == "address":
        return digits >= 1 and letters >= 3
    if a > 1 and text[a - 1] in "-#" and text[a - 2].isalnum():
        return False
    if letters > 2:
        digits += spelled_digits(s)
    return 9 <= digits <= 15 if kind == "phone" else 6 <= digits <= 12


class Finder:
    """Finds mentions with a model; every different window is decoded, those of a task are kept (bounded) for equal ones."""

    KEEP = 200_000

    def __init__(self, model: Tagger) -> None:
        self.model = model
        self.known: dict[bytes, tuple] = {}

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        cut: list[list[tuple[int, int, int, int]]] = []
        keys: list[list[bytes]] = []
        new: dict[bytes, None] = {}
        for t in texts:
            symbols = encode(t).tobytes()
            ws = windows(symbols)
            ks = [symbols[a:e] for a, e, _, _ in ws]
            cut.append(ws)
            keys.append(ks)
            for k in ks:
                if k not in self.known:
                    new[k] = None
        for k, tags in zip(new, self.model.decode([np.frombuffer(k, np.uint8) for k in new])):
            self.known[k] = tuple((a, min(e, len(k)), kind) for a, e, kind in spans_of(tags)) if tags.any() else ()
        out = []
        for t, ws, ks in zip(texts, cut, keys):
            spans: list[tuple[int, int, str, float]] = []
            for j, ((a, e, first, last), k) in enumerate(zip(ws, ks)):
                for b, c, kind in self.known[k]:
                    b, c = a + b, a + c
                    if not first <= _limits(t, b, c, kind)[0] < last:
                        continue
                    if c == e and j + 1 < len(ws) and ws[j + 1][0] < e:  # cut by the window: the next one has its end
                        c = max([c, *(ws[j + 1][0] + y for x, y, other in self.known[ks[j + 1]] if other == kind and ws[j + 1][0] + x < c)])
                    b, c = _limits(t, b, c, kind)
                    if b < c and _form_ok(t, b, c, kind):
                        spans.append((b, c, kind, float(c - b)))
            out.append(reconcile(spans) if spans else [])
        if len(self.known) > self.KEEP:
            self.known = {}
        return out


def _fields(records: DataFrame | None, pairs: DataFrame | None) -> DataFrame:
    """field, row_id, item_pos, text of every place with text; null and empty texts and rows without row_id are left out."""
    parts = []
    if records is not None:
        r = records.select("row_id", "transcript", "notes", "turns")
        items = F.transform("turns", lambda t, i: F.struct(F.lit("call_records.turns.text").alias("field"), i.cast("long").alias("item_pos"), t["text"].alias("text")))
        one = [F.struct(F.lit(f"call_records.{c}").alias("field"), F.lit(0).cast("long").alias("item_pos"), F.col(c).alias("text")) for c in ("transcript", "notes")]
        parts.append(r.select("row_id", F.inline(F.concat(F.array(*one), F.coalesce(items, F.array().cast("array<struct<field:string,item_pos:bigint,text:string>>"))))))
    if pairs is not None:
        parts.append(pairs.select("row_id", F.lit("instruction_pairs.instruction").alias("field"), F.lit(0).cast("long").alias("item_pos"), F.col("instruction").alias("text")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("row_id").isNotNull() & (F.length("text") > 0)).select("field", F.col("row_id").cast("long").alias("row_id"), "item_pos", "text")


Windows = list[tuple[np.ndarray, np.ndarray]]


def labelled(texts: list[str]) -> tuple[Windows, Windows]:
    """(symbols, tags) of the different windows with spans and without, each list in an order by hash.

    A window with spans comes as it is and in lower case, as some transcripts are.
    """
    with_, plain, seen = [], [], set()
    for t in texts:
        symbols = encode(t)
        for a, e, _, _ in windows(symbols.tobytes(), TRAIN_WINDOW, TRAIN_OVERLAP):
            w, x = t[a:e], symbols[a:e]
            if (key := x.tobytes()) in seen:
                continue
            seen.add(key)
            if spans := label_spans(w):
                y = tags_of(len(w), spans)
                with_ += [(encode(v), y) for v in ({w, w.lower()} if len(w.lower()) == len(w) else {w})]
            else:
                plain.append((x, tags_of(len(w), [])))
    by_hash = lambda p: (zlib.crc32(p[0].tobytes()), p[0].tobytes())
    return sorted(with_, key=by_hash), sorted(plain, key=by_hash)


def learn(texts: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN) -> Tagger:
    """A model of the labelled windows of texts: a first round on FIRST of them, then two on half of these each and all windows of
    the texts that are still decoded wrongly, twice."""
    with_, plain = labelled(texts)
    first = with_[: FIRST["with"]] + plain[: FIRST["plain"]]
    model = train([x for x, _ in first], [y for _, y in first], hidden=hidden, epochs=epochs)
    rest, wrong = with_ + plain, []
    for half in (0, 1):
        wrong += [w for w, tags in zip(rest, model.decode([x for x, _ in rest])) if not np.array_equal(tags, w[1])]
        part = first[half::2] + 2 * wrong
        model = train([x for x, _ in part], [y for _, y in part], hidden=hidden, epochs=2, rate=0.008, model=model)
    return model


def fit(records: DataFrame, pairs: DataFrame, rows: dict[str, int] | None = None, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Parameters fitted to a bounded sample: `rows` of each table, the smallest by a hash of row_id.

    The sample goes to one task, which trains; only the parameters come to the driver.
    """
    parts = []
    for df, only, name in ((records.select("row_id", "transcript", "notes", "turns"), 0, "records"), (pairs.select("row_id", "instruction"), 1, "pairs")):
        part = df.where(F.col("row_id").isNotNull()).orderBy(F.xxhash64("row_id"), "row_id").limit((rows or TRAIN_ROWS)[name])
        parts.append(_fields(None if only else part, part if only else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        texts = pd.concat(frames).sort_values(["field", "row_id", "item_pos", "text"])["text"].tolist() if frames else []
        p = learn(texts, epochs).p
        yield pd.DataFrame({"name": list(p), "rows": [v.shape[0] for v in p.values()], "data": [v.astype(np.float32).tobytes() for v in p.values()]})

    got = parts[0].unionByName(parts[1]).repartition(1).mapInPandas(run, "name string, rows int, data binary").collect()
    shaped = lambda r: np.frombuffer(r["data"], np.float32).reshape((r["rows"], -1) if r["name"] not in "bs" else -1)
    return {r["name"]: shaped(r).copy() for r in got} or Tagger.new(HIDDEN, 5).p


def save_model(path: str, model: dict[str, np.ndarray]) -> None:
    np.savez(path, **model)


def load_model(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k] for k in f.files}


def mentions(records: DataFrame, pairs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """field, row_id, item_pos, start_pos, end_pos (code points, end excluded), entity of every mention.

    Whole texts of all rows are read. Null items and texts have none; rows without row_id are left out; each delivered
    row counts by itself. Without any row the model finds nothing.
    """
    p = model or fit(records, pairs)
    schema = "field string, row_id long, item_pos long, start_pos long, end_pos long, entity string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(Tagger(p))
        for b in batches:
            out = []
            for f, r, i, spans in zip(b["field"].tolist(), b["row_id"].tolist(), b["item_pos"].tolist(), finder.find(b["text"].tolist())):
                out += [(f, r, i, *s) for s in spans]
            yield pd.DataFrame(out, columns=["field", "row_id", "item_pos", "start_pos", "end_pos", "entity"])

    return _fields(records, pairs).mapInPandas(run, schema)


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with [EMAIL_1]-like placeholders: per entity numbered by first appearance of the mention's wording."""
    out, last, numbers, counts = [], 0, {}, {}
    for a, e, k in spans:
        key = (k, "".join(text[a:e].casefold().split()))
        if key not in numbers:
            counts[k] = counts.get(k, 0) + 1
            numbers[key] = counts[k]
        out += [text[last:a], f"[{k.upper()}_{numbers[key]}]"]
        last = e
    return "".join([*out, text[last:]])


def redacted(records: DataFrame, pairs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """field, row_id, item_pos, text, mentions: every text with placeholders for its mentions, nothing else changed."""
    p = model or fit(records, pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(Tagger(p))
        for b in batches:
            found = finder.find(b["text"].tolist())
            b["text"] = [placeholders(t, s) for t, s in zip(b["text"], found)]
            b["mentions"] = np.array([len(s) for s in found], np.int64)
            yield b

    return _fields(records, pairs).mapInPandas(run, "field string, row_id long, item_pos long, text string, mentions long")
