"""Raw speech transcripts into clean speaker turns.

A record's pieces are its lines (or items) with a label; lines without one continue the piece above. Labels that mean
one speaker are clustered by union-find over initials and string similarity within the record, each cluster has one
canonical label and role, and neighbouring pieces of one role become one turn. Records are independent, so this is one
narrow pass: no shuffle, memory bounded by the longest record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What labels mean.
ROLES = {
    "customer": "caller", "caller": "caller", "client": "caller", "user": "caller", "member": "caller",
    "bot": "bot", "system": "bot", "ivr": "ivr",
    "agent": "human_agent", "advisor": "human_agent", "rep": "human_agent", "representative": "human_agent", "operator": "human_agent",
    "csr": "human_agent", "support agent": "human_agent", "human agent": "human_agent", "support": "human_agent", "assistant": "human_agent",
    "customer service representative": "human_agent", "specialist": "human_agent", "supervisor": "human_agent", "adviser": "human_agent",
}
SIMILAR = 0.8

_STAMP = re.compile(
    r"^\s*(?:[\[(<{]\s*(?P<a>(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*s?)\s*[\])>}]|(?P<b>(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?))"
    r"(?:\s*-->\s*(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?)?(?:\s+|$)")
_LABEL_WORD = r"[^\W\d_][\w .'’-]{0,38}?(?:\s*\([^()\n]{1,24}\))?"
_LABELS = (
    re.compile(rf"^\s*\*\*\s*(?P<l>{_LABEL_WORD}|\d{{1,3}})\s*:?\s*\*\*\s*[:>-]?\s*"),
    re.compile(rf"^\s*\[\s*(?P<l>{_LABEL_WORD}|\d{{1,3}})\s*\]\s*[:>-]?\s*"),
    re.compile(rf"^\s*(?P<l>{_LABEL_WORD}|\d{{1,3}})\s*(?::|>)(?:\s+|$)"),
    re.compile(rf"^\s*(?P<l>{_LABEL_WORD}|\d{{1,3}})\s+[-–—](?:\s+|$)"),
)
#: Lines may stand under each other, or on one line behind bars or wide gaps.
_BREAK = re.compile(r"\r\n|\n|\r|\s+\|\s+|[ \t]{2,}")
_ANON = re.compile(r"^(?:speaker|spk|participant|channel|ch|s|p)?[\s_-]*(?:\d{1,3}|[a-z])$")
_GREETS = re.compile(
    r"thank(?:s| you) for (?:calling|holding|contacting|waiting)|(?:how|what) (?:can|may) i (?:help|do|direct)|how may i|you are through to|you're through to|welcome to|speaking from|this line is answered|this is .{1,40} from", re.I)
_SOUND = re.compile(r"\(\([^()\n]*\)\)|\[(?!\s*(?:at|dot)\s*\])[^\[\]\n]*[^\W\d_][^\[\]\n]*\]|\((?!\s*(?:at|dot)\s*\))[^()\n\d]+\)|<[^<>\n]*[^\W\d_][^<>\n]*>|\{[^{}\n]*\}|(?<![\w*])\*[^*\n]+\*(?![\w*])|♪[^♪\n]*♪?|♫[^♫\n]*♫?")
_TAIL_STAMP = re.compile(r"\s*[\[(<]\s*(?:(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*s)\s*[\])>]\s*$")
_FILLER = r"(?:u+h+[- ]?h+u+h+|m+[- ]?h+m+|u+h*m+|u+h+|e+r+m*|e+h+m*|a+h+|h+m+|m{2,}|h+u+h+|u+)"
_FILLERS = re.compile(rf"(?<![\w'-]){_FILLER}(?![\w'-])(?:\s*(?:,|\.\.\.|…))?", re.I)
#: Phrases that fill between commas or before dots.
_PHRASES = re.compile(r"(?:(?<=,)|(?<=^)|(?<=[.!?…]))\s*(?:you know|i mean)\s*(?:,|\.\.\.|…)", re.I | re.M)


def label_key(label: str) -> str:
    """A label in lower case without what surrounds it; of "Name (Role)" the role if it is one."""
    s = re.sub(r"[\s_]+", " ", label.strip().strip(":>*[]").strip()).casefold()
    if m := re.match(r"^(.*?)\s*\(([^()]*)\)$", s):
        inner = m[2].strip()
        return inner if inner in ROLES or _ANON.match(inner) else m[1].strip() or inner
    return s


def seconds(stamp: str) -> float:
    s = stamp.replace(",", ".").strip().rstrip("s").strip()
    out = 0.0
    for part in s.split(":"):
        out = out * 60 + float(part)
    return out


def initials(label: str) -> str:
    return "".join(w[0] for w in label.split())


def similarity(a: str, b: str) -> float:
    """One minus the edits between two labels over the longer one's length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def cluster_labels(keys: list[str]) -> dict[str, str]:
    """Each label's canonical one: union-find over equal initials ("csr"), beginnings ("rep") and similar spellings.

    Numbered or lettered labels differ by that alone and stay apart, and so do labels of known, different roles. The canonical
    one is that with a known role, else the longest, else the first by alphabet.
    """
    names = sorted(set(keys))
    parent = {k: k for k in names}

    def root(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def one(a: str, b: str) -> bool:
        if _ANON.match(a) or _ANON.match(b):
            return re.sub(r"[\s_-]", "", a) == re.sub(r"[\s_-]", "", b)
        short, long_ = sorted((a, b), key=len)
        if a in ROLES and b in ROLES:
            return ROLES[a] == ROLES[b] and (long_.startswith(short) or " " in long_ and initials(long_) == short)
        return (len(short) > 1 and " " in long_ and initials(long_) == short) or (len(short) >= 3 and long_.startswith(short)) or similarity(a, b) >= SIMILAR

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ra, rb = root(a), root(b)
            if ra != rb and one(a, b) and not (ra in ROLES and rb in ROLES and ROLES[ra] != ROLES[rb]):
                keep, gone = sorted((ra, rb), key=lambda k: (k not in ROLES, -len(k), k))
                parent[gone] = keep
    return {k: root(k) for k in names}


def clean(text: str) -> str:
    """Speech only: sounds, stamps at the end and fillers are taken out."""
    s = text
    while True:
        t = _TAIL_STAMP.sub("", _SOUND.sub(" ", s))
        if t == s:
            break
        s = t
    s = _FILLERS.sub(" ", _PHRASES.sub(" ", s))
    s = re.sub(r"\s+([,.;:!?…])", r"\1", s)
    s = re.sub(r"([,;:])(?:\s*[,;:])+", r"\1", s)
    s = re.sub(r"^[\s,.;:…-]+(?=[^\s])", "", re.sub(r"\s+", " ", s)).strip()
    return s if re.search(r"\w", s) else ""


def _is_label(label: str, marked: bool) -> bool:
    key = label_key(label)
    if key in ROLES or _ANON.match(key):
        return True
    inner = re.search(r"\(([^()]*)\)\s*$", label)
    if inner and inner[1].strip().casefold() in ROLES:
        return True
    # other labels: marked ones of up to three words, each with a capital
    return marked and len(key.split()) <= 3 and all(w[:1].isupper() for w in label.split())


def split_label(line: str) -> tuple[str | None, str]:
    """(label, rest) of a line; no label where the line has none."""
    for k, p in enumerate(_LABELS):
        m = p.match(line)
        if m and _is_label(m["l"], k == 0):
            return m["l"], line[m.end() :]
    return None, line


def _pieces_of_text(transcript: str) -> list[list]:
    """[stamp, label, text] of the lines; a stamp alone belongs to the next line."""
    out: list[list] = []
    waiting: float | None = None
    for line in _BREAK.split(transcript):
        stamp = None
        if m := _STAMP.match(line):
            stamp, line = seconds(m["a"] or m["b"]), line[m.end() :]
        if not line.strip():
            waiting = stamp if stamp is not None else waiting
            continue
        if stamp is None:
            stamp = waiting
        waiting = None
        label, rest = split_label(line)
        if label is None and out:
            out[-1][2] += "\n" + rest
        else:
            out.append([stamp, label, rest])
    return out


def _pieces_of_items(items: list) -> list[list]:
    out: list[list] = []
    for x in items:
        text = (x["text"] if x is not None else None) or ""
        speaker = ((x["speaker"] if x is not None else None) or "").strip()
        stamp = None
        if m := _STAMP.match(text):
            stamp, text = seconds(m["a"] or m["b"]), text[m.end() :]
        label = speaker or None
        if label is None:
            label, text = split_label(text)
        elif (other := split_label(text))[0] and label_key(other[0]) == label_key(label):
            text = other[1]
        if label is None and out:
            out[-1][2] += "\n" + text
        else:
            out.append([stamp, label, text])
    return out


def turns_of(transcript: str | None, items: list | None) -> list[tuple[str, str, str]]:
    """(role, canonical label, text) of the clean turns, in order."""
    pieces = _pieces_of_items(items) if items is not None and len(items) else _pieces_of_text(transcript or "")
    if pieces and all(p[0] is not None for p in pieces):
        pieces.sort(key=lambda p: p[0])
    keys = [label_key(p[1]) if p[1] is not None else "" for p in pieces]
    canon = cluster_labels([k for k in keys if k])
    anon = {canon[k] for k in keys if k and _ANON.match(k)}
    greeter = next((canon[k] for k, p in zip(keys, pieces) if k and canon[k] in anon and _GREETS.search(p[2])), None)
    if greeter is None and anon:  # nobody greets: the one who speaks first
        greeter = next(canon[k] for k in keys if k and canon[k] in anon)
    out: list[list] = []
    for k, p in zip(keys, pieces):
        text = clean(p[2])
        if not text:
            continue
        c = canon.get(k, "")
        role = ("human_agent" if c == greeter else "caller") if c in anon else ROLES.get(c, "human_agent") if c else "caller"
        if out and out[-1][0] == role:
            out[-1][2] += " " + text
        else:
            out.append([role, c or "unlabelled", text])
    return [tuple(t) for t in out]


def speaker_turns(records: DataFrame) -> DataFrame:
    """row_id, turn_no (from 0), speaker (caller, human_agent, bot, ivr), label (canonical), text.

    A record's `turns` count if it has any, else its `transcript`; with neither, or only sounds and fillers, it has no
    turn. Null items, labels and texts are taken as empty. Lines before any label are the caller's. Every delivered row
    counts by itself; rows without row_id are kept with null. An empty table gives no row.
    """
    schema = "row_id long, turn_no long, speaker string, label string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(None if pd.isna(row) else row, k, *t) for row, tr, items in zip(b["row_id"], b["transcript"], b["turns"]) for k, t in enumerate(turns_of(tr, items))]
            d = pd.DataFrame(out, columns=["row_id", "turn_no", "speaker", "label", "text"])
            d["row_id"] = d["row_id"].astype("Int64")
            yield d

    return records.select("row_id", "transcript", "turns").mapInPandas(run, schema)


def turn_report(records: DataFrame) -> DataFrame:
    """Per speaker: records, turns and characters of clean speech."""
    return (speaker_turns(records).groupBy("speaker")
            .agg(F.countDistinct("row_id").alias("records"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("characters")))
