"""Sources: conversation files of several layouts into flat or nested DataFrames."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_slug, is_blank, number, strip

# Speakers of scripts and dialogue files that are callers, and the words that name a speaker before a line.
CALLERS = ("customer", "caller", "client", "user", "member")
SPEAKERS = "agent|advisor|rep|representative|operator|bot|ivr|system|customer|caller|client|user|member"
#: A speaker in brackets needs no separator, a bare one a colon, hyphen or en dash.
PREFIX = rf"(?i)^\s*(?:[\[(]\s*({SPEAKERS})\s*[\])]\s*[:\-\x{{2013}}]?\s*|({SPEAKERS})\s*[:\-\x{{2013}}]\s*)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def role_of(speaker: Column) -> Column:
    s = F.lower(strip(speaker))
    return F.when(s.isin(*CALLERS), "caller").when(s == "ivr", "ivr").when(s.isin("bot", "system"), "bot").otherwise("human_agent")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, v (VARIANT): objects of JSON-lines files and of JSON-array files alike; other items and blank lines are skipped.

    A file that begins with "[" is one array; unreadable lines give no row.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    array = F.ltrim("value").startswith("[")
    parts = F.when(array, F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v: F.struct(v.alias("v")))).otherwise(
        F.transform(F.split("value", r"\r?\n"), lambda line: F.struct(F.try_parse_json(line).alias("v"))))
    return whole.select("file", F.posexplode(parts).alias("idx", "x")).select("file", "idx", F.col("x.v").alias("v")).where(F.substring(F.schema_of_variant("v"), 1, 6) == "OBJECT")


def script_lines(script: Column) -> Column:
    """array of (speaker, text): the lines of a script that say something; without a speaker's name before it the caller speaks."""
    lines = F.filter(F.transform(F.split(script, LINE_END), strip), lambda x: x != "")

    def turn(line: Column) -> Column:
        who = F.coalesce(F.nullif(F.regexp_extract(line, PREFIX, 1), F.lit("")), F.nullif(F.regexp_extract(line, PREFIX, 2), F.lit("")))
        return F.struct(F.when(who.isNull(), "caller").otherwise(role_of(who)).alias("speaker"), strip(F.regexp_replace(line, PREFIX, "")).alias("text"))

    return F.filter(F.transform(lines, turn), lambda t: t["text"] != "")


def script_turns(df: DataFrame, key: str, script: str) -> DataFrame:
    """key, turn, speaker, text: see script_lines."""
    return df.select(F.col(key), F.posexplode(script_lines(F.col(script))).alias("turn", "t")).select(key, "turn", "t.speaker", "t.text")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """record_id, turn, speaker, text, category, intent: an instruction and its response per row; blank rows are skipped
    but counted in the row index of their file."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cols = {c.lower(): c for c in df.columns}
    first = lambda names: F.coalesce(*[F.when(~is_blank(F.col(cols[n])), F.col(cols[n])) for n in names if n in cols], F.lit(None).cast("string"))
    said = first(("instruction", "utterance", "query", "text"))
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    # a file is read by one task, one row after the other: its rows count from the first one's number
    at = Window.partitionBy("file")
    d = df.select(F.monotonically_increasing_id().alias("id"), F.input_file_name().alias("file"), stem.alias("stem"), said.alias("said"), first(("response",)).alias("response"), first(("category",)).alias("category"), first(("intent",)).alias("intent"))
    d = d.withColumn("row", F.col("id") - F.min("id").over(at))
    turns = F.array_compact(F.array(F.struct(F.lit("caller").alias("speaker"), F.col("said").alias("text")), F.when(F.col("response").isNotNull(), F.struct(F.lit("human_agent").alias("speaker"), F.col("response").alias("text")))))
    return (d.where(F.col("said").isNotNull()).select(F.concat_ws(":", "stem", "row").alias("record_id"), ascii_slug(F.col("category")).alias("category"), ascii_slug(F.col("intent")).alias("intent"), F.posexplode(turns).alias("turn", "t"))
            .select("record_id", "turn", "t.speaker", "t.text", "category", "intent"))


def mapped_csv(spark: SparkSession, path: str, mapping: dict[str, str], delimiter: str = ",") -> DataFrame:
    """conversation_id, speaker, text, start_ms, end_ms of a CSV whose columns `mapping` names; blank texts are dropped,
    negative and unreadable times become null."""
    df = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)
    col = lambda n: F.col(mapping[n]) if mapping.get(n) in df.columns else F.lit(None).cast("string")
    ms = lambda n: F.when(number(col(n)) >= 0, F.bround(number(col(n))).cast("long"))
    return df.select(col("conversation_id").alias("conversation_id"), role_of(col("speaker")).alias("speaker"), strip(col("text")).alias("text"), ms("start_ms").alias("start_ms"), ms("end_ms").alias("end_ms")).where(~is_blank(F.col("text")))


def zipped_words(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, record_id, i, text, start_ms, end_ms: words of JSON transcripts in ZIP files; folders, hidden and
    unreadable members are skipped. record_id is "aix-" and 16 digits of the sha256 of "archive/member"."""
    schema = "archive string, member string, i int, text string, start_ms double, end_ms double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                name, out = p.rsplit("/", 1)[-1], []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(z.namelist()):
                        if "__MACOSX" in m or not m.lower().endswith(".json"):
                            continue
                        try:
                            words = json.loads(z.read(m)).get("words") or []
                        except (ValueError, AttributeError):
                            continue
                        for i, w in enumerate(words):
                            if isinstance(w, dict) and str(w.get("text") or "").strip():
                                out.append((name, m, i, str(w["text"]).strip(), w.get("start"), w.get("end")))
                yield pd.DataFrame(out, columns=["archive", "member", "i", "text", "start_ms", "end_ms"])

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, schema)
    return d.withColumn("record_id", F.concat(F.lit("aix-"), F.substring(F.sha2(F.concat_ws("/", "archive", "member"), 256), 1, 16)))


def call_logs(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Written call logs read back; a source prunes the partitions that are read."""
    df = spark.read.option("basePath", path).json(path)
    return df.where(F.col("source") == source) if source else df


# Where conversation and dialogue files keep their parts, by order of preference.
TURN_KEYS = ("turns", "messages", "dialogue", "conversation", "utterances")
TEXT_KEYS = ("text", "utterance", "content", "message", "value")
SPEAKER_KEYS = ("speaker", "role", "from", "agent")
DIALOGUE_KEYS = {
    "turns": ("turns", "utterances", "dialogue", "segments"),
    "text": ("text", "transcript", "utterance", "content"),
    "speaker": ("speaker", "role", "channel", "party"),
    "start": ("start_ms", "start", "begin", "start_time"),
    "end": ("end_ms", "end", "stop", "end_time"),
}
# Callers in dialogue files and in mapped CSV files.
DIALOGUE_CALLERS = ("customer", "caller", "client", "user", "a", "0", "ch0")
MAPPED_CALLERS = ("customer", "caller", "client", "user", "a", "0")
# Phrases an agent or a machine says.
AGENT_CUES = (
    r"thank\s+you\s+for\s+(calling|choosing|holding|waiting|your\s+patience)",
    r"thanks\s+for\s+(calling|holding|waiting)",
    r"(your|this)\s+calls?\s+(may|will|is|are)\s+(be\s+)?(being\s+)?(monitored|recorded)",
    r"for\s+quality\s+(and|&)\s+(training|assurance)",
    r"(how|what)\s+(can|may)\s+i\s+(help|assist|direct)",
    r"is\s+there\s+anything\s+else\s+i\s+can\s+(help|do|assist)",
    r"if\s+you\s+know\s+your\s+party.s\s+extension",
    r"please\s+(press|dial|stay\s+on\s+the\s+line|hold|continue\s+to\s+hold)",
    r"press\s+(one|two|three|four|five|six|seven|eight|nine|zero|\d)\b",
    r"(one\s+moment|just\s+a\s+moment|bear\s+with\s+me)",
    r"let\s+me\s+(check|pull\s+up|look|transfer|connect|verify)",
    r"may\s+i\s+(have|get|ask|please\s+have)\s+your",
    r"can\s+i\s+(have|get)\s+your\s+(name|number|date)",
    r"i\s+apologi[sz]e\s+for\s+(the|any)",
    r"to\s+better\s+(assist|serve)\s+you",
    r"my\s+name\s+is\s+\[?\w+.{0,24}?\b(from|with|calling\s+from)\b",
    r"you.ve\s+reached\s+(the|our|\[)",
    r"all\s+(of\s+)?our\s+(agents|representatives)\s+are",
    r"have\s+a\s+(great|nice|good|wonderful)\s+(day|one|rest)",
)


def _probed(item: Column, keys: tuple[str, ...]) -> Column:
    """The first key whose value says something, as text."""
    return F.coalesce(*[F.nullif(strip(F.try_variant_get(item, f"$.{k}", "string")), F.lit("")) for k in keys])


def _records(v: Column) -> Column:
    """Objects of a VARIANT: itself or those of a list."""
    each = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.filter(each, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


def _items(df: DataFrame, key: str, v: Column, keys: tuple[str, ...]) -> DataFrame:
    """key, pos, item: the items of the first of the keys that holds a list."""
    d = df.select(key, v.alias("v")).select(key, F.explode(_records(F.col("v"))).alias("r"))
    lists = F.coalesce(*[F.try_variant_get("r", f"$.{k}", "array<variant>") for k in keys])
    return d.select(key, F.posexplode(lists).alias("pos", "item"))


def structured_turns(df: DataFrame, key: str, v: Column) -> DataFrame:
    """key, pos, line, speaker, text: turns of a VARIANT by key probing; an item that is a string is a script of lines.

    Items of other kinds and without text give no row, unreadable payloads neither.
    """
    i = _items(df, key, v, TURN_KEYS)
    is_object = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    text = _probed(F.col("item"), TEXT_KEYS)
    one = F.array(F.struct(F.coalesce(role_of(_probed(F.col("item"), SPEAKER_KEYS)), F.lit("human_agent")).alias("speaker"), text.alias("text")))
    said = F.when(is_object & text.isNotNull(), one).when(F.schema_of_variant("item") == "STRING", script_lines(F.try_variant_get("item", "$", "string")))
    return i.select(key, "pos", F.posexplode(said).alias("line", "t")).select(key, "pos", "line", "t.speaker", "t.text")


def _ms(item: Column, keys: tuple[str, ...]) -> Column:
    """Milliseconds of the first key that is there: as they are behind "_ms" and above 1000, else seconds. Negative and no times are null."""
    out = F.lit(None).cast("long")
    for k in reversed(keys):
        v = number(F.try_variant_get(item, f"$.{k}", "string"))
        ms = v.cast("long") if k.endswith("_ms") else F.when(v > 1000, v.cast("long")).otherwise(F.bround(v * 1000).cast("long"))
        out = F.when(F.try_variant_get(item, f"$.{k}", "variant").isNotNull(), F.when(v >= 0, ms)).otherwise(out)
    return out


def dialogue_turns(df: DataFrame, key: str, v: Column) -> DataFrame:
    """key, pos, speaker, text, start_ms, end_ms of dialogue objects; reversed times are exchanged, items without text dropped."""
    k = DIALOGUE_KEYS
    item = F.col("item")
    d = _items(df, key, v, k["turns"]).where(F.try_variant_get("item", "$", "map<string,variant>").isNotNull())
    who = F.coalesce(*[F.try_variant_get(item, f"$.{n}", "string") for n in k["speaker"]])
    d = d.select(key, F.col("pos").cast("long").alias("pos"), F.when(F.lower(strip(who)).isin(*DIALOGUE_CALLERS), "caller").otherwise("human_agent").alias("speaker"), _probed(item, k["text"]).alias("text"), _ms(item, k["start"]).alias("s"), _ms(item, k["end"]).alias("e"))
    swap = F.coalesce(F.col("e") < F.col("s"), F.lit(False))
    return d.where(F.col("text").isNotNull()).select(key, "pos", "speaker", "text", F.when(swap, F.col("e")).otherwise(F.col("s")).alias("start_ms"), F.when(swap, F.col("s")).otherwise(F.col("e")).alias("end_ms"))


def mapped_speaker(speaker: Column) -> Column:
    return F.when(F.lower(strip(speaker)).isin(*MAPPED_CALLERS), "caller").otherwise("human_agent")


def whole_ms(c: Column) -> Column:
    """A time written as a number, cut to whole milliseconds; negative and unreadable ones are null."""
    v = number(c).cast("long")
    return F.when(v >= 0, v)


def cued_speaker(text: Column) -> Column:
    """human_agent where a phrase of agents or machines stands, else caller."""
    return F.when(F.coalesce(text.rlike("(?i)" + "|".join(AGENT_CUES)), F.lit(False)), "human_agent").otherwise("caller")


def source_reader(name: str):
    """The reader of a kind of source; an unknown kind names those there are."""
    known = {"conversation_json": json_objects, "labelled_csv": labelled_csv, "mapped_csv": mapped_csv, "dialogue_json": json_objects, "word_timed_zip": zipped_words, "call_logs": call_logs}
    if name not in known:
        raise ValueError(f"unknown source {name!r}; known: {sorted(known)}")
    return known[name]
