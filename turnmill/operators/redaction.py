"""Pattern redaction in the JVM: detection with exact offsets, greedy overlap choice, stable placeholders, leak scan.

One projection per step; the only shuffle numbers the placeholders of a record. Offsets come from the gaps between matches,
so no Python is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.validators import validator


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    entity: str
    score: float
    check: str | None = None
    group: int = 0
    leak: bool = False


# The global pattern set, its scores and what is scanned for again afterwards.
PATTERNS = (
    Pattern("payment_card", r"\b(?:\d[ -]?){12,18}\d\b", "payment_card", 0.99, "luhn", leak=True),
    Pattern("iban", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b", "iban", 0.99, "iban", leak=True),
    Pattern("bank_routing", r"\b\d{9}\b", "bank_account", 0.72, "aba"),
    Pattern("national_id_us", r"\b(?!000|666|9\d{2})\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}\b", "national_id", 0.98, leak=True),
    Pattern("national_id_uk", r"\b[A-CEGHJ-PR-TW-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]\b", "national_id", 0.95, leak=True),
    Pattern("national_id_12_digit", r"\b\d{4}[ ]?\d{4}[ ]?\d{4}\b", "national_id", 0.60),
    Pattern("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "email", 0.99, leak=True),
    Pattern("phone_e164", r"\+\d{1,3}[ \-.]?\(?\d{1,4}\)?[ \-.]?\d{2,4}[ \-.]?\d{2,4}(?:[ \-.]?\d{2,4})?", "phone", 0.95, leak=True),
    Pattern("phone_na", r"\b\(?\d{3}\)?[ \-.]\d{3}[ \-.]\d{4}\b", "phone", 0.93, leak=True),
    Pattern("url", r"\bhttps?://[^\s<>\"]+", "url", 0.95),
    Pattern("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b", "ip", 0.97),
    Pattern("date_of_birth_labelled", r"(?i)\b(?:date of birth|d\.?o\.?b\.?|born on|birth ?date)\b[^\n]{0,16}?\b\d{1,4}[-/. ]\d{1,2}[-/. ]\d{2,4}\b", "date_of_birth", 0.97),
    Pattern("date_numeric", r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}\b", "date_of_birth", 0.40),
    Pattern("credential_labelled", r"(?i)\b(?:pin|otp|passcode|password|security code|one[- ]time code|verification code)\b(?:\W{0,6}(?:is|are|was))?\W{0,6}\d{3,10}\b", "credential", 0.98, leak=True),
    Pattern("cvv_labelled", r"(?i)\b(?:cvv|cvc|security number|card code)\b(?:\W{0,6}(?:is|are|was))?\W{0,6}\d{3,4}\b", "credential", 0.98, leak=True),
    Pattern("person_name_self_id", r"(?:(?i:my name(?:'s| is)|this is|i am|i'm|speaking(?: with)?|you're speaking (?:to|with)|it's))\s+([A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){0,2})", "person", 0.85, group=1),
    Pattern("postcode_uk", r"\b[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2}\b", "address", 0.90),
    Pattern("zip_us_plus4", r"\b\d{5}-\d{4}\b", "address", 0.88),
)
LONG_DIGITS = r"(?<!\[)\b(?:\d[ -]?){15,}\d\b"
PLACEHOLDER = r"\[[A-Z0-9_]+_\d+\]"
MIN_SCORE = 0.5

_SPAN = "struct<s:int,e:int,score:double,entity:string,pattern:string>"


def pattern_spans(text: Column, p: Pattern) -> Column:
    """array of spans of one pattern, in order; offsets from the gaps that splitting leaves."""
    whole = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    gaps = F.split(text, p.regex, -1)
    part = F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)) if p.group else whole
    empty = F.array().cast(f"array<{_SPAN}>")

    def add(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(F.get(gaps, acc["k"]))
        end = at + F.length(m["w"])
        # a group stands at the end of its match
        span = F.struct((end - F.length(m["g"])).cast("int").alias("s"), end.cast("int").alias("e"), F.lit(p.score).alias("score"), F.lit(p.entity).alias("entity"), F.lit(p.name).alias("pattern"))
        kept = F.when(validator(p.check)(m["g"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]) if p.check else F.concat(acc["spans"], F.array(span))
        return F.struct((acc["k"] + 1).alias("k"), end.cast("int").alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), empty.alias("spans"))
    found = F.aggregate(F.zip_with(whole, part, lambda w, g: F.struct(w.alias("w"), g.alias("g"))), start, add, lambda a: a["spans"])
    return F.when(text.rlike(p.regex), found).otherwise(empty)


def _needs(p: Pattern) -> str | None:
    """A character without which a pattern can't match."""
    return "@" if "@" in p.regex else "://" if "://" in p.regex else r"\d" if r"\d" in p.regex else None


def detect(text: Column, patterns: tuple[Pattern, ...] = PATTERNS, min_score: float = MIN_SCORE) -> Column:
    """All spans at or above min_score, before overlaps are settled; patterns under it are not run at all.

    One cheap look at a text decides whether the patterns that need a digit (or "@", "://") are tried.
    """
    used = [p for p in patterns if p.score >= min_score]
    parts = []
    for need in dict.fromkeys(_needs(p) for p in used):
        spans = F.concat(*[pattern_spans(text, p) for p in used if _needs(p) == need])
        guard = text.rlike(need) if need == r"\d" else text.contains(need) if need else None
        parts.append(spans if guard is None else F.when(guard, spans).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return F.concat(*parts)


def settle(spans: Column) -> Column:
    """Spans without overlaps, by start: taken greedily by score, then length, then start. Touching is no overlap."""
    ranked = F.array_sort(spans, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
                          .when(a["e"] - a["s"] != b["e"] - b["s"], F.when(a["e"] - a["s"] > b["e"] - b["s"], -1).otherwise(1))
                          .when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))
    kept = F.aggregate(ranked, F.array().cast(f"array<{_SPAN}>"), lambda acc, x: F.when(F.exists(acc, lambda k: (x["s"] < k["e"]) & (k["s"] < x["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(kept)


def leaks(text: Column, patterns: tuple[Pattern, ...] = PATTERNS) -> Column:
    """Sorted names of what still matches in a redacted text."""
    hits = [F.when(F.size(pattern_spans(text, p)) > 0 if p.check else text.rlike(p.regex), F.lit(p.name)) for p in patterns if p.leak]
    found = F.array_sort(F.array_compact(F.array(*hits, F.when(text.rlike(LONG_DIGITS), F.lit("long_digit_run")))))
    if any(p.leak and _needs(p) not in ("@", r"\d") for p in patterns):
        return found
    return F.when(text.rlike(r"[\d@]"), found).when(text.isNotNull(), F.array().cast("array<string>"))


def substitute(text: Column, spans: Column) -> Column:
    """The text with each span (s, e, token; in order) replaced by its token."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(spans, start, lambda a, x: F.struct(x["e"].cast("int").alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["token"]).alias("out")))
    return F.concat(body["out"], F.substring(text, body["at"] + 1, F.length(text)))


def redact_turns(turns: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, engines_ready: bool = True) -> DataFrame:
    """turns (record, turn, text) with redacted text, spans (of the original), status, residual.

    Tokens are [LABEL_n]: per record and label numbered by first use, turns in order and within a text from right to left;
    one surface (without case and outer space) keeps its token. A text in which something still matches is DIRTY and
    blanked. Without engines_ready, where a detector that a run asks for is missing, every clean text is UNVERIFIED and blanked as well.
    Null texts are CLEAN and stay null.
    """
    d = turns.select("record", "turn", "text").withColumn("spans", F.coalesce(settle(detect(F.col("text"), patterns)), F.array().cast(f"array<{_SPAN}>")))
    one = (d.select("record", "turn", "text", F.inline("spans"))
           .withColumn("label", F.upper("entity")).withColumn("key", F.sha2(F.lower(strip(F.expr("substring(text, s + 1, e - s)"))), 256)))
    first = one.groupBy("record", "label", "key").agg(F.min(F.struct(F.col("turn"), (-F.col("s")).alias("right"))).alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("record", "label").orderBy("first")))
    tokens = (one.join(numbered, ["record", "label", "key"])
              .select("record", "turn", F.struct("s", "e", "score", "entity", "pattern", F.concat(F.lit("["), "label", F.lit("_"), "n", F.lit("]")).alias("token")).alias("x"))
              .groupBy("record", "turn").agg(F.array_sort(F.collect_list("x")).alias("tokens")))
    out = d.drop("spans").join(tokens, ["record", "turn"], "left").withColumn("spans", F.coalesce("tokens", F.array().cast("array<struct<s:int,e:int,score:double,entity:string,pattern:string,token:string>>"))).drop("tokens")
    out = out.withColumn("redacted", substitute(F.col("text"), F.col("spans"))).withColumn("residual", F.coalesce(leaks(F.col("redacted"), patterns), F.array().cast("array<string>")))
    clean, ready = F.size("residual") == 0, F.lit(engines_ready) | F.col("text").isNull()
    return out.select("record", "turn", F.when(ready & clean, F.col("redacted")).when(F.col("text").isNotNull(), "").alias("text"), "spans", F.when(~clean, "DIRTY").when(ready, "CLEAN").otherwise("UNVERIFIED").alias("status"), "residual")


def record_verdicts(redacted: DataFrame) -> DataFrame:
    """record, turns, quarantined, reason (of the first blocked turn), entities found."""
    blocked = F.col("status") != "CLEAN"
    return redacted.groupBy("record").agg(
        F.count("*").alias("turns"), F.max(blocked).alias("quarantined"),
        F.min_by(F.concat(F.lit("dirty:"), F.array_join("residual", "|")), F.when(blocked, F.col("turn"))).alias("reason"),
        F.sum(F.size("spans")).alias("entities"),
    ).withColumn("reason", F.when(F.col("quarantined"), F.col("reason")))


def detokenize(text: Column, vault: Column) -> Column:
    """Known tokens of the map put back; unknown ones stay."""
    return F.aggregate(F.map_entries(vault), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def tokens_in(text: Column) -> Column:
    """The placeholder tokens of a text, without brackets, in order, repeated ones too."""
    return F.regexp_extract_all(text, F.lit(r"\[([A-Z0-9_]+_\d+)\]"), F.lit(1))


def unknown_tokens(text: Column, known: Column) -> Column:
    """Sorted distinct tokens of a text that are not among the known ones."""
    return F.array_sort(F.array_except(tokens_in(text), known))


def redact_value(value: Column, label: str, n: int = 1) -> Column:
    """A whole value replaced whatever it says: text, status and its one span (score 1); null stays null and has none."""
    span = F.struct(F.lit(0).alias("s"), F.length(value).alias("e"), F.lit(1.0).alias("score"), F.lit(label).alias("entity"), F.lit("manual").alias("pattern"))
    return F.struct(F.when(value.isNotNull(), F.lit(f"[{label.upper()}_{n}]")).alias("text"), F.lit("CLEAN").alias("status"), F.when(value.isNotNull(), span).alias("span"))


# Statuses from the strongest to the weakest.
STATUSES = ("CLEAN", "UNVERIFIED", "DIRTY")


def weakest(status: Column) -> Column:
    """Aggregate: the weakest status of the parts; null and unknown ones count as DIRTY."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, s in enumerate(STATUSES) for x in (F.lit(s), F.lit(i))]), status), F.lit(len(STATUSES) - 1))
    return F.get(F.lit(list(STATUSES)), F.max(rank))


def merged_patterns(base: tuple[Pattern, ...], added: tuple[Pattern, ...], leaks_: tuple[str, ...] = ()) -> tuple[Pattern, ...]:
    """The base set and what is added to it; a name used twice or a leak name without pattern is an error."""
    names = [p.name for p in (*base, *added)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"patterns may not be shadowed: {twice}")
    missing = sorted(set(leaks_) - set(names))
    if missing:
        raise ValueError(f"no pattern for {missing}")
    return (*base, *added)


def run_stats(verdicts: DataFrame) -> DataFrame:
    """seen, emitted, quarantined, rate (4 places), entities of a run."""
    q = F.count_if("quarantined")
    return verdicts.agg(F.count("*").alias("seen"), F.count_if(~F.col("quarantined")).alias("emitted"), q.alias("quarantined"), F.coalesce(F.bround(q / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("rate"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"))
