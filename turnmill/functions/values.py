"""Small decisions on values, maps and JSON as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank, number, strip


def oversized(m: Column, most: int = 128) -> Column:
    """Whether some value of a map is longer than metadata may be; a null map or value is not."""
    return F.exists(F.map_values(m), lambda v: F.coalesce(F.length(v) > most, F.lit(False)))


def slot_valid(value: Column, allowed: Iterable[str] | None = None, pattern: str | None = None) -> Column:
    """A value that says something and is one of `allowed` (case aside), or else holds `pattern` somewhere; null and blank are invalid."""
    if allowed is not None:
        ok = F.lower(strip(value)).isin(sorted({a.lower() for a in allowed}))
    else:
        ok = value.rlike(pattern) if pattern else F.lit(True)
    return ~is_blank(value) & F.coalesce(ok, F.lit(False))


def all_allowed(value: Column, vocabulary: Iterable[str]) -> Column:
    """Whether every alphabetic token is in the vocabulary; a value without any is not."""
    tokens = F.regexp_extract_all(F.lower(value), F.lit("[a-z]+"), F.lit(0))
    return F.coalesce((F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(sorted(vocabulary))), F.lit(False))


def first_match(tool: Column, arguments: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """The answer of the first rule (tool, JSON object of the arguments it asks for, answer) in order that fits; null if none does.

    A rule without arguments is a default. arguments: map<string,string>; what a rule doesn't ask for doesn't matter.
    """
    import json

    out = F.lit(None).cast("string")
    for name, when, answer in reversed(list(rules)):
        fits = tool == name
        for k, v in json.loads(when).items():
            fits &= F.try_element_at(arguments, F.lit(k)) == F.lit(v)
        out = F.when(F.coalesce(fits, F.lit(False)), F.lit(answer)).otherwise(out)
    return out


def json_in_text(c: Column) -> Column:
    """The first JSON object in a text: in a fenced block, else from the first brace that begins one; null if there is none.

    Nothing is repaired. An object ends at the first closing brace up to which it can be read.
    """
    is_object = lambda x: F.substring(F.schema_of_variant(F.try_parse_json(x)), 1, 6) == "OBJECT"
    fenced = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1)), lambda x: x)
    ends = F.split(F.regexp_extract(c, r"(?s)\{.*\}", 0), r"(?<=\})")
    grown = F.transform(ends, lambda _, i: F.array_join(F.slice(ends, 1, i + 1), ""))
    return F.get(F.filter(F.concat(fenced, grown), lambda x: F.coalesce(is_object(x), F.lit(False))), F.lit(0))


def render(template: str, **values: Column) -> Column:
    """The template with each {name} given replaced once; other braces stay, values are not read for names."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def seconds_to_ms(c: Column) -> Column:
    """Whole milliseconds, cut off; null for null."""
    return (c.cast("double") * 1000).cast("long")


def retry_after_ms(header: Column) -> Column:
    """Milliseconds of a Retry-After header in seconds; null for dates, negatives and nothing."""
    v = number(header)
    return F.when((v >= 0) & strip(header).rlike(r"^\d"), seconds_to_ms(v))


def retained(date: Column, today: Column, days: int) -> Column:
    """Whether a record is still within its days of retention; a null date is not."""
    return F.coalesce(date >= F.date_sub(today, days), F.lit(False))


def clamped(c: Column) -> Column:
    """Between 0 and 1; null and NaN are 0."""
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def backoff(attempt: Column, base_ms: int, left_ms: Column) -> Column:
    """Milliseconds to wait before an attempt: base by attempt, at most what is left, never negative."""
    return F.greatest(F.lit(0), F.least(attempt * base_ms, left_ms)).cast("long")


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; where both have a key, the later one's value stands."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def reference(prefix: str, *parts: Column) -> Column:
    """A short reference made of what was asked: the prefix and 12 digits of the sha256 of the parts, in capitals."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))


def sorted_dump(df: DataFrame) -> Column:
    """All columns of df as one JSON object with its keys in order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def renamed(c: Column, aliases: dict[str, str]) -> Column:
    """A name by a small table of aliases; names it doesn't have stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), c), c)


def rank(c: Column, order: Iterable[str]) -> Column:
    """The place of a value in an order, from 0; null for unknown ones."""
    return F.try_element_at(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]), c)


def first_decisive(*verdicts: tuple[str, Column]) -> Column:
    """The first verdict in order whose condition holds; "none" if none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in verdicts], F.lit("none"))


def failing(*conditions: tuple[str, Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions]))
