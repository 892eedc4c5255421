"""JSON schema checks compiled to column expressions: the part of the language that tool arguments use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that schema_of_variant gives to the types.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "null": ["VOID"]}


def _is(v: Column, kind: str) -> Column:
    name = F.schema_of_variant(v)
    if kind == "number":
        return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
    if kind in ("object", "array"):
        return name.startswith(kind.upper())
    return name.isin(_TYPES[kind])


def _first(v: Column, schema: dict, path: str) -> list[Column]:
    """For each rule, in order, the path of its violation or null."""
    out: list[Column] = []
    bad = lambda ok, at=path: F.when(~F.coalesce(ok, F.lit(False)), F.lit(at))
    if "type" in schema:
        out.append(bad(_is(v, schema["type"])))
    if "enum" in schema:
        out.append(bad(F.to_json(v).isin([__import__("json").dumps(x) for x in schema["enum"]])))
    if "pattern" in schema:
        out.append(bad(F.try_variant_get(v, "$", "string").rlike(schema["pattern"])))
    for rule, holds in (("minimum", lambda x, y: x >= y), ("maximum", lambda x, y: x <= y)):
        if rule in schema:
            out.append(bad(holds(F.try_variant_get(v, "$", "double"), schema[rule])))
    for rule, holds in (("minLength", lambda x, y: x >= y), ("maxLength", lambda x, y: x <= y)):
        if rule in schema:
            out.append(bad(holds(F.length(F.try_variant_get(v, "$", "string")), schema[rule])))
    at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    for k in schema.get("required", []):
        out.append(bad(at(k).isNotNull(), f"{path}.{k}"))
    for k, inner in schema.get("properties", {}).items():
        out += [F.when(at(k).isNotNull(), x) for x in _first(at(k), inner, f"{path}.{k}")]
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        out.append(bad(F.size(F.array_except(keys, F.lit(list(schema.get("properties", {}))))) <= 0))
    return out


def violations(payload: Column, schema: dict) -> Column:
    """The path of the first violation ("$" is the whole), null for a valid payload; null and unreadable ones violate "$".

    Known: type, enum, pattern, minimum, maximum, minLength, maxLength, required, properties, additionalProperties=false.
    """
    unknown = set(schema) - {"type", "enum", "pattern", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "title", "description"}
    if unknown:
        raise ValueError(f"unknown schema keys {sorted(unknown)}")
    v = F.try_parse_json(payload)
    return F.when(v.isNull(), F.lit("$")).otherwise(F.coalesce(*_first(v, schema, "$"), F.lit(None).cast("string")))
