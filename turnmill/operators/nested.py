"""Deeply nested JSON records as related flat tables, by higher-order functions on VARIANT.

Each level is one `transform` over the level above that carries the keys of its ancestors along; `flatten` joins the
lists of a level and one `inline` per target table emits its rows. No shuffle, no Python; the payload is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nodes under nodes that are columns of their own; deeper ones are read by a fold. The model has three.
LEVELS = 6
NODES = "array<struct<parent:string,id:string,node:variant>>"
NUMBER_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _object(v: Column) -> Column:
    """Whether a variant is an object; schema_of_variant would walk all that lies in it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _list(v: Column) -> Column:
    """A variant as array<variant>: a list as it is, one object as a list of it, else none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(_object(v), F.array(v)), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    t = F.try_variant_get(v, path, "string")
    return F.when(F.trim(t) != "", t)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_number(v: Column, path: str) -> Column:
    x = _get(v, path)
    kind = F.schema_of_variant(x)
    return F.coalesce((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) | ((kind == "STRING") & F.try_variant_get(x, "$", "string").rlike(NUMBER_TEXT)), F.lit(False))


def parsed(payload: Column) -> Column:
    """The payload as VARIANT; JSON within a JSON string is parsed again; null where it can't be read."""
    return F.try_parse_json(F.when(F.ltrim(payload).startswith('"'), F.try_variant_get(F.try_parse_json(payload), "$", "string")).otherwise(payload))


def _records(v: Column) -> Column:
    """The objects of a payload: itself, or those of a list."""
    return F.filter(_list(v), _object)


def dialogue_items(dialogues: DataFrame) -> DataFrame:
    """record_id, parent_key, position, item (VARIANT): one row for each item of `turns` or `utterances`.

    A list keeps the positions of its nulls, but they give no row; a lone object is at 0. Unreadable, null and empty
    payloads give none. Each delivered row gives its own items. dialogue_id may be null and then stays null.
    """
    d = dialogues.select("dialogue_id", parsed(F.col("payload")).alias("v")).select("dialogue_id", _records(F.col("v")).alias("records"))

    def items(rec: Column, name: str) -> Column:
        return F.transform(_list(_get(rec, f"$.{name}")), lambda x, i: F.struct(i.cast("long").alias("position"), x.alias("item")))

    at = F.flatten(F.transform("records", lambda r: F.concat(items(r, "turns"), items(r, "utterances"))))
    return (d.select("dialogue_id", F.inline(F.filter(at, lambda x: x["item"].isNotNull() & ~F.is_variant_null(x["item"]))))
            .select(F.col("dialogue_id").alias("record_id"), F.col("dialogue_id").alias("parent_key"), "position", "item"))


def utterances(dialogues: DataFrame) -> DataFrame:
    """Flat utterances: record_id, position, speaker, text, start_ms, end_ms, confidence.

    Seconds (`start`, `end`) become milliseconds; keys that are missing give null.
    """
    i = F.col("item")

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(i, p, "string") for p in paths])

    def ms(name: str) -> Column:
        return F.coalesce(F.try_variant_get(i, f"$.{name}_ms", "string").try_cast("double"), F.try_variant_get(i, f"$.{name}", "string").try_cast("double") * 1000)

    return dialogue_items(dialogues).select(
        "record_id", "position", first("$.speaker", "$.party").alias("speaker"), first("$.text", "$.transcript").alias("text"),
        F.bround(ms("start")).cast("long").alias("start_ms"), F.bround(ms("end")).cast("long").alias("end_ms"),
        F.try_variant_get(i, "$.asr.confidence", "double").alias("confidence"))


def _taxonomy_nodes(snapshots: DataFrame) -> DataFrame:
    """taxonomy_id and nodes: array of struct(parent, id, node) of a topmost node and all levels below it."""
    # no node lies deeper than its payload says "children"
    t = snapshots.select("taxonomy_id", F.coalesce(F.regexp_count("payload", F.lit("children")), F.lit(0)).alias("most"), parsed(F.col("payload")).alias("v"))
    # a row per record, then per topmost node: what is parsed and read is not computed again for the levels below
    t = t.select("taxonomy_id", "most", F.explode(_records(F.col("v"))).alias("r"))
    body = F.coalesce(_get(F.col("r"), "$.data.taxonomy"), _get(F.col("r"), "$.taxonomy"), F.col("r"))

    def entry(x: Column, key: Column, above: Column) -> Column:
        return F.struct(F.coalesce(_text(x, "$.parent_id"), above).alias("parent"), F.coalesce(_text(x, "$.intent_id"), key).alias("id"), x.alias("node"))

    def members(holder: Column, path: str, above: Column) -> Column:
        """Nodes of a list, of a lone node, or of an object whose keys are their ids; each part is bound, so read once."""
        none = F.lit(None).cast("string")

        def of(v: Column) -> Column:
            listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: entry(x, none, above))
            one = F.array(entry(v, none, above))
            keyed = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: entry(e["value"], e["key"], above))
            return F.coalesce(listed, F.when(_get(v, "$.intent_id").isNotNull(), one), keyed, F.array().cast(NODES))

        bound = F.transform(F.filter(F.array(_get(holder, path)), lambda v: v.isNotNull()), of)
        return F.filter(F.flatten(bound), lambda n: _object(n["node"]))

    level = t.select("taxonomy_id", "most", F.explode(members(body, "$.nodes", F.lit(None).cast("string"))).alias("top")).select("taxonomy_id", "most", F.array("top").alias("l0"))
    def below(l: Column) -> Column:
        return F.flatten(F.transform(l, lambda n: members(n["node"], "$.children", n["id"])))

    for d in range(1, LEVELS):
        level = level.withColumn(f"l{d}", below(F.col(f"l{d - 1}")))
    none = F.array().cast(NODES)
    state = F.struct(F.coalesce(below(F.col(f"l{LEVELS - 1}")), none).alias("last"), none.alias("done"))
    step = lambda a, _: F.when(F.size(a["last"]) == 0, a).otherwise(F.struct(F.coalesce(below(a["last"]), none).alias("last"), F.concat(a["done"], a["last"]).alias("done")))
    deeper = F.aggregate(F.sequence(F.lit(0), F.col("most")), state, step, lambda a: a["done"])
    every = F.flatten(F.array(*[F.coalesce(f"l{d}", none) for d in range(LEVELS)], F.when(F.size(f"l{LEVELS - 1}") > 0, deeper).otherwise(none)))
    return level.select("taxonomy_id", F.filter(every, lambda n: n["id"].isNotNull()).alias("nodes"))


def taxonomy_tables(snapshots: DataFrame) -> dict[str, DataFrame]:
    """nodes, slots, volumes, thresholds: flat tables whose rows name their parent.

    A node's parent is the intent it names, else the one it lies under, else null (the taxonomy). Nodes may be a list, an
    object by id, or lie under `children`, wrapped in `data.taxonomy`, a list or a string. Slots may be a list or one
    object. Missing parts give no row; nodes without an id and slots without a name are left out, as is a payload that
    can't be read.
    """
    n = _taxonomy_nodes(snapshots)
    nodes = n.select("taxonomy_id", F.inline("nodes"))
    c = F.col("node")
    slots = F.flatten(F.transform("nodes", lambda x: F.transform(_list(_get(x["node"], "$.slots")), lambda s: F.struct(x["id"].alias("intent_id"), _text(s, "$.name").alias("name"), s.alias("slot")))))
    s = F.col("slot")
    return {
        "nodes": nodes.select("taxonomy_id", F.col("parent").alias("parent_id"), F.col("id").alias("intent_id"), F.try_variant_get(c, "$.level", "int").alias("level"), F.try_variant_get(c, "$.label", "string").alias("label")),
        "slots": n.select("taxonomy_id", F.inline(F.filter(slots, lambda x: x["name"].isNotNull()))).select(
            "taxonomy_id", "intent_id", "name", F.try_variant_get(s, "$.slot_type", "string").alias("slot_type"), F.try_variant_get(s, "$.required", "boolean").alias("required")),
        "volumes": nodes.where(_is_number(c, "$.volume.utterance_count")).select(
            "taxonomy_id", F.col("id").alias("intent_id"), F.try_variant_get(c, "$.volume.utterance_count", "string").try_cast("double").alias("utterance_count"),
            F.try_variant_get(c, "$.volume.call_count", "string").try_cast("double").alias("call_count")),
        "thresholds": nodes.where(_is_number(c, "$.automation.thresholds.complexity")).select(
            "taxonomy_id", F.col("id").alias("intent_id"), F.try_variant_get(c, "$.automation.thresholds.complexity", "string").try_cast("double").alias("complexity")),
    }


def parent_child_keys(dialogues: DataFrame, snapshots: DataFrame) -> DataFrame:
    """record_id, entity, parent_key, child_key of all flat tables, each distinct row once."""
    t = taxonomy_tables(snapshots)

    def keys(df: DataFrame, entity: str, record: str, parent: Column, child: Column) -> DataFrame:
        return df.select(F.col(record).alias("record_id"), F.lit(entity).alias("entity"), parent.alias("parent_key"), child.alias("child_key"))

    intent = F.col("intent_id")
    return (keys(dialogue_items(dialogues), "utterance", "record_id", F.col("parent_key"), F.col("position").cast("string"))
            .unionByName(keys(t["nodes"], "node", "taxonomy_id", F.coalesce("parent_id", "taxonomy_id"), intent))
            .unionByName(keys(t["slots"], "slot", "taxonomy_id", intent, F.col("name")))
            .unionByName(keys(t["volumes"], "volume", "taxonomy_id", intent, F.lit("utterance_count")))
            .unionByName(keys(t["thresholds"], "thresholds", "taxonomy_id", intent, F.lit("complexity")))
            .distinct())


def paths(nodes: DataFrame) -> DataFrame:
    """taxonomy_id, intent_id, path from the root down, depth: for each different node, at any depth.

    A node given more than once has its least parent. A parent that is not there ends the path; a ring ends where the walk has
    as many steps as there are nodes. The nodes of one taxonomy, one document, are one map.
    """
    one = nodes.where(F.col("intent_id").isNotNull()).groupBy("taxonomy_id", "intent_id").agg(F.min("parent_id").alias("parent_id"))
    maps = one.groupBy("taxonomy_id").agg(F.map_from_entries(F.collect_list(F.struct("intent_id", "parent_id"))).alias("up"))
    start = F.struct(F.col("x.value").alias("up"), F.col("x.key").alias("path"), F.lit(1).cast("long").alias("depth"))

    def step(a: Column, _: Column) -> Column:
        known = a["up"].isNotNull() & F.map_contains_key("up", F.coalesce(a["up"], F.lit("")))
        return F.when(known, F.struct(F.try_element_at("up", a["up"]).alias("up"), F.concat(a["up"], F.lit(" > "), a["path"]).alias("path"), (a["depth"] + 1).alias("depth"))).otherwise(a)

    walked = F.aggregate(F.sequence(F.lit(1), F.size("up")), start, step)
    return (maps.select("taxonomy_id", "up", F.explode(F.map_entries("up")).alias("x")).withColumn("w", walked)
            .select("taxonomy_id", F.col("x.key").alias("intent_id"), "w.path", "w.depth"))


def leaves(df: DataFrame, keys: list[str], payload: str, depth: int = 32) -> DataFrame:
    """keys, path, value: the scalar leaves of a JSON payload, as text; list items share their list's path with "[]" behind it.

    Unreadable payloads and JSON nulls give no row. Levels are unfolded one after the other in the projection; more than `depth` of them fail.
    """
    v = F.try_parse_json(payload)
    d = df.select(*keys, F.explode(F.array(F.struct(F.lit("$").alias("path"), v.alias("v")))).alias("x")).select(*keys, "x.path", "x.v").where(F.col("v").isNotNull())

    def below(path: Column, v: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(F.concat(path, F.lit("[]")).alias("path"), e.alias("v")))
        return F.coalesce(fields, items, F.array(F.struct(path.alias("path"), v.alias("v"))))

    # objects and lists are unfolded until none is left: a fold over the levels of one payload
    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.struct(F.col("path"), F.col("v"))), lambda acc, _: F.flatten(F.transform(acc, lambda x: below(x["path"], x["v"]))))
    out = d.select(*keys, F.inline(all_))
    deep = F.schema_of_variant("v")
    text = F.when(deep.startswith("OBJECT") | deep.startswith("ARRAY"), F.when(deep.isin("OBJECT<>", "ARRAY<VOID>"), None).otherwise(F.raise_error(F.lit(f"more than {depth} levels")).cast("string"))).otherwise(F.try_variant_get("v", "$", "string"))
    return out.select(*keys, "path", text.alias("value")).where(F.col("value").isNotNull())
