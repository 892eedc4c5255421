"""Queries on records, roles, joins of small tables, reports and ordered views, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..functions.schema import violations
from ..operators import evals, mining, nested, ordered, redaction, roles
from ..sources import readers
from ..streaming import audio
from .catalogue import _JSON_SQL, _SCRIPT_SQL, _SPACES, _TAXONOMY_SQL, QUERIES, SQL, _derived, _texts, query

_WS = _SPACES

# --- sources ------------------------------------------------------------------------------------------------------------------

_SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"


def _probe(item: str, keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({item}->>'$.{k}', {_WS}), '')" for k in keys) + ")"


_ITEMS = """d4x AS (SELECT row_id, r, {probe} AS l FROM (SELECT row_id, unnest(CASE json_type(p) WHEN 'ARRAY' THEN from_json(p, '["JSON"]') WHEN 'OBJECT' THEN [p] END) AS r FROM
 (SELECT row_id, CASE WHEN json_type(p) = 'VARCHAR' THEN CASE WHEN json_valid(p->>'$') THEN (p->>'$')::JSON END ELSE p END AS p FROM (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM dialogues))) WHERE json_type(r) = 'OBJECT'),
items AS (SELECT row_id, unnest(from_json(l, '["JSON"]')) AS item, generate_subscripts(from_json(l, '["JSON"]'), 1) - 1 AS pos FROM d4x WHERE l IS NOT NULL)"""


def _first_list(keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(r->'$.{k}') = 'ARRAY' THEN r->'$.{k}' END" for k in keys) + ")"


@query("s4_structured_turns", "dialogues", sql="WITH " + _ITEMS.format(probe=_first_list(readers.TURN_KEYS)) + f""",
t AS (SELECT row_id, pos, {_probe('item', readers.TEXT_KEYS)} AS text, {_probe('item', readers.SPEAKER_KEYS)} AS who FROM items WHERE json_type(item) = 'OBJECT')
SELECT row_id, pos, text, CASE WHEN lower(who) IN ('customer','caller','client','user','member') THEN 'caller' WHEN lower(who) = 'ivr' THEN 'ivr' WHEN lower(who) IN ('bot','system') THEN 'bot' ELSE 'human_agent' END AS speaker FROM t WHERE text IS NOT NULL""")
def _(d):
    return readers.structured_turns(d, "row_id", nested.parsed(F.col("payload"))).where("line = 0").select("row_id", F.col("pos").cast("long").alias("pos"), "text", "speaker")


@query("s5_script_by_probing", "call_records", sql=f"SELECT row_id, coalesce(nullif(trim(transcript, {_WS}), ''), nullif(trim(notes, {_WS}), '')) AS script FROM call_records")
def _(c):
    return c.select("row_id", tx.first_present("transcript", "notes").alias("script"))


_NUM = "CASE WHEN json_type({0}) IN ('BIGINT','UBIGINT','DOUBLE','HUGEINT') OR (json_type({0}) = 'VARCHAR' AND regexp_full_match(trim({0}->>'$'), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN try_cast(trim({0}->>'$') AS DOUBLE) END"


def _ms_sql(keys: tuple[str, ...]) -> str:
    """The first key that is there decides, even if its value is no time."""
    whens = []
    for k in keys:
        v = _NUM.format(f"(item->'$.{k}')")
        ms = f"trunc({v})" if k.endswith("_ms") else f"CASE WHEN {v} > 1000 THEN trunc({v}) ELSE round_even({v} * 1000, 0) END"
        whens.append(f"WHEN (item->'$.{k}') IS NOT NULL THEN CASE WHEN {v} >= 0 THEN ({ms})::BIGINT END")
    return "CASE " + " ".join(whens) + " END"


@query("s14_dialogue_turns", "dialogues", sql="WITH " + _ITEMS.format(probe=_first_list(readers.DIALOGUE_KEYS["turns"])) + f""",
t AS (SELECT row_id, pos, {_probe('item', readers.DIALOGUE_KEYS['text'])} AS text, coalesce({', '.join(f"item->>'$.{k}'" for k in readers.DIALOGUE_KEYS['speaker'])}) AS who, {_ms_sql(readers.DIALOGUE_KEYS['start'])} AS s, {_ms_sql(readers.DIALOGUE_KEYS['end'])} AS e FROM items WHERE json_type(item) = 'OBJECT')
SELECT row_id, pos, text, CASE WHEN lower(trim(who, {_WS})) IN ('customer','caller','client','user','a','0','ch0') THEN 'caller' ELSE 'human_agent' END AS speaker,
CASE WHEN e < s THEN e ELSE s END AS start_ms, CASE WHEN e < s THEN s ELSE e END AS end_ms FROM t WHERE text IS NOT NULL""")
def _(d):
    return readers.dialogue_turns(d, "row_id", nested.parsed(F.col("payload")))


@query("s17_mapped_rows", "message_rows", sql=f"""
WITH x AS (SELECT message_id, trim(text, {_WS}) AS text, CASE WHEN lower(trim(speaker, {_WS})) IN ('customer','caller','client','user','a','0') THEN 'caller' ELSE 'human_agent' END AS speaker,
CASE WHEN regexp_full_match(trim(start_ms, {_WS}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(start_ms, {_WS}) AS DOUBLE) END AS s FROM message_rows)
SELECT message_id, speaker, text, CASE WHEN trunc(s) >= 0 THEN trunc(s)::BIGINT END AS start_ms FROM x WHERE text <> ''""")
def _(m):
    return m.select("message_id", readers.mapped_speaker(F.col("speaker")).alias("speaker"), tx.strip(F.col("text")).alias("text"), readers.whole_ms(F.col("start_ms")).alias("start_ms")).where("text <> ''")


_CUES = " OR ".join(f"regexp_matches(line, '{p}', 'i')" for p in (c.replace("'", "''") for c in readers.AGENT_CUES))


@query("s22_agent_cues", "call_records", sql=f"""
WITH t AS (SELECT row_id, unnest(list_transform(turns, lambda x: x.text)) AS line, generate_subscripts(turns, 1) - 1 AS turn FROM call_records)
SELECT row_id, turn, CASE WHEN {_CUES} THEN 'human_agent' ELSE 'caller' END AS speaker FROM t WHERE line IS NOT NULL""")
def _(c):
    return c.select("row_id", F.posexplode("turns").alias("turn", "t")).where("t.text IS NOT NULL").select("row_id", F.col("turn").cast("long").alias("turn"), readers.cued_speaker(F.col("t.text")).alias("speaker"))


@query("s27_broken_links", "taxonomy_snapshots", sql=_JSON_SQL + """SELECT DISTINCT taxonomy_id, id AS intent_id, parent FROM nodes a WHERE id IS NOT NULL AND parent IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM nodes b WHERE b.taxonomy_id = a.taxonomy_id AND b.id = a.parent)""")
def _(t):
    n = nested.taxonomy_tables(t)["nodes"].select("taxonomy_id", "intent_id", F.col("parent_id").alias("parent"))
    return n.where("intent_id IS NOT NULL AND parent IS NOT NULL").distinct().join(n.select("taxonomy_id", F.col("intent_id").alias("parent")), ["taxonomy_id", "parent"], "left_anti").select("taxonomy_id", "intent_id", "parent")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.generated import conversations

    return conversations(spark, 500, seed=7, pii=0.3)


QUERIES["s18_generated"] = _generated


# --- roles ----------------------------------------------------------------------------------------------------------------------

_ROLES = "WITH g(source, role) AS (VALUES " + ", ".join(f"('{s}', '{r}')" for s, rs in roles.GRANTED.items() for r in rs) + ")"
QUERIES["sel_roles_of_sources"] = lambda spark, d: roles.sources_for(roles.matrix(spark))
SQL["sel_roles_of_sources"] = _ROLES + " SELECT role, string_agg(source, ',' ORDER BY source) AS sources FROM g GROUP BY 1"
QUERIES["v7_role_matrix"] = lambda spark, d: roles.denied(roles.matrix(spark))
SQL["v7_role_matrix"] = _ROLES + " SELECT s.source, r.role FROM (SELECT DISTINCT source FROM g) s CROSS JOIN (SELECT DISTINCT role FROM g) r EXCEPT SELECT source, role FROM g"


# --- predicates and scalar values ---------------------------------------------------------------------------------------------------

@query("sel_caller_turns", "message_rows", sql=f"SELECT message_id FROM message_rows WHERE lower(trim(speaker, {_WS})) IN ('customer','caller','client','user','member')")
def _(m):
    return m.where(readers.role_of(F.col("speaker")) == "caller").select("message_id")


@query("sel_metadata_guard", "documents", sql="SELECT doc_id FROM documents WHERE length(source) > 14 OR length(domain_hint) > 14 OR length(lang) > 14")
def _(d):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("domain_hint"), F.col("domain_hint"), F.lit("lang"), F.col("lang"))
    return d.where(vl.oversized(m, 14)).select("doc_id")


@query("sel_slot_validity", "instruction_pairs", sql=f"""SELECT row_id, CASE WHEN category IS NULL OR trim(category, {_WS}) = '' THEN false ELSE lower(trim(category, {_WS})) IN ('delivery','billing','returns') END AS listed,
CASE WHEN intent IS NULL OR trim(intent, {_WS}) = '' THEN false ELSE regexp_matches(intent, '^[a-z]+_') END AS shaped FROM instruction_pairs""")
def _(p):
    return p.select("row_id", vl.slot_valid(F.col("category"), allowed=("Delivery", "billing", "returns")).alias("listed"), vl.slot_valid(F.col("intent"), pattern="^[a-z]+_").alias("shaped"))


@query("sel_schema_violations", "events", sql="""
SELECT event_id, CASE WHEN NOT json_valid(props) OR json_type(props) <> 'OBJECT' THEN '$' WHEN (props->'$.k') IS NULL THEN '$.k' WHEN json_type(props->'$.k') NOT IN ('BIGINT','UBIGINT') THEN '$.k' WHEN (props->>'$.k')::BIGINT > 50 THEN '$.k'
WHEN len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 THEN '$' END AS violation FROM events""")
def _(e):
    return e.select("event_id", violations(F.col("props"), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False}).alias("violation"))


@query("sel_allow_list", "instruction_pairs", sql=f"SELECT row_id FROM instruction_pairs WHERE len(list_filter(regexp_extract_all(lower(intent), '[a-z]+'), lambda w: w NOT IN ('cancel','order','track','open','return'))) = 0 AND len(regexp_extract_all(lower(intent), '[a-z]+')) > 0")
def _(p):
    return p.where(vl.all_allowed(F.col("intent"), ("cancel", "order", "track", "open", "return"))).select("row_id")


@query("a15_metric_passed", "events", sql="SELECT event_type, avg(value) <= 50 AS low_enough, avg(value) >= 50 AS high_enough FROM events GROUP BY 1")
def _(e):
    m = e.groupBy("event_type").agg(F.avg("value").alias("v"))
    return m.select("event_type", evals.passed(F.col("v"), 50.0, lower_is_better=True).alias("low_enough"), evals.passed(F.col("v"), 50.0, lower_is_better=False).alias("high_enough"))


_RULES = [("click", "{\"big\": \"yes\"}", "wide"), ("click", "{}", "narrow"), ("view", "{\"kind\": \"odd\", \"big\": \"yes\"}", "rare"), ("view", "{\"big\": \"no\"}", "usual")]


@query("j13_first_match", "events", sql="""SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value >= 50 THEN 'wide' ELSE 'narrow' END
WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 1 AND value >= 50 THEN 'rare' WHEN NOT coalesce(value >= 50, false) THEN 'usual' END END AS answer FROM events""")
def _(e):
    args = F.create_map(F.lit("big"), F.when(F.col("value") >= 50, "yes").otherwise("no"), F.lit("kind"), F.when(F.col("event_id") % 2 == 1, "odd").otherwise("even"))
    return e.select("event_id", vl.first_match(F.col("event_type"), args, _RULES).alias("answer"))


@query("r17_unknown_tokens", "documents", sql="""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '\\[([A-Z0-9_]+_\\d+)\\]', 1) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t) AS tokens, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: x NOT IN ('EMAIL_1')))), ',') AS unknown FROM x""")
def _(d):
    return d.where(F.col("text").isNotNull()).select("doc_id", F.size(redaction.tokens_in(F.col("text"))).alias("tokens"), F.array_join(redaction.unknown_tokens(F.col("text"), F.array(F.lit("EMAIL_1"))), ",").alias("unknown"))


@query("f2_unicode_slugs", "instruction_pairs", sql="SELECT nullif(trim(regexp_replace(lower(trim(category)), '[^\\p{L}\\p{N}._-]+', '_', 'g'), '._-'), '') AS slug, count(*) AS n FROM instruction_pairs GROUP BY 1")
def _(p):
    return p.groupBy(tx.unicode_slug(F.col("category")).alias("slug")).agg(F.count("*").alias("n"))


@query("f3_slug_format", "documents", sql="SELECT doc_id, coalesce(regexp_full_match(source, '[a-z0-9]+([._-][a-z0-9]+)*') AND length(source) <= 128, false) AS valid FROM documents")
def _(d):
    return d.select("doc_id", tx.is_slug(F.col("source")).alias("valid"))


@query("f10_parents", "taxonomy_snapshots", sql=_JSON_SQL + "SELECT DISTINCT id AS intent_id, len(string_split(id, '.')) AS depth, CASE WHEN contains(id, '.') THEN regexp_replace(id, '[.][^.]*$', '') END AS parent FROM nodes WHERE id IS NOT NULL")
def _(t):
    return nested.taxonomy_tables(t)["nodes"].where("intent_id IS NOT NULL").select("intent_id", F.size(F.split("intent_id", r"\.")).alias("depth"), tx.parent_slug(F.col("intent_id")).alias("parent")).distinct()


@query("f13_json_in_text", "events", sql="SELECT event_id, props AS found FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'")
def _(e):
    said = F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n```\nAnything else? {no"))
    return e.select("event_id", vl.json_in_text(said).alias("found")).where("found IS NOT NULL")


@query("f14_formatted", "orders", sql="SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, o_orderstatus || ' > ' || o_orderpriority AS path FROM orders")
def _(o):
    return o.select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("price"), F.concat_ws(" > ", "o_orderstatus", "o_orderpriority").alias("path"))


@query("f15_rendered", "orders", sql="SELECT o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderstatus || ' for {name}.' AS text FROM orders")
def _(o):
    return o.select("o_orderkey", vl.render("Order {key} is {status} for {name}.", key=F.col("o_orderkey").cast("string"), status=F.col("o_orderstatus")).alias("text"))


@query("f18_message_parts", "events", sql="SELECT event_id, props->>'$.page' AS first, coalesce((props->'$.k') IS NOT NULL, false) AS final FROM events")
def _(e):
    v = F.try_parse_json("props")
    return e.select("event_id", F.try_variant_get(v, "$.page", "string").alias("first"), F.try_variant_get(v, "$.k", "string").isNotNull().alias("final"))


@query("f19_summaries", "intent_dim", sql="SELECT domain, 'Intents of ' || domain || ': ' || string_agg(intent, ', ' ORDER BY intent) || '.' AS text FROM intent_dim GROUP BY 1")
def _(d):
    return d.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("intent")), ", ").alias("names")).select("domain", F.concat(F.lit("Intents of "), "domain", F.lit(": "), "names", F.lit(".")).alias("text"))


@query("d5_seconds_to_ms", "events", sql="SELECT event_id, trunc(value * 1000)::BIGINT AS ms FROM events")
def _(e):
    return e.select("event_id", vl.seconds_to_ms(F.col("value")).alias("ms"))


@query("d6_retry_after", "message_rows", sql="SELECT message_id, CASE WHEN regexp_full_match(trim(end_ms), '[0-9]+([.][0-9]*)?') THEN trunc(try_cast(trim(end_ms) AS DOUBLE) * 1000)::BIGINT END AS wait_ms FROM message_rows")
def _(m):
    return m.select("message_id", vl.retry_after_ms(F.col("end_ms")).alias("wait_ms"))


@query("d7_retention", "call_records", sql="SELECT row_id FROM call_records WHERE called_at::DATE >= DATE '2025-01-15' - 7")
def _(c):
    return c.where(vl.retained(F.to_date("called_at"), F.lit("2025-01-15").cast("date"), 7)).select("row_id")


@query("m5_clamped", "message_rows", sql="SELECT message_id, CASE WHEN regexp_full_match(trim(start_ms), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN least(1.0, greatest(0.0, try_cast(trim(start_ms) AS DOUBLE) / 10000)) ELSE 0.0 END AS share FROM message_rows")
def _(m):
    return m.select("message_id", vl.clamped(tx.number(F.col("start_ms")) / 10000).alias("share"))


@query("m7_frames", "orders", sql="SELECT o_orderkey, (o_orderkey % 500) * 16 AS bytes_8k, ((o_orderkey * 7) // 32)::BIGINT AS ms_16k FROM orders")
def _(o):
    return o.select("o_orderkey", audio.bytes_of_ms(F.col("o_orderkey") % 500, 8000).alias("bytes_8k"), audio.ms_of_bytes(F.col("o_orderkey") * 7, 16000).alias("ms_16k"))


@query("m11_backoff", "lineitem", sql="SELECT l_orderkey, l_linenumber, greatest(0, least(150 * l_linenumber, 1000 - l_quantity::INT * 20))::BIGINT AS wait_ms FROM lineitem")
def _(li):
    return li.select("l_orderkey", "l_linenumber", vl.backoff(F.col("l_linenumber"), 150, F.lit(1000) - F.col("l_quantity").cast("int") * 20).alias("wait_ms"))


# --- maps and JSON --------------------------------------------------------------------------------------------------------------------

@query("c2_counted_maps", "events", sql="SELECT user_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(e):
    m = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("counts"))


@query("c3_later_wins", "intent_dim", sql="SELECT intent, domain || '|' || risk_tier AS merged FROM intent_dim")
def _(d):
    m = vl.merged(F.create_map(F.lit("a"), F.col("category"), F.lit("b"), F.col("risk_tier")), F.create_map(F.lit("a"), F.col("domain")))
    return d.select("intent", F.concat_ws("|", m["a"], m["b"]).alias("merged"))


@query("c5_json_leaves", "events", sql="SELECT event_id, k AS path, props->>('$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))")
def _(e):
    return nested.leaves(e.select("event_id", "props"), ["event_id"], "props").select("event_id", F.substring("path", 3, 1000).alias("path"), "value")


@query("c7_echo_reference", "orders", sql="SELECT o_orderkey, 'REF-' || upper(substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 12)) AS reference FROM orders")
def _(o):
    return o.select("o_orderkey", vl.reference("REF-", F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("reference"))


@query("c8_sorted_dump", "intent_dim", sql="""SELECT intent, '{"category":"' || category || '","domain":"' || domain || '","intent":"' || intent || '","risk_tier":"' || risk_tier || '"}' AS dump FROM intent_dim""")
def _(d):
    return d.select("intent", vl.sorted_dump(d).alias("dump"))


@query("c9_valid_arguments", "events", sql="SELECT event_id, CASE WHEN value >= 50 THEN 'value=' || (value >= 50)::VARCHAR ELSE '' END AS kept FROM events WHERE value IS NOT NULL")
def _(e):
    m = F.map_filter(F.create_map(F.lit("value"), (F.col("value") >= 50)), lambda k, v: v)
    return e.where("value IS NOT NULL").select("event_id", F.array_join(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("kept"))


@query("c12_known_alternatives", "instruction_pairs", "intent_dim", sql=f"SELECT row_id, array_to_string(list_filter([{_SLUG.format('intent')}, {_SLUG.format('category')}, 'track_order'], lambda x: list_contains(names, x)), ',') AS known FROM instruction_pairs CROSS JOIN (SELECT list(intent) AS names FROM intent_dim)")
def _(p, i):
    known = i.agg(F.collect_set("intent").alias("known"))  # the fixed table of intents
    c = F.array(tx.ascii_slug(F.col("intent")), tx.ascii_slug(F.col("category")), F.lit("track_order"))
    return p.crossJoin(F.broadcast(known)).select("row_id", F.array_join(F.filter(c, lambda x: F.array_contains("known", x)), ",").alias("known"))


# --- joins ----------------------------------------------------------------------------------------------------------------------------

_TOOLS = {"low": ["lookup"], "medium": ["lookup", "update"], "high": ["lookup", "update", "verify"], "regulated": ["verify", "hand_over"]}
_SPECS = [("lookup", 100, "order"), ("update", 400, "order"), ("verify", 250, "person")]
_TOOL_SQL = "tools(risk_tier, tool) AS (VALUES " + ", ".join(f"('{r}', '{t}')" for r, ts in _TOOLS.items() for t in ts) + "), specs(tool, timeout_ms, argument) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _SPECS) + ")"


def _tools(d: DataFrame) -> DataFrame:
    of = F.create_map(*[x for r, ts in _TOOLS.items() for x in (F.lit(r), F.lit(ts))])
    return d.select("intent", "domain", F.explode(of[F.col("risk_tier")]).alias("tool"))


def _specs(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame(_SPECS, "tool string, timeout_ms int, argument string")


@query("j2_required_tools", "intent_dim", sql=f"WITH {_TOOL_SQL} SELECT intent, tool, timeout_ms FROM intent_dim JOIN tools USING (risk_tier) JOIN specs USING (tool)")
def _(d):
    return _tools(d).join(F.broadcast(_specs(d)), "tool").select("intent", "tool", "timeout_ms")


@query("j3_unresolved_tools", "intent_dim", sql=f"WITH {_TOOL_SQL} SELECT DISTINCT tool FROM intent_dim JOIN tools USING (risk_tier) WHERE tool NOT IN (SELECT tool FROM specs)")
def _(d):
    return _tools(d).join(_specs(d), "tool", "left_anti").select("tool").distinct()


@query("j4_uncovered_arguments", "taxonomy_snapshots", sql=_JSON_SQL + """SELECT DISTINCT taxonomy_id, id AS intent_id, a AS argument FROM (SELECT taxonomy_id, id, unnest(['order_reference', 'postal_code']) AS a FROM nodes WHERE id IS NOT NULL) n
WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.taxonomy_id = n.taxonomy_id AND s.id = n.id AND s.s->>'$.name' = a)""")
def _(t):
    tables = nested.taxonomy_tables(t)
    need = tables["nodes"].where("intent_id IS NOT NULL").select("taxonomy_id", "intent_id", F.explode(F.lit(["order_reference", "postal_code"])).alias("argument")).distinct()
    have = tables["slots"].select("taxonomy_id", "intent_id", F.col("name").alias("argument"))
    return need.join(have, ["taxonomy_id", "intent_id", "argument"], "left_anti")


@query("j7_by_position", "call_records", sql="SELECT row_id, generate_subscripts(turns, 1) - 1 AS turn, unnest(list_transform(turns, lambda x, i: x.speaker || ' of ' || len(turns))) AS label FROM call_records")
def _(c):
    whos = F.transform("turns", lambda t: t["speaker"])
    sizes = F.transform("turns", lambda t: F.size("turns").cast("string"))
    return c.select("row_id", F.posexplode(F.zip_with(whos, sizes, lambda a, b: F.concat(a, F.lit(" of "), b))).alias("turn", "label")).withColumn("turn", F.col("turn").cast("long"))


@query("j15_renamed_slots", "instruction_pairs", sql="""
WITH x AS (SELECT row_id, unnest(regexp_extract_all(instruction, '\\{\\{\\s*([^{}]+?)\\s*\\}\\}', 1)) AS name FROM instruction_pairs), s AS (SELECT row_id, coalesce(nullif(trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slot FROM x)
SELECT CASE slot WHEN 'order_number' THEN 'order_reference' WHEN 'person_name' THEN 'customer_name' ELSE slot END AS slot, count(*) AS n FROM s GROUP BY 1""")
def _(p):
    slots = p.select(F.explode(F.transform(F.regexp_extract_all("instruction", F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1)), tx.ascii_slug)).alias("slot"))
    return slots.groupBy(vl.renamed(F.col("slot"), {"order_number": "order_reference", "person_name": "customer_name"}).alias("slot")).agg(F.count("*").alias("n"))


# --- aggregates ------------------------------------------------------------------------------------------------------------------------

@query("a6_merged_leaves", "documents", sql="SELECT source AS leaf, min(doc_id) AS cluster_id, count(*) AS size, min_by(n_chars, doc_id) AS first_chars FROM documents GROUP BY 1")
def _(d):
    return d.groupBy(F.col("source").alias("leaf")).agg(F.min("doc_id").alias("cluster_id"), F.count("*").alias("size"), F.min_by("n_chars", "doc_id").alias("first_chars"))


@query("a7_volume", "instruction_pairs", sql=f"SELECT {_SLUG.format('intent')} AS intent, count(*) AS n, round_even(least(count(*) / (SELECT count(*) FROM instruction_pairs), 1), 6) AS share, round_even(least(count(*) / 200, 1), 4) AS confidence FROM instruction_pairs GROUP BY 1")
def _(p):
    n = p.groupBy(tx.ascii_slug(F.col("intent")).alias("intent")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per label
    return n.select("intent", "n", F.bround(F.least(F.col("n") / total, F.lit(1.0)), 6).alias("share"), F.bround(F.least(F.col("n") / 200, F.lit(1.0)), 4).alias("confidence"))


@query("a13_coverage", "documents", sql="SELECT count(*) FILTER (domain_hint IS NOT NULL AND kind <> 'mail') AS assigned, count(*) FILTER (kind <> 'mail') AS meant, round_even(count(*) FILTER (domain_hint IS NOT NULL AND kind <> 'mail') / nullif(count(*) FILTER (kind <> 'mail'), 0), 6) AS coverage FROM documents")
def _(d):
    return mining.coverage(d, assigned=F.col("domain_hint").isNotNull(), filler=F.col("kind") == "mail")


@query("a18_index_percentiles", "events", sql="""SELECT event_type, v[least(len(v), floor(len(v) * 0.5)::INT + 1)] AS p50, v[least(len(v), floor(len(v) * 0.95)::INT + 1)] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)""")
def _(e):
    return evals.index_percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})


_ROUTED = f"""WITH c AS (SELECT 'c' || (row_id % 7) || '.' || (row_id % 5) AS expected, CASE WHEN row_id % 11 = 0 THEN NULL WHEN row_id % 3 = 0 THEN 'c' || (row_id % 7) || '.x' ELSE 'c' || (row_id % 7) || '.' || (row_id % 4) END AS predicted, row_id % 13 = 0 AS unavailable, row_id % 11 = 0 AS timed_out, row_id % 100 AS ms FROM instruction_pairs),
m AS (SELECT *, predicted IS NOT NULL AND NOT unavailable AND NOT timed_out AS answered, unavailable OR (timed_out AND (SELECT bool_or(predicted IS NOT NULL AND NOT unavailable AND NOT timed_out) FROM c)) AS unmeasured FROM c)"""


@query("a19_routing", "instruction_pairs", sql=_ROUTED + """ SELECT count(*) AS cases, count(*) FILTER (unmeasured) AS unmeasured, count(*) FILTER (NOT unmeasured AND predicted = expected) AS exact,
count(*) FILTER (NOT unmeasured AND string_split(predicted, '.')[1] = string_split(expected, '.')[1]) AS category_correct, quantile_disc(ms, 0.95) FILTER (NOT unmeasured AND answered) AS p95_ms FROM m""")
def _(p):
    return evals.routing(_routed(p))


def _routed(p: DataFrame) -> DataFrame:
    """Cases with predictions that are derived from the row's number, of every kind there is."""
    r = F.col("row_id")
    c = F.concat(F.lit("c"), r % 7, F.lit("."))
    predicted = F.when(r % 11 == 0, None).when(r % 3 == 0, F.concat(c, F.lit("x"))).otherwise(F.concat(c, r % 4))
    return p.select(F.concat(c, r % 5).alias("expected"), predicted.alias("predicted"), (r % 13 == 0).alias("unavailable"), (r % 11 == 0).alias("timed_out"), (r % 100).alias("ms"))


@query("a22_highest_tier", "intent_dim", sql="SELECT category, max_by(risk_tier, CASE risk_tier WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS tier FROM intent_dim GROUP BY 1")
def _(d):
    return d.groupBy("category").agg(F.max_by("risk_tier", vl.rank(F.col("risk_tier"), ("low", "medium", "high", "regulated"))).alias("tier"))


@query("a23_failures", "events", sql="SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS elapsed FROM events GROUP BY 1")
def _(e):
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 4).alias("elapsed"))


_LEDGER = "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS listen, (l_discount * 1000)::BIGINT AS redact_us, l_linenumber * 10 AS route FROM lineitem"


def _ledger(li: DataFrame) -> DataFrame:
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("listen"), F.round(F.col("l_discount") * 1000).cast("long").alias("redact_us"), (F.col("l_linenumber") * 10).alias("route"))


@query("a24_ledger", "lineitem", sql=f"SELECT l_orderkey, l_linenumber, (listen + route + round_even(redact_us / 1000, 0))::BIGINT AS total_ms, listen + route + round_even(redact_us / 1000, 0) > 90 AS breached FROM ({_LEDGER})")
def _(li):
    total = evals.ledger_total(("listen", "route"), ("redact_us",))
    return _ledger(li).select("l_orderkey", "l_linenumber", total.alias("total_ms"), (total > 90).alias("breached"))


@query("a27_stage_latency", "lineitem", sql=f"""SELECT stage, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, max(ms) AS largest, count(*) FILTER (ms > CASE stage WHEN 'listen' THEN 40 ELSE 60 END) AS breaches
FROM (SELECT 'listen' AS stage, listen AS ms FROM ({_LEDGER}) UNION ALL SELECT 'route', route FROM ({_LEDGER})) GROUP BY 1""")
def _(li):
    return evals.stage_latency(_ledger(li), {"listen": 40, "route": 60})


@query("a25_budget", "mix_targets", sql="SELECT sum(max_repeats * 100)::BIGINT AS total, (1000 - sum(max_repeats * 100))::BIGINT AS slack, sum(max_repeats * 100) <= 1.25 * 1000 AS plausible FROM mix_targets")
def _(m):
    return evals.budget(m.select((F.col("max_repeats") * 100).alias("ms")), "ms", 1000)


@query("a26_merged_stats", "call_records", sql="SELECT k AS name, sum(n)::BIGINT AS n FROM (SELECT source, unnest(['seen', 'with_turns']) AS k, unnest([count(*), count(turns)]) AS n FROM call_records GROUP BY 1) GROUP BY 1")
def _(c):
    per = c.groupBy("source").agg(F.create_map(F.lit("seen"), F.count("*"), F.lit("with_turns"), F.count("turns")).alias("stats"))
    return per.select(F.explode("stats").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


@query("a28_report_passed", "events", sql="SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM (SELECT event_type, avg(value) < 1000 AS ok FROM events GROUP BY 1)")
def _(e):
    return evals.report_passed(e.groupBy("event_type").agg((F.avg("value") < 1000).alias("ok")), "ok")


@query("a29_distinct_counts", "instruction_pairs", sql="SELECT count(DISTINCT split) AS splits, count(DISTINCT intent) AS intents, count(DISTINCT category) AS categories FROM instruction_pairs")
def _(p):
    return p.agg(F.countDistinct("split").alias("splits"), F.countDistinct("intent").alias("intents"), F.countDistinct("category").alias("categories"))


@query("a14_overlap_in_kind", "documents", sql="""
WITH w AS (SELECT doc_id, kind, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(text, '\\[[A-Z0-9_]+_\\d+\\]', ' ', 'g')), '[a-z'']{3,}'), lambda x: x NOT IN ('the','and','for','you'))) AS words FROM documents WHERE text IS NOT NULL)
SELECT kind, count(*) FILTER (len(words) >= 40) AS eligible, CASE WHEN count(*) FILTER (len(words) >= 40) >= 30 THEN round(avg(len(words)) FILTER (len(words) >= 40), 6) END AS mean_words FROM w GROUP BY 1""")
def _(d):
    w = d.where(F.col("text").isNotNull()).select("kind", F.size(mining.vocabulary(F.col("text"), ["the", "and", "for", "you"])).alias("n"))
    enough = F.col("n") >= 40
    return w.groupBy("kind").agg(F.count_if(enough).alias("eligible"), F.when(F.count_if(enough) >= 30, F.round(F.avg(F.when(enough, F.col("n"))), 6)).alias("mean_words"))


# --- ordered, top-k, sets ---------------------------------------------------------------------------------------------------------------

@query("w6_latest_value", "events", sql="SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events")
def _(e):
    t = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return ordered.latest(t, ["user_id"], "at", ["event_id"], F.when(F.col("event_type") == "click", F.col("value")), "latest", 86400.0 * 30).select("event_id", "latest")


@query("w10_unspoken", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k > 2")
def _(li):
    return li.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).where("k > 2").select("l_orderkey", "l_linenumber")


@query("t4_ranked_confusions", "instruction_pairs", sql=_ROUTED + "SELECT expected, coalesce(predicted, '<none>') AS predicted, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, expected, coalesce(predicted, '<none>')) AS rank FROM m WHERE NOT unmeasured AND predicted IS DISTINCT FROM expected GROUP BY 1, 2")
def _(p):
    return evals.ranked_confusions(_routed(p))


@query("t5_emitted_limit", "call_records", sql="SELECT row_id FROM call_records WHERE len(turns) > 0 OR trim(transcript) <> '' ORDER BY row_id LIMIT 10")
def _(c):
    return c.where((F.size("turns") > 0) | (F.trim("transcript") != "")).orderBy("row_id").limit(10).select("row_id")


@query("t8_first_decisive", "lineitem", sql="SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.05 THEN 'discounted' WHEN l_quantity > 40 THEN 'large' ELSE 'none' END AS verdict FROM lineitem")
def _(li):
    return li.select("l_orderkey", "l_linenumber", vl.first_decisive(("returned", F.col("l_returnflag") == "R"), ("discounted", F.col("l_discount") > 0.05), ("large", F.col("l_quantity") > 40)).alias("verdict"))


@query("t10_alternatives", "intent_dim", sql="SELECT domain, array_to_string(list_slice(list(intent ORDER BY intent), 1, 3), ',') AS alternatives FROM intent_dim GROUP BY 1")
def _(d):
    return d.groupBy("domain").agg(F.array_join(F.slice(F.array_sort(F.collect_list("intent")), 1, 3), ",").alias("alternatives"))


@query("u5_ordered_union", "call_records", sql="SELECT row_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(turns, lambda t: t.speaker)), lambda s: {'p': list_position(list_transform(turns, lambda t: t.speaker), s), 's': s})), lambda x: x.s), ',') AS speakers FROM call_records WHERE turns IS NOT NULL")
def _(c):
    return c.where(F.col("turns").isNotNull()).select("row_id", F.array_join(F.array_distinct(F.array_compact(F.transform("turns", lambda t: t["speaker"]))), ",").alias("speakers"))


@query("u7_halves", "instruction_pairs", sql="SELECT ('0x' || substr(sha256('instruction_pairs:' || row_id), 1, 2))::INT % 2 = 0 AS derived, count(*) AS n FROM instruction_pairs GROUP BY 1")
def _(p):
    return p.groupBy(mining.derivation(F.concat(F.lit("instruction_pairs:"), F.col("row_id"))).alias("derived")).agg(F.count("*").alias("n"))


@query("u8_one_per_slug", "instruction_pairs", sql=f"SELECT {_SLUG.format('intent')} AS slug, min(intent) AS name FROM instruction_pairs WHERE intent IS NOT NULL GROUP BY 1")
def _(p):
    return p.where(F.col("intent").isNotNull()).groupBy(tx.ascii_slug(F.col("intent")).alias("slug")).agg(F.min("intent").alias("name"))


@query("u9_without_profile", "message_rows", sql="SELECT DISTINCT channel FROM message_rows WHERE channel IS NOT NULL AND channel NOT IN ('web', 'voice')")
def _(m):
    return m.select("channel").where(F.col("channel").isNotNull()).subtract(m.sparkSession.createDataFrame([("web",), ("voice",)], "channel string"))


# --- views ------------------------------------------------------------------------------------------------------------------------------

@query("v3_domains", "intent_dim", sql="SELECT domain, count(*) AS intents, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM intent_dim GROUP BY 1")
def _(d):
    return d.groupBy("domain").agg(F.count("*").alias("intents"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("v4_tool_catalogue", "intent_dim", sql=f"WITH {_TOOL_SQL} SELECT DISTINCT tool, domain, CASE WHEN tool IN (SELECT tool FROM specs) THEN 'shared' ELSE 'pack' END AS scope FROM intent_dim JOIN tools USING (risk_tier)")
def _(d):
    return _tools(d).join(F.broadcast(_specs(d)), "tool", "left").select("tool", "domain", F.when(F.col("timeout_ms").isNotNull(), "shared").otherwise("pack").alias("scope")).distinct()


@query("v8_summary", "instruction_pairs", sql=_TAXONOMY_SQL + """SELECT CASE WHEN share_of_total >= 0.05 AND complexity < 0.5 THEN 'immediate_migration' WHEN share_of_total >= 0.05 THEN 'phased_agentic' WHEN complexity < 0.5 THEN 'self_service_scripted' ELSE 'direct_agent_route' END AS quadrant, count(*) AS leaves FROM nodes WHERE level = 2 GROUP BY 1""")
def _(p):
    return mining.adopt_taxonomy(_derived(p)).where("level = 2").groupBy(mining.quadrant(F.col("share_of_total"), F.col("complexity")).alias("quadrant")).agg(F.count("*").alias("leaves"))


@query("v10_failing_conditions", "documents", sql="SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN domain_hint IS NULL THEN 'no domain' END], lambda x: x IS NOT NULL), ', ') AS failing FROM documents")
def _(d):
    return d.select("doc_id", F.array_join(vl.failing(("blank", F.col("text").isNull() | (F.trim("text") == "")), ("no language", F.col("lang").isNull()), ("no domain", F.col("domain_hint").isNull())), ", ").alias("failing"))


@query("v11_holdout_summary", "instruction_pairs", sql="SELECT count(*) AS rows, count(*) FILTER (('0x' || substr(sha256('instruction_pairs:' || row_id), 1, 2))::INT % 2 = 0) AS derived, count(*) FILTER (('0x' || substr(sha256('instruction_pairs:' || row_id), 1, 2))::INT % 2 = 1) AS held_out FROM instruction_pairs")
def _(p):
    d = mining.derivation(F.concat(F.lit("instruction_pairs:"), F.col("row_id")))
    return p.agg(F.count("*").alias("rows"), F.count_if(d).alias("derived"), F.count_if(~d).alias("held_out"))


# --- streams as tables ---------------------------------------------------------------------------------------------------------------------

@query("g8_final_only", "events", sql="SELECT event_id FROM events WHERE (props->'$.k') IS NOT NULL")
def _(e):
    return e.where(F.try_variant_get(F.try_parse_json("props"), "$.k", "string").isNotNull()).select("event_id")


@query("g9_sequenced", "events", sql="SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index FROM events")
def _(e):
    t = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return ordered.running_sum(t, ["user_id"], "at", ["event_id"], F.lit(1), "n", 86400.0 * 30).select("event_id", (F.col("n") - 1).cast("long").alias("turn_index"))


@query("g10_frames", "call_records", sql="SELECT row_id, i AS frame, length(substr(notes, i::INT * 40 + 1, 40)) AS size FROM (SELECT row_id, notes, unnest(range(0, (length(notes) + 39) // 40)) AS i FROM call_records WHERE length(notes) > 0)")
def _(c):
    return audio.chunks(c.where(F.length("notes") > 0).select("row_id", "notes"), "notes", 40).select("row_id", "frame", F.length("chunk").alias("size"))


@query("g12_partials", "documents", sql=f"SELECT doc_id, unnest([string_split_regex(trim(text, {_WS}), '\\s+')[1], trim(text, {_WS})]) AS said, unnest([false, true]) AS final FROM documents WHERE trim(text, {_WS}) <> ''")
def _(d):
    t = tx.strip(F.col("text"))
    return d.where(t != "").select("doc_id", F.inline(F.array(F.struct(F.get(F.split(t, r"\s+"), F.lit(0)).alias("said"), F.lit(False).alias("final")), F.struct(t.alias("said"), F.lit(True).alias("final")))))


# --- redaction ---------------------------------------------------------------------------------------------------------------------------

#: RE2 has no look-around: two patterns written out for the SQL.
_WRITTEN_OUT = {"national_id_us": r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6[0-57-9]\d|66[0-57-9])[- ](?:0[1-9]|[1-9]\d)[- ](?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"}
_TEXTS_SQL = """t AS (SELECT row_id, generate_subscripts(turns, 1) - 1 AS turn, unnest(list_transform(turns, lambda x: x.text)) AS text FROM call_records
UNION ALL SELECT row_id, coalesce(len(turns), 0), transcript FROM call_records UNION ALL SELECT row_id, coalesce(len(turns), 0) + 1, notes FROM call_records)"""


def _quoted(regex: str) -> str:
    return regex.replace("'", "''")


@query("r1_pattern_counts", "call_records", sql="WITH " + _TEXTS_SQL + " SELECT pattern, sum(n)::BIGINT AS n, count(*) AS texts FROM (" + " UNION ALL ".join(
    f"SELECT '{p.name}' AS pattern, len(regexp_extract_all(text, '{_quoted(_WRITTEN_OUT.get(p.name, p.regex))}')) AS n FROM t WHERE text IS NOT NULL" for p in redaction.PATTERNS) + ") WHERE n > 0 GROUP BY 1")
def _(c):
    counts = F.array(*[F.struct(F.lit(p.name).alias("pattern"), F.regexp_count("text", F.lit(p.regex)).alias("n")) for p in redaction.PATTERNS])
    return (_texts(c).where(F.col("text").isNotNull()).select(F.inline(counts)).where("n > 0").groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("texts")))


@query("r10_raw_leaks", "call_records", sql="WITH " + _TEXTS_SQL + " SELECT row_id AS record, turn, regexp_matches(text, '(^|[^\\[\\w])(?:\\d[ -]?){15,}\\d\\b') AS long_digit_run FROM t WHERE text IS NOT NULL")
def _(c):
    return _texts(c).where(F.col("text").isNotNull()).select("record", "turn", F.col("text").rlike(redaction.LONG_DIGITS).alias("long_digit_run"))


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, (length(d) - i + 1)::INT, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(d, (length(d) - i + 1)::INT, 1)::INT + 1] END)) % 10 = 0"


@query("r2_luhn", "lineitem", sql=f"SELECT l_orderkey, l_linenumber, {_LUHN} AS ok FROM (SELECT l_orderkey, l_linenumber, '4' || lpad((l_orderkey * 104729 + l_partkey)::VARCHAR, 15, '0') AS d FROM lineitem)")
def _(li):
    from ..functions.validators import luhn

    return li.select("l_orderkey", "l_linenumber", luhn(F.concat(F.lit("4"), F.lpad((F.col("l_orderkey") * 104729 + F.col("l_partkey")).cast("string"), 15, "0"))).alias("ok"))


@query("r4_iban", "orders", sql="SELECT o_orderkey, (lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 14, '1') || '1112' || '1611' || lpad((o_orderkey % 97)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS ok FROM orders")
def _(o):
    from ..functions.validators import iban

    account = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 14, "1")
    return o.select("o_orderkey", iban(F.concat(F.lit("GB"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), account, F.lit("BC"))).alias("ok"))


@query("r12_wholesale", "customer", sql="SELECT c_custkey, '[CUSTOMER_NAME_1]' AS text, length(c_name) AS span_end FROM customer WHERE c_name IS NOT NULL")
def _(c):
    v = redaction.redact_value(F.col("c_name"), "customer_name")
    return c.where(F.col("c_name").isNotNull()).select("c_custkey", v["text"].alias("text"), v["span"]["e"].alias("span_end"))


@query("r23_weakest", "lineitem", sql="SELECT l_orderkey, CASE max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'UNVERIFIED' ELSE 'DIRTY' END AS status FROM lineitem GROUP BY 1")
def _(li):
    status = F.when(F.col("l_returnflag") == "A", "CLEAN").when(F.col("l_returnflag") == "N", "UNVERIFIED").otherwise("DIRTY")
    return li.groupBy("l_orderkey").agg(redaction.weakest(status).alias("status"))


QUERIES["r21_run_stats"] = lambda spark, d: redaction.run_stats(QUERIES["r20_record_verdicts"](spark, d))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
