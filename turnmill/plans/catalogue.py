"""All queries of the library outside llm, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validators, vectors
from ..operators import evals, mining, nested, ordered, redaction
from ..sources import readers
from ..streaming import sessions
from ..tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Registers a function of the tables' DataFrames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, d: f(*[load(spark, d, t) for t in tables])
        if sql:
            SQL[name] = sql
        return f

    return add


# --- problem 6: nested records -------------------------------------------------------------------------------------------------

_JSON_SQL = """
WITH RECURSIVE
d AS (SELECT dialogue_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM dialogues),
d2 AS (SELECT dialogue_id, CASE WHEN json_type(p) = 'VARCHAR' THEN CASE WHEN json_valid(p->>'$') THEN (p->>'$')::JSON END ELSE p END AS p FROM d),
d3 AS (SELECT dialogue_id, unnest(CASE json_type(p) WHEN 'ARRAY' THEN from_json(p, '["JSON"]') WHEN 'OBJECT' THEN [p] END) AS r FROM d2),
d4 AS (SELECT dialogue_id, r->'$.turns' AS l FROM d3 UNION ALL SELECT dialogue_id, r->'$.utterances' FROM d3),
d5 AS (SELECT dialogue_id, CASE json_type(l) WHEN 'ARRAY' THEN from_json(l, '["JSON"]') WHEN 'OBJECT' THEN [l] END AS items FROM d4),
d6 AS (SELECT dialogue_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM d5),
t AS (SELECT taxonomy_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM taxonomy_snapshots),
t2 AS (SELECT taxonomy_id, CASE WHEN json_type(p) = 'VARCHAR' THEN CASE WHEN json_valid(p->>'$') THEN (p->>'$')::JSON END ELSE p END AS p FROM t),
t3 AS (SELECT taxonomy_id, unnest(CASE json_type(p) WHEN 'ARRAY' THEN from_json(p, '["JSON"]') WHEN 'OBJECT' THEN [p] END) AS r FROM t2),
t4 AS (SELECT taxonomy_id, coalesce(r->'$.data.taxonomy', r->'$.taxonomy', r)->'$.nodes' AS l FROM t3),
lists(taxonomy_id, above, l) AS (
  SELECT taxonomy_id, NULL::VARCHAR, l FROM t4
  UNION ALL
  SELECT taxonomy_id, coalesce(n->>'$.intent_id', k), n->'$.children' FROM (
    SELECT taxonomy_id, unnest(CASE json_type(l) WHEN 'ARRAY' THEN [NULL::VARCHAR] WHEN 'OBJECT' THEN CASE WHEN (l->'$.intent_id') IS NULL THEN json_keys(l) ELSE [NULL::VARCHAR] END END) AS k, above, l FROM lists WHERE json_type(l) IN ('ARRAY', 'OBJECT')) x,
    LATERAL (SELECT unnest(CASE WHEN k IS NOT NULL THEN [l->k] WHEN json_type(l) = 'ARRAY' THEN from_json(l, '["JSON"]') ELSE [l] END) AS n) y
  WHERE json_type(n) = 'OBJECT' AND (n->'$.children') IS NOT NULL),
nodes AS (
  SELECT taxonomy_id, coalesce(nullif(n->>'$.parent_id', ''), above) AS parent, coalesce(n->>'$.intent_id', k) AS id, n FROM (
    SELECT taxonomy_id, unnest(CASE json_type(l) WHEN 'ARRAY' THEN [NULL::VARCHAR] WHEN 'OBJECT' THEN CASE WHEN (l->'$.intent_id') IS NULL THEN json_keys(l) ELSE [NULL::VARCHAR] END END) AS k, above, l FROM lists WHERE json_type(l) IN ('ARRAY', 'OBJECT')) x,
    LATERAL (SELECT unnest(CASE WHEN k IS NOT NULL THEN [l->k] WHEN json_type(l) = 'ARRAY' THEN from_json(l, '["JSON"]') ELSE [l] END) AS n) y
  WHERE json_type(n) = 'OBJECT'),
slots AS (SELECT taxonomy_id, id, unnest(CASE json_type(n->'$.slots') WHEN 'ARRAY' THEN from_json(n->'$.slots', '["JSON"]') WHEN 'OBJECT' THEN [n->'$.slots'] END) AS s FROM nodes)
"""
_NUM = "(json_type({0}) IN ('BIGINT','UBIGINT','DOUBLE','HUGEINT') OR (json_type({0}) = 'VARCHAR' AND regexp_full_match({0}->>'$', '\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')))"


@query("p6_found", "dialogues", "taxonomy_snapshots", sql=_JSON_SQL + f"""
SELECT DISTINCT * FROM (
SELECT dialogue_id AS record_id, 'utterance' AS entity, dialogue_id AS parent_key, pos::VARCHAR AS child_key FROM d6 WHERE item IS NOT NULL AND json_type(item) <> 'NULL'
UNION ALL SELECT taxonomy_id, 'node', coalesce(parent, taxonomy_id), id FROM nodes WHERE id IS NOT NULL
UNION ALL SELECT taxonomy_id, 'slot', id, s->>'$.name' FROM slots WHERE id IS NOT NULL AND trim(s->>'$.name') <> ''
UNION ALL SELECT taxonomy_id, 'volume', id, 'utterance_count' FROM nodes WHERE id IS NOT NULL AND {_NUM.format("(n->'$.volume.utterance_count')")}
UNION ALL SELECT taxonomy_id, 'thresholds', id, 'complexity' FROM nodes WHERE id IS NOT NULL AND {_NUM.format("(n->'$.automation.thresholds.complexity')")})""")
def _(d, t):
    return nested.parent_child_keys(d, t)


@query("p6_utterances", "dialogues")
def _(d):
    return nested.utterances(d)


@query("p6_nodes", "taxonomy_snapshots")
def _(t):
    return nested.taxonomy_tables(t)["nodes"]


@query("p6_slots", "taxonomy_snapshots")
def _(t):
    return nested.taxonomy_tables(t)["slots"]


_SPACES = "".join(f"||chr({ord(c)})" for c in tx.SPACES)[2:]


# --- sources ------------------------------------------------------------------------------------------------------------------

_SCRIPT_SQL = f"""
l AS (SELECT key, turn0, list_filter(list_transform(string_split_regex(script, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, {_SPACES})), lambda x: x <> '') AS ls FROM scripts),
e AS (SELECT key, turn0, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
w AS (SELECT *, lower(coalesce(nullif(regexp_extract(line, '{readers.PREFIX}', 1), ''), nullif(regexp_extract(line, '{readers.PREFIX}', 2), ''))) AS who, trim(regexp_replace(line, '{readers.PREFIX}', ''), {_SPACES}) AS said FROM e),
turns AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY turn0, n) - 1 AS turn, CASE WHEN who IS NULL OR who IN ('customer','caller','client','user','member') THEN 'caller' WHEN who = 'ivr' THEN 'ivr' WHEN who IN ('bot','system') THEN 'bot' ELSE 'human_agent' END AS speaker, said AS text FROM w WHERE said <> '')
"""


@query("s6_script_turns", "call_records", sql="WITH scripts AS (SELECT row_id AS key, 0 AS turn0, transcript AS script FROM call_records)," + _SCRIPT_SQL + "SELECT key AS row_id, turn, speaker, text FROM turns")
def _(c):
    return readers.script_turns(c.where(F.col("transcript").isNotNull()), "row_id", "transcript")


@query("s7_speaker_roles", "message_rows", sql="""
SELECT CASE WHEN lower(trim(speaker)) IN ('customer','caller','client','user','member') THEN 'caller' WHEN lower(trim(speaker)) = 'ivr' THEN 'ivr' WHEN lower(trim(speaker)) IN ('bot','system') THEN 'bot' ELSE 'human_agent' END AS role, count(*) AS n FROM message_rows GROUP BY 1""")
def _(m):
    return m.groupBy(readers.role_of(F.col("speaker")).alias("role")).agg(F.count("*").alias("n"))


@query("s9_diarization_flag", "message_rows", sql="""
WITH r AS (SELECT conversation_id, CASE WHEN lower(trim(speaker)) IN ('customer','caller','client','user','member') THEN 'caller' ELSE 'agent' END AS side, count(*) AS n FROM message_rows WHERE trim(text) <> '' GROUP BY 1, 2),
c AS (SELECT conversation_id, sum(n) AS turns, count(*) AS sides, min(n) AS least FROM r GROUP BY 1)
SELECT conversation_id, turns::BIGINT AS turns, CASE WHEN turns < 4 THEN true WHEN sides = 1 THEN false ELSE least / turns >= 0.05 END AS reliable FROM c""")
def _(m):
    side = F.when(F.lower(F.trim("speaker")).isin(*readers.CALLERS), "caller").otherwise("agent")
    c = m.where(F.trim("text") != "").groupBy("conversation_id", side.alias("side")).agg(F.count("*").alias("n")).groupBy("conversation_id").agg(F.sum("n").alias("turns"), F.count("*").alias("sides"), F.min("n").alias("least"))
    return c.select("conversation_id", "turns", F.when(F.col("turns") < 4, True).when(F.col("sides") == 1, False).otherwise(F.col("least") / F.col("turns") >= 0.05).alias("reliable"))


@query("s10_labelled_turns", "instruction_pairs", sql="""
SELECT row_id, 0 AS turn, 'caller' AS speaker, trim(instruction, chr(9)||chr(10)||chr(13)||' '||chr(160)) AS text FROM instruction_pairs WHERE trim(instruction, chr(9)||chr(10)||chr(13)||' '||chr(160)) <> ''
UNION ALL SELECT row_id, 1, 'human_agent', trim(response, chr(9)||chr(10)||chr(13)||' '||chr(160)) FROM instruction_pairs WHERE trim(instruction, chr(9)||chr(10)||chr(13)||' '||chr(160)) <> '' AND trim(response, chr(9)||chr(10)||chr(13)||' '||chr(160)) <> ''""")
def _(p):
    said, back = F.nullif(tx.strip(F.col("instruction")), F.lit("")), F.nullif(tx.strip(F.col("response")), F.lit(""))
    turns = F.array_compact(F.array(F.struct(F.lit(0).alias("turn"), F.lit("caller").alias("speaker"), said.alias("text")), F.when(back.isNotNull(), F.struct(F.lit(1).alias("turn"), F.lit("human_agent").alias("speaker"), back.alias("text")))))
    return p.where(said.isNotNull()).select("row_id", F.inline(turns))


@query("s11_label_slugs", "instruction_pairs", sql="""
SELECT coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug, count(*) AS n FROM instruction_pairs GROUP BY 1""")
def _(p):
    return p.groupBy(tx.ascii_slug(F.col("intent")).alias("slug")).agg(F.count("*").alias("n"))


@query("s12_first_present", "call_records", sql="""
SELECT row_id, coalesce(nullif(trim(transcript), ''), nullif(trim(notes), '')) AS first_text FROM call_records""")
def _(c):
    return c.select("row_id", F.coalesce(F.nullif(F.trim("transcript"), F.lit("")), F.nullif(F.trim("notes"), F.lit(""))).alias("first_text"))


@query("s8_record_ids", "call_records", sql="SELECT row_id, coalesce(nullif(trim(id), ''), 'call_records:' || row_id) AS record_id FROM call_records WHERE len(turns) > 0 OR trim(transcript) <> ''")
def _(c):
    return c.where((F.size("turns") > 0) | (F.trim("transcript") != "")).select("row_id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("call_records:"), F.col("row_id"))).alias("record_id"))


@query("s15_time_units", "message_rows", sql="""
WITH x AS (SELECT message_id, CASE WHEN regexp_full_match(trim(start_ms), '[+-]?([0-9]+([.][0-9]*)?)') THEN try_cast(trim(start_ms) AS DOUBLE) END AS v FROM message_rows)
SELECT message_id, CASE WHEN v < 0 THEN NULL WHEN v > 1000 THEN round_even(v, 0)::BIGINT ELSE round_even(v * 1000, 0)::BIGINT END AS ms FROM x""")
def _(m):
    v = tx.number(F.col("start_ms"))
    return m.select("message_id", F.when(v < 0, None).when(v > 1000, F.bround(v)).otherwise(F.bround(v * 1000)).cast("long").alias("ms"))


@query("s16_consecutive_runs", "message_rows", sql="""
WITH s AS (SELECT conversation_id, CASE WHEN lag(conversation_id) OVER (ORDER BY message_id) IS DISTINCT FROM conversation_id THEN 1 ELSE 0 END AS first FROM message_rows)
SELECT conversation_id, sum(first)::BIGINT AS runs FROM s GROUP BY 1""")
def _(m):
    return ordered.runs(m, "message_id", "conversation_id", 100_000.0).groupBy("conversation_id").agg(F.sum("first").alias("runs"))


def _timed(m: DataFrame) -> DataFrame:
    return m.select("message_id", "conversation_id", tx.number(F.col("start_ms")).alias("s"), tx.number(F.col("end_ms")).alias("e")).where(F.col("s") >= 0)


@query("s21_gap_turns", "message_rows", sql="""
WITH x AS (SELECT message_id, conversation_id, CASE WHEN regexp_full_match(trim(start_ms), '[+-]?([0-9]+([.][0-9]*)?)') THEN try_cast(trim(start_ms) AS DOUBLE) END AS s, CASE WHEN regexp_full_match(trim(end_ms), '[+-]?([0-9]+([.][0-9]*)?)') THEN try_cast(trim(end_ms) AS DOUBLE) END AS e FROM message_rows),
g AS (SELECT *, CASE WHEN s - lag(e) OVER w >= 2000 THEN 1 ELSE 0 END AS new FROM x WHERE s >= 0 WINDOW w AS (PARTITION BY conversation_id ORDER BY s, message_id))
SELECT message_id, conversation_id, s, e, sum(new) OVER (PARTITION BY conversation_id ORDER BY s, message_id)::BIGINT AS turn FROM g""")
def _(m):
    return ordered.gap_turns(_timed(m), "conversation_id", "s", "e", ["message_id"], 2000.0)


@query("s23_opaque_ids", "call_records", sql="SELECT row_id, 'aix-' || substr(sha256('calls/' || coalesce(id, '')), 1, 16) AS opaque_id FROM call_records")
def _(c):
    return c.select("row_id", F.concat(F.lit("aix-"), F.substring(F.sha2(F.concat(F.lit("calls/"), F.coalesce("id", F.lit(""))), 256), 1, 16)).alias("opaque_id"))


@query("p8x_call_ids", "call_records", sql="SELECT row_id, substr(sha256(source || '|' || coalesce(id, '')), 1, 32) AS call_id FROM call_records")
def _(c):
    return c.select("row_id", F.substring(F.sha2(F.concat(F.col("source"), F.lit("|"), F.coalesce("id", F.lit(""))), 256), 1, 32).alias("call_id"))


QUERIES["f_call_ids"], SQL["f_call_ids"] = QUERIES.pop("p8x_call_ids"), SQL.pop("p8x_call_ids")


# --- filters and scalar functions ---------------------------------------------------------------------------------------------------

@query("f_length_floor", "documents", sql="SELECT doc_id FROM documents WHERE length(trim(text, chr(9)||chr(10)||chr(13)||' ')) >= 8")
def _(d):
    return d.where(F.length(F.btrim("text", F.lit("\t\n\r "))) >= 8).select("doc_id")


@query("f_placeholders", "instruction_pairs", sql="""
WITH x AS (SELECT row_id, unnest(regexp_extract_all(instruction, '\\{\\{([^{}]+)\\}\\}', 1)) AS name FROM instruction_pairs) SELECT name, count(*) AS n, count(DISTINCT row_id) AS rows FROM x GROUP BY 1""")
def _(p):
    return p.select("row_id", F.explode(F.regexp_extract_all("instruction", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows"))


_PYTHON_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MARKUP = r"\{\{" + _PYTHON_SPACE + r"*([^}]+?)" + _PYTHON_SPACE + r"*\}\}"


@query("f_naturalise", "instruction_pairs", sql=f"""
WITH x AS (SELECT row_id, string_split_regex(instruction, '{_MARKUP}') AS gaps, list_transform(regexp_extract_all(instruction, '{_MARKUP}', 1), lambda w: lower(w)) AS words FROM instruction_pairs WHERE instruction IS NOT NULL)
SELECT row_id, trim(regexp_replace(array_to_string(list_transform(gaps, lambda g, i: g || coalesce(words[i], '')), ''), '{_PYTHON_SPACE}{{2,}}', ' ', 'g'), {_SPACES}) AS text FROM x""")
def _(p):
    return p.where(F.col("instruction").isNotNull()).select("row_id", tx.strip(F.regexp_replace(tx.lower_groups(F.col("instruction"), _MARKUP), _PYTHON_SPACE + "{2,}", " ")).alias("text"))


@query("f_vocabulary", "documents", sql="""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']{3,}')) AS word FROM documents) SELECT word, count(*) AS docs FROM w WHERE word NOT IN ('the','and','for','with') GROUP BY 1 HAVING count(*) >= 3""")
def _(d):
    return d.select(F.explode(mining.vocabulary(F.col("text"), ["the", "and", "for", "with"])).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 3")


@query("f_text_hash", "documents", sql="SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(d):
    return d.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("f_slug_parts", "intent_dim", sql="SELECT intent, string_split(category || '.' || intent, '.')[1] AS l1, len(string_split(category || '.' || intent, '.')) AS depth, regexp_full_match(category || '.' || intent, '[a-z0-9]+([._-][a-z0-9]+)*') AS valid FROM intent_dim")
def _(d):
    s = F.concat_ws(".", "category", "intent")
    return d.select("intent", F.substring_index(s, ".", 1).alias("l1"), F.size(F.split(s, r"\.")).alias("depth"), s.rlike(r"^[a-z0-9]+([._-][a-z0-9]+)*$").alias("valid"))


@query("f_key_mask", "events", sql="SELECT event_id, CASE WHEN length(user_id::VARCHAR) >= 4 THEN repeat('*', length(user_id::VARCHAR)) ELSE user_id::VARCHAR END AS digits FROM events")
def _(e):
    d = F.col("user_id").cast("string")
    return e.select("event_id", F.when(F.length(d) >= 4, F.repeat(F.lit("*"), F.length(d))).otherwise(d).alias("digits"))


@query("f_partition_dates", "call_records", sql="SELECT source, strftime(called_at, '%Y-%m-%d') AS date, count(*) AS n FROM call_records GROUP BY 1, 2")
def _(c):
    return c.groupBy("source", F.date_format("called_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))


@query("f_durations", "message_rows", sql="""
WITH x AS (SELECT conversation_id, CASE WHEN regexp_full_match(trim(start_ms), '[+-]?([0-9]+([.][0-9]*)?)') THEN try_cast(trim(start_ms) AS DOUBLE) END AS s, CASE WHEN regexp_full_match(trim(end_ms), '[+-]?([0-9]+([.][0-9]*)?)') THEN try_cast(trim(end_ms) AS DOUBLE) END AS e FROM message_rows)
SELECT conversation_id, max(greatest(s, e)) - min(least(s, e)) AS duration_ms FROM x WHERE s >= 0 AND e >= 0 GROUP BY 1""")
def _(m):
    t = _timed(m).where("e >= 0")
    return t.groupBy("conversation_id").agg((F.max(F.greatest("s", "e")) - F.min(F.least("s", "e"))).alias("duration_ms"))


@query("f_checksums", "lineitem", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN length(d) = 9 AND w > 0 AND w % 10 = 0 THEN true ELSE false END AS routing_ok FROM (
SELECT l_orderkey, l_linenumber, d, list_sum(list_transform(range(1, length(d) + 1), lambda i: substr(d, i::INT, 1)::INT * [3, 7, 1][((i - 1) % 3 + 1)::INT])) AS w FROM (
SELECT l_orderkey, l_linenumber, lpad((l_orderkey * 7919 + l_partkey)::VARCHAR, 9, '0') AS d FROM lineitem))""")
def _(li):
    return li.select("l_orderkey", "l_linenumber", validators.aba(F.lpad((F.col("l_orderkey") * 7919 + F.col("l_partkey")).cast("string"), 9, "0")).alias("routing_ok"))


@query("c1_key_probing", "events", sql="SELECT event_id, coalesce(props->>'$.page', props->>'$.ref', props->>'$.k', '') AS probed FROM events")
def _(e):
    v = F.try_parse_json("props")
    return e.select("event_id", F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.page", "$.ref", "$.k")], F.lit("")).alias("probed"))


@query("c6_canonical_keys", "intent_dim", sql="SELECT intent, substr(sha256('category=' || category || '|domain=' || domain || '|risk_tier=' || risk_tier), 1, 32) AS key FROM intent_dim")
def _(d):
    m = F.create_map(F.lit("risk_tier"), F.col("risk_tier"), F.lit("domain"), F.col("domain"), F.lit("category"), F.col("category"))
    return d.select("intent", F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"), 256), 1, 32).alias("key"))


# --- redaction ----------------------------------------------------------------------------------------------------------------------

def _texts(c: DataFrame) -> DataFrame:
    """record, turn, text of all texts of a record: its turns by position (null items hold theirs), then transcript, then notes.

    With k turns the transcript is turn k and the notes are turn k + 1; a null transcript or notes gives no row. A record without
    any text has one row of null text, so it gets its verdict too.
    """
    k = F.when(F.col("turns").isNotNull(), F.size("turns")).otherwise(0)
    items = F.transform("turns", lambda t, i: F.struct(i.cast("int").alias("turn"), t["text"].alias("text")))
    ends = F.filter(F.array(F.struct(k.cast("int").alias("turn"), F.col("transcript").alias("text")), F.struct((k + 1).cast("int").alias("turn"), F.col("notes").alias("text"))), lambda x: x["text"].isNotNull())
    d = c.select(F.col("row_id").alias("record"), F.inline_outer(F.concat(F.coalesce(items, F.array().cast("array<struct<turn:int,text:string>>")), ends)))
    return d.select("record", F.coalesce("turn", F.lit(0)).alias("turn"), "text")


@query("r1_email_spans", "call_records", sql="""
WITH m AS (SELECT row_id, notes, regexp_extract_all(notes, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b') AS ms FROM call_records WHERE notes IS NOT NULL)
SELECT row_id, unnest(ms) AS surface FROM m""")
def _(c):
    p = next(p for p in redaction.PATTERNS if p.name == "email")
    return c.where(F.col("notes").isNotNull()).select("row_id", "notes", F.inline(redaction.pattern_spans(F.col("notes"), p))).select("row_id", F.expr("substring(notes, s + 1, e - s)").alias("surface"))


@query("r1_phone_counts", "call_records", sql="""
SELECT row_id, len(regexp_extract_all(notes, '\\b\\(?\\d{3}\\)?[ \\-.]\\d{3}[ \\-.]\\d{4}\\b')) AS phones FROM call_records WHERE notes IS NOT NULL""")
def _(c):
    p = next(p for p in redaction.PATTERNS if p.name == "phone_na")
    return c.where(F.col("notes").isNotNull()).select("row_id", F.size(redaction.pattern_spans(F.col("notes"), p)).alias("phones"))


@query("r1_text_counts", "call_records", sql="""
WITH t AS (SELECT row_id, generate_subscripts(turns, 1) - 1 AS turn, unnest(list_transform(turns, lambda x: x.text)) AS text FROM call_records
UNION ALL SELECT row_id, coalesce(len(turns), 0), transcript FROM call_records
UNION ALL SELECT row_id, coalesce(len(turns), 0) + 1, notes FROM call_records)
SELECT row_id AS record, turn, len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b')) AS emails, len(regexp_extract_all(text, '\\b\\(?\\d{3}\\)?[ \\-.]\\d{3}[ \\-.]\\d{4}\\b')) AS phones FROM t WHERE text IS NOT NULL""")
def _(c):
    email, phone = (next(p for p in redaction.PATTERNS if p.name == n) for n in ("email", "phone_na"))
    size = lambda p: F.size(redaction.pattern_spans(F.col("text"), p))
    return _texts(c).where(F.col("text").isNotNull()).select("record", "turn", size(email).alias("emails"), size(phone).alias("phones"))


@query("r9_redacted_notes", "call_records")
def _(c):
    return redaction.redact_turns(_texts(c)).select("record", "turn", "text", "status", F.array_join("residual", "|").alias("residual"), F.size("spans").alias("n_spans"))


@query("r20_record_verdicts", "call_records")
def _(c):
    return redaction.record_verdicts(redaction.redact_turns(_texts(c)))


@query("r18_entity_counts", "call_records")
def _(c):
    return redaction.redact_turns(_texts(c)).select(F.explode("spans").alias("x")).groupBy(F.col("x.entity").alias("entity")).agg(F.count("*").alias("n"))


# --- joins --------------------------------------------------------------------------------------------------------------------------

_INTENTS = "SELECT row_id, coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS intent FROM instruction_pairs"


def _slugged(p: DataFrame) -> DataFrame:
    return p.select("row_id", tx.ascii_slug(F.col("intent")).alias("intent"))


@query("j1_intent_lookup", "instruction_pairs", "intent_dim", sql=f"SELECT p.row_id, p.intent, i.domain, i.risk_tier FROM ({_INTENTS}) p LEFT JOIN intent_dim i USING (intent)")
def _(p, i):
    return _slugged(p).join(i.select("intent", "domain", "risk_tier"), "intent", "left").select("row_id", "intent", "domain", "risk_tier")


@query("j3_unresolved", "instruction_pairs", "intent_dim", sql=f"SELECT intent, count(*) AS n FROM ({_INTENTS}) p WHERE intent NOT IN (SELECT intent FROM intent_dim) GROUP BY 1")
def _(p, i):
    return _slugged(p).join(i, "intent", "left_anti").groupBy("intent").agg(F.count("*").alias("n"))


@query("j5_leaves", "taxonomy_snapshots", sql=_JSON_SQL + "SELECT taxonomy_id, id AS intent_id FROM (SELECT DISTINCT taxonomy_id, id FROM nodes WHERE id IS NOT NULL) a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.taxonomy_id = a.taxonomy_id AND b.parent = a.id AND b.id IS NOT NULL)")
def _(t):
    n = nested.taxonomy_tables(t)["nodes"]
    parents = n.select("taxonomy_id", F.col("parent_id").alias("intent_id"))
    return n.select("taxonomy_id", "intent_id").distinct().join(parents, ["taxonomy_id", "intent_id"], "left_anti")


@query("j6_paths", "taxonomy_snapshots", sql=_JSON_SQL + """,
one AS (SELECT taxonomy_id, id, min(parent) AS parent FROM nodes WHERE id IS NOT NULL GROUP BY 1, 2),
walk(taxonomy_id, id, up, path, depth) AS (SELECT taxonomy_id, id, parent, id, 1 FROM one UNION ALL SELECT w.taxonomy_id, w.id, o.parent, o.id || ' > ' || w.path, depth + 1 FROM walk w JOIN one o ON o.taxonomy_id = w.taxonomy_id AND o.id = w.up)
SELECT taxonomy_id, id AS intent_id, max_by(path, depth) AS path, max(depth) AS depth FROM walk GROUP BY 1, 2""")
def _(t):
    return nested.paths(nested.taxonomy_tables(t)["nodes"])


@query("j8_texts_to_encode", "documents", "instruction_pairs", sql="SELECT DISTINCT sha256(instruction) AS sha FROM instruction_pairs WHERE instruction IS NOT NULL AND sha256(instruction) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def _(d, p):
    want = p.where(F.col("instruction").isNotNull()).select(F.sha2("instruction", 256).alias("sha")).distinct()
    return want.join(d.select(F.sha2("text", 256).alias("sha")), "sha", "left_anti")


@query("j9_variants_compared", "instruction_pairs", sql=f"""
WITH a AS ({_INTENTS}), b AS (SELECT row_id, lower(trim(intent)) AS intent FROM instruction_pairs WHERE intent IS NOT NULL),
j AS (SELECT a.intent AS va, b.intent AS vb, a.row_id / 100.0 AS sa, b.row_id / 99.0 AS sb FROM a FULL JOIN b USING (row_id))
SELECT count(*) AS cases, count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) AS compared, count(*) FILTER (va = vb) AS agreed, count(*) FILTER (va IS NULL OR vb IS NULL) AS skipped, max(abs(sa - sb)) AS max_gap, round_even(count(*) FILTER (va = vb) / nullif(count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL), 0), 4) AS agreement FROM j""")
def _(p):
    # two ways to read a label: as a slug, and trimmed only where it is given
    a = _slugged(p).withColumn("score", F.col("row_id") / 100.0)
    b = p.where(F.col("intent").isNotNull()).select("row_id", F.lower(F.trim("intent")).alias("intent"), (F.col("row_id") / 99.0).alias("score"))
    return evals.agreement(a, b, "row_id", "intent", "score")


_NEAREST_SQL = """
WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM m GROUP BY 1),
s AS (SELECT vec_id, e.label, c.label AS nearest, list_dot_product(e.embedding::DOUBLE[], c.v) / c.n AS score FROM embeddings e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) AS k, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) AS second FROM s),
p AS (SELECT vec_id, label, nearest, score, score - second AS margin FROM r WHERE k = 1)
"""


def _predicted(e: DataFrame) -> DataFrame:
    return mining.nearest(e, "embedding", mining.centroids(e, "embedding", "label"), "label")


@query("j11_nearest_centroid", "embeddings", sql=_NEAREST_SQL + "SELECT vec_id, label, nearest, round(score, 6) AS score, round(margin, 6) AS margin FROM p")
def _(e):
    return _predicted(e).select("vec_id", "label", "nearest", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("j14_gold_vs_predicted", "instruction_pairs", "intent_dim", sql=f"""
SELECT count(*) AS total, count(*) FILTER (category IS NOT NULL) AS measured, count(*) FILTER (lower(trim(p.category)) = i.category) AS exact, round_even(count(*) FILTER (lower(trim(p.category)) = i.category) / nullif(count(*) FILTER (p.category IS NOT NULL), 0), 4) AS accuracy
FROM (SELECT lower(trim(category)) AS category, intent FROM (SELECT category, coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS intent FROM instruction_pairs)) p JOIN intent_dim i USING (intent)""".replace("count(*) FILTER (category IS NOT NULL)", "count(*) FILTER (p.category IS NOT NULL)"))
def _(p, i):
    c = p.select(F.lower(F.trim("category")).alias("predicted"), tx.ascii_slug(F.col("intent")).alias("intent")).join(i.select("intent", F.col("category").alias("expected")), "intent")
    return evals.accuracy(c, "expected", "predicted")


# --- aggregates ----------------------------------------------------------------------------------------------------------------------

@query("a1_counts", "call_records", sql="SELECT source, channel, count(*) AS n, count(transcript) AS with_transcript, count(turns) AS with_turns FROM call_records GROUP BY 1, 2")
def _(c):
    return c.groupBy("source", "channel").agg(F.count("*").alias("n"), F.count("transcript").alias("with_transcript"), F.count("turns").alias("with_turns"))


def _derived(p: DataFrame) -> DataFrame:
    """The rows a hierarchy is derived from; the others are held out for evaluation."""
    return p.where(mining.derivation(F.concat(F.lit("instruction_pairs:"), F.col("row_id"))))


@query("a2_labelled_counts", "instruction_pairs", sql="""
WITH s AS (SELECT coalesce(nullif(trim(regexp_replace(lower(trim(category)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS category, coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS intent
FROM instruction_pairs WHERE trim(category) <> '' AND trim(intent) <> '' AND ('0x' || substr(sha256('instruction_pairs:' || row_id), 1, 2))::INT % 2 = 0)
SELECT category, intent, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(p):
    return mining.labelled_counts(_derived(p)).select("category", "intent", "n")


_TAXONOMY_SQL = """
WITH s AS (SELECT coalesce(nullif(trim(regexp_replace(lower(trim(category)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS category, coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS intent,
 regexp_extract_all(coalesce(instruction, ''), '\\{\\{\\s*([^{}]+?)\\s*\\}\\}', 1) AS names FROM instruction_pairs WHERE trim(category) <> '' AND trim(intent) <> '' AND ('0x' || substr(sha256('instruction_pairs:' || row_id), 1, 2))::INT % 2 = 0),
l AS (SELECT category, intent, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 5),
k AS (SELECT category, intent, list_sort(list_distinct(list(coalesce(nullif(trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')))) AS slots FROM (SELECT category, intent, unnest(names) AS x FROM s) GROUP BY 1, 2),
f AS (SELECT l.*, coalesce(slots, []) AS slots FROM l LEFT JOIN k USING (category, intent)),
n AS (SELECT category AS intent_id, 1 AS level, NULL AS parent_id, category AS base, sum(n)::BIGINT AS n, ''::VARCHAR AS slots, 0.25 AS c FROM f GROUP BY category
UNION ALL SELECT category || '.' || intent, 2, category, intent, n, array_to_string(slots, ','), least(1.0, 0.25 + 0.15 * len(slots)) FROM f)
, nodes AS (SELECT intent_id, level, parent_id, array_to_string(list_transform(string_split(replace(base, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label, n AS utterance_count, round_even(n / (SELECT sum(n) FROM f), 6) AS share_of_total, slots, round_even(c, 4)::DOUBLE AS complexity, round_even(greatest(0.0, 1 - c), 4)::DOUBLE AS feasibility FROM n)
"""


@query("n9_adopt_taxonomy", "instruction_pairs", sql=_TAXONOMY_SQL + "SELECT * FROM nodes")
def _(p):
    return mining.adopt_taxonomy(_derived(p))


@query("a5_rollup", "instruction_pairs", sql="""
SELECT lower(trim(category)) AS l1, coalesce(nullif(trim(regexp_replace(lower(trim(intent)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS l2, count(*) AS n, count(DISTINCT source) AS sources, grouping(l1, l2) AS depth FROM instruction_pairs GROUP BY ROLLUP (l1, l2)""")
def _(p):
    return p.select(F.lower(F.trim("category")).alias("l1"), tx.ascii_slug(F.col("intent")).alias("l2"), "source").rollup("l1", "l2").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.grouping_id().cast("long").alias("depth"))


@query("a4_shares", "documents", sql="SELECT source, sum(n_chars)::BIGINT AS chars, round_even(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY 1")
def _(d):
    g = d.groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return g.withColumn("share", F.bround(F.col("chars") / F.sum("chars").over(Window.partitionBy(F.lit(1))), 6))


@query("a9_quadrants", "instruction_pairs", sql=_TAXONOMY_SQL + """SELECT intent_id, CASE WHEN share_of_total >= 0.05 AND complexity < 0.5 THEN 'immediate_migration' WHEN share_of_total >= 0.05 THEN 'phased_agentic'
WHEN complexity < 0.5 THEN 'self_service_scripted' ELSE 'direct_agent_route' END AS quadrant, round_even(least(utterance_count / 200, 1), 4) AS confidence FROM nodes WHERE level = 2""")
def _(p):
    return mining.adopt_taxonomy(_derived(p)).where("level = 2").select("intent_id", mining.quadrant(F.col("share_of_total"), F.col("complexity")).alias("quadrant"), F.bround(F.least(F.col("utterance_count") / 200, F.lit(1.0)), 4).alias("confidence"))


@query("a11_mean_vectors", "embeddings", sql="""
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2""")
def _(e):
    return mining.mean_vector(e, "embedding", ["label"]).select("label", F.posexplode("mean").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("mean"))


@query("a12_coverage", "instruction_pairs", sql="SELECT count(*) AS n, count(intent) AS labelled, round_even(count(intent) / count(*), 6) AS coverage, 1 - round_even(count(intent) / count(*), 6) AS noise, count(DISTINCT lower(trim(intent))) AS labels FROM instruction_pairs")
def _(p):
    cov = F.bround(F.count("intent") / F.count("*"), 6)
    return p.agg(F.count("*").alias("n"), F.count("intent").alias("labelled"), cov.alias("coverage"), (1 - cov).alias("noise"), F.countDistinct(F.lower(F.trim("intent"))).alias("labels"))


@query("a14_homogeneity", "call_records")
def _(c):
    d = c.where(F.col("transcript").isNotNull()).select("row_id", mining.vocabulary(F.col("transcript"), ["the", "and", "for", "you"]).alias("words")).where(F.size("words") >= 40)
    return mining.pair_overlap(d, "row_id", "words", 2000)


@query("a17_latency", "events", sql="SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS largest FROM events GROUP BY 1")
def _(e):
    return evals.latency(e, "event_type", "value")


@query("a20_per_label", "embeddings", sql=_NEAREST_SQL + "SELECT label, count(*) AS total, count(*) FILTER (label = nearest) AS exact, round_even(count(*) FILTER (label = nearest) / count(*), 4) AS accuracy FROM p GROUP BY 1")
def _(e):
    return evals.per_label(_predicted(e), "label", "nearest")


@query("a20_confusions", "embeddings", sql=_NEAREST_SQL + "SELECT label AS expected, nearest AS predicted, count(*) AS n FROM p WHERE label <> nearest GROUP BY 1, 2")
def _(e):
    return evals.confusions(_predicted(e), "label", "nearest")


@query("a21_digest", "call_records", sql="SELECT source, count(*) AS ids, source || '-' || substr(sha256(source || string_agg(id, '' ORDER BY id)), 1, 16) AS digest FROM (SELECT DISTINCT source, id FROM call_records WHERE id IS NOT NULL) GROUP BY 1")
def _(c):
    return ordered.set_digest(c, "source", "id")


@query("t3_worst_labels", "embeddings", sql=_NEAREST_SQL + "SELECT label, count(*) AS total, count(*) FILTER (label = nearest) AS exact, round_even(count(*) FILTER (label = nearest) / count(*), 4) AS accuracy FROM p GROUP BY 1 ORDER BY accuracy, total DESC, label LIMIT 3")
def _(e):
    return evals.per_label(_predicted(e), "label", "nearest").orderBy("accuracy", F.desc("total"), "label").limit(3)


@query("a27_order_latency", "orders", "lineitem", sql="""
WITH x AS (SELECT o_orderpriority AS stage, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT stage, count(days) AS n, quantile_disc(days, 0.5)::DOUBLE AS p50, quantile_disc(days, 0.95)::DOUBLE AS p95, quantile_disc(days, 0.99)::DOUBLE AS p99, max(days) AS largest FROM x GROUP BY 1""")
def _(o, li):
    x = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("stage"), F.date_diff("l_shipdate", "o_orderdate").cast("long").alias("days"))
    return evals.latency(x, "stage", "days")


@query("s24_dialogue_sizes", "dialogues", sql=_JSON_SQL + "SELECT dialogue_id AS record_id, count(*) AS items, max(pos)::BIGINT AS last_position FROM d6 WHERE item IS NOT NULL AND json_type(item) <> 'NULL' GROUP BY 1")
def _(d):
    return nested.dialogue_items(d).groupBy("record_id").agg(F.count("*").alias("items"), F.max("position").alias("last_position"))


@query("c11_unknown_keys", "events", sql="SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) WHERE k NOT IN ('page', 'ref') GROUP BY 1")
def _(e):
    return e.select(F.explode(F.array_except(F.json_object_keys("props"), F.array(F.lit("page"), F.lit("ref")))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- ordered, top-k, sets -------------------------------------------------------------------------------------------------------------

@query("w4_rising", "events", sql="""
SELECT event_id, coalesce(lag(value, 2) OVER w < lag(value, 1) OVER w AND lag(value, 1) OVER w < value AND value >= 25, false) AS rising FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(e):
    return ordered.rising(e, "user_id", "ts", ["event_id"], "value", 50.0).select("event_id", "rising")


@query("w6_history", "events", sql="SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ',') AS history FROM events")
def _(e):
    return ordered.history(e, "user_id", "ts", ["event_id"], "event_type", 6).select("event_id", F.when(F.size("history") > 0, F.array_join("history", ",")).alias("history"))


@query("w7_running_errors", "events", sql="SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS errors FROM events")
def _(e):
    t = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return ordered.running_sum(t, ["user_id"], "at", ["event_id"], F.when(F.col("event_type") == "error", 1).otherwise(0), "errors", 86400.0 * 30).select("event_id", F.col("errors").cast("long").alias("errors"))


@query("w3_contiguous", "lineitem", sql="SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def _(li):
    return ordered.contiguous(li, "l_orderkey", "l_linenumber", first=1)


@query("t1_exemplars", "embeddings", sql=_NEAREST_SQL + """, o AS (SELECT s.vec_id, s.label, round(s.score / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS score FROM s JOIN embeddings e USING (vec_id) WHERE s.label = s.nearest)
SELECT label, rank, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM o) WHERE rank <= 8""")
def _(e):
    j = e.join(mining.centroids(e, "embedding", "label"), "label")
    return ordered.top_k(j, "label", F.round(vectors.dot(vectors.unit(F.col("embedding")), F.col("centroid")), 9), ["vec_id"], 8).select("label", "rank", "vec_id")


@query("t2_largest", "documents", sql="SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def _(d):
    return d.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("t_top_documents", "documents", sql="SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 3")
def _(d):
    return ordered.top_k(d, "source", F.col("n_chars"), ["doc_id"], 3).select("source", "doc_id", "rank")


@query("w11_round_robin", "instruction_pairs")
def _(p):
    return ordered.round_robin(_slugged(p), "intent", "row_id", 30, 7).select("row_id", "intent", "depth")


@query("u3_common_intents", "instruction_pairs", sql="SELECT DISTINCT lower(trim(intent)) AS intent FROM instruction_pairs WHERE split = 'train' INTERSECT SELECT lower(trim(intent)) FROM instruction_pairs WHERE split = 'test'")
def _(p):
    s = p.select("split", F.lower(F.trim("intent")).alias("intent"))
    return s.where("split = 'train'").select("intent").intersect(s.where("split = 'test'").select("intent"))


@query("u4_missing", "documents", "mix_targets", sql="SELECT source FROM mix_targets EXCEPT SELECT source FROM documents")
def _(d, m):
    return m.select("source").subtract(d.select("source"))


@query("u10_duplicates", "call_records", sql="SELECT id, count(*) AS deliveries FROM call_records WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(c):
    return c.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("deliveries")).where("deliveries > 1")


# --- vectors -----------------------------------------------------------------------------------------------------------------------

@query("m3_norms", "embeddings", sql="SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(e):
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("m2_centred", "embeddings")
def _(e):
    return mining.centred(e, "embedding").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("m9_anisotropy", "embeddings", sql="""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT round((SELECT sqrt(sum(m * m)) FROM (SELECT avg(x) AS m FROM x GROUP BY i)) / (SELECT avg(n) FROM (SELECT sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id)), 6) AS ratio""")
def _(e):
    m = mining.mean_vector(e, "embedding", []).select(vectors.norm(F.col("mean")).alias("m"))
    return m.crossJoin(e.agg(F.avg(vectors.norm(F.col("embedding"))).alias("n"))).select(F.round(F.col("m") / F.col("n"), 6).alias("ratio"))


@query("m8_hashed_embedding", "instruction_pairs")
def _(p):
    return mining.hashed_embedding(p, "row_id", "instruction", 64).select("row_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


# --- streams as tables -------------------------------------------------------------------------------------------------------------------

@query("g_windowed_counts", "events", sql="SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS began, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(e):
    return sessions.windowed_counts(e, "ts", ["event_type"]).withColumn("total", F.round("total", 4))


@query("g2_keypad_entries", "events")
def _(e):
    keys = e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.substring(F.lit("0123456789*#"), (F.col("event_id") % 12 + 1).cast("int"), F.lit(1)).alias("key"))
    return sessions.keypad_entries(keys, pause="6 hours")


@query("g1_speech_turns", "events")
def _(e):
    f = e.select(F.col("user_id").cast("string").alias("session"), (F.col("event_id") * 20).alias("ts_ms"), (F.col("value") / 100.0).alias("rms"))
    return sessions.speech_turns(f, 0.3, 40, 40)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
