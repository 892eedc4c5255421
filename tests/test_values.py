import pytest
from pyspark.sql import functions as F

from turnmill.functions import values as vl
from turnmill.functions.schema import violations
from turnmill.operators import evals, nested, ordered, redaction, roles

SCHEMA = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^o-"}, "n": {"type": "integer", "minimum": 1}, "k": {"enum": ["a", "b"]}}, "additionalProperties": False}


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("payload, path", [
    ('{"id": "o-1"}', None), ('{"id": "o-1", "n": 2, "k": "b"}', None), ("{}", "$.id"), ('{"id": 7}', "$.id"), ('{"id": "x"}', "$.id"), ('{"id": "o-1", "n": 0}', "$.n"),
    ('{"id": "o-1", "k": "c"}', "$.k"), ('{"id": "o-1", "z": 1}', "$"), ("[1]", "$"), ("{", "$"), (None, "$"),
])
def test_schema(spark, payload, path):
    assert one(spark, lambda c: violations(c, SCHEMA), payload) == path


def test_unknown_schema_key():
    with pytest.raises(ValueError):
        violations(None, {"oneOf": []})


@pytest.mark.parametrize("text, want", [
    ('so ```json\n{"a": 1}\n``` then', '{"a": 1}'), ('it is {"a": {"b": "}"}} and {"c": 2}', '{"a": {"b": "}"}}'), ("no {broken", None), ("", None), (None, None), ("[1, 2]", None),
])
def test_json_in_text(spark, text, want):
    assert one(spark, vl.json_in_text, text) == want


def test_small_values(spark):
    assert one(spark, lambda c: vl.render("{a} {b} {a}", a=c), "{b}") == "{b} {b} {b}"
    assert [one(spark, vl.clamped, v, "double") for v in (None, float("nan"), -1.0, 0.4, 7.0)] == [0.0, 0.0, 0.0, 0.4, 1.0]
    assert [one(spark, vl.retry_after_ms, v) for v in ("2", " 1.5 ", "-1", "Wed, 21 Oct", None)] == [2000, 1500, None, None, None]
    assert [one(spark, lambda c: vl.slot_valid(c, ["A", "b"]), v) for v in ("a", " B ", "c", " ", None)] == [True, True, False, False, False]


def test_roles(spark):
    d = spark.createDataFrame([("bitext",)], "source string")
    assert roles.require_role(d, "judge_evaluation").count() == 1
    with pytest.raises(Exception, match="may not be used"):
        roles.require_role(d, "intent_mining").collect()
    with pytest.raises(Exception, match="may not be used"):
        roles.require_role(spark.createDataFrame([(None,)], "source string"), "intent_mining").collect()


def test_leaves_and_paths(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null, "e": {}}'), (2, "{"), (3, None)], "i long, p string")
    assert sorted((r["path"], r["value"]) for r in nested.leaves(d, ["i"], "p").collect()) == [("$.a.b[]", "1"), ("$.a.b[].c", "x")]
    n = spark.createDataFrame([("t", f"n{k}", f"n{k - 1}" if k else None) for k in range(12)] + [("t", "x", "y"), ("t", "r", "s"), ("t", "s", "r"), ("t", None, "n1")], "taxonomy_id string, intent_id string, parent_id string")
    got = {r["intent_id"]: (r["path"], r["depth"]) for r in nested.paths(n).collect()}
    assert got["n11"] == (" > ".join(f"n{k}" for k in range(12)), 12) and got["x"] == ("x", 1) and len(got) == 15


def test_runs_and_digests(spark):
    d = spark.createDataFrame([(1, "a"), (3, "a"), (4, "b"), (9, "a"), (10, None), (11, None)], "i long, v string")
    assert [r["first"] for r in ordered.runs(d, "i", "v", 2.0).orderBy("i").collect()] == [1, 0, 1, 1, 1, 0]
    c = spark.createDataFrame([("k", 0), ("k", 1), ("l", 1), ("m", 0), ("m", 0), ("n", None)], "k string, i int")
    assert {r["k"]: r["contiguous"] for r in ordered.contiguous(c, "k", "i").collect()} == {"k": True, "l": False, "m": False, "n": False}
    s = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), (None, "a"), ("k", None)], "k string, m string")
    import hashlib
    assert [tuple(r) for r in ordered.set_digest(s, "k", "m").collect()] == [("k", 2, "k-" + hashlib.sha256(b"kab").hexdigest()[:16])]
    assert ordered.set_digest(s.limit(0), "k", "m").count() == 0


def test_statuses_and_patterns(spark):
    d = spark.createDataFrame([("CLEAN",), ("UNVERIFIED",)], "s string")
    assert d.agg(redaction.weakest(F.col("s"))).first()[0] == "UNVERIFIED"
    assert d.union(spark.createDataFrame([(None,)], "s string")).agg(redaction.weakest(F.col("s"))).first()[0] == "DIRTY"
    p = redaction.Pattern("order", r"\\bORD-\\d+", "order", 0.9)
    assert redaction.merged_patterns(redaction.PATTERNS, (p,))[-1] is p
    with pytest.raises(ValueError):
        redaction.merged_patterns(redaction.PATTERNS, (redaction.PATTERNS[0],))
    with pytest.raises(ValueError):
        redaction.merged_patterns(redaction.PATTERNS, (p,), ("nothing",))
    t = spark.createDataFrame([(1, 0, "call me"), (1, 1, None)], "record int, turn int, text string")
    assert [(r["status"], r["text"]) for r in redaction.redact_turns(t, engines_ready=False).orderBy("turn").collect()] == [("UNVERIFIED", ""), ("CLEAN", None)]


def test_reports_of_nothing(spark):
    e = spark.createDataFrame([], "expected string, predicted string, unavailable boolean, timed_out boolean, ms int")
    assert evals.routing(e).first()["cases"] == 0 and evals.ranked_confusions(e).count() == 0
    assert evals.report_passed(spark.createDataFrame([], "ok boolean"), "ok").first()["passed"]
    late = spark.createDataFrame([("a.b", None, False, True, 9)], e.schema)
    assert evals.routing(late).first()["unmeasured"] == 0  # nothing was answered in this run
