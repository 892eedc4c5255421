import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import validators
from turnmill.operators import redaction as R
from turnmill.plans import catalogue


def run(spark, rows):
    return R.redact_turns(spark.createDataFrame(rows, "record long, turn int, text string, spans string, n int"))


def test_numbering_overlaps_and_leaks(spark):
    rows = [(1, 0, "mail a@y.co then b@y.co", None, 1), (1, 1, "again B@y.co or +1 312 555 0144", None, 1), (2, 0, "num 1234567890123456 x", "x", None), (3, 0, None, None, None), (3, 1, "", None, None)]
    got = {(r["record"], r["turn"]): r for r in run(spark, rows).collect()}
    assert got[1, 0]["text"] == "mail [EMAIL_2] then [EMAIL_1]"
    assert got[1, 1]["text"] == "again [EMAIL_1] or [PHONE_1]"
    assert got[2, 0]["status"] == "DIRTY" and got[2, 0]["text"] == "" and got[2, 0]["residual"] == ["long_digit_run"]
    assert got[3, 0]["text"] is None and got[3, 1]["text"] == "" and got[3, 1]["status"] == "CLEAN"
    v = {r["record"]: r for r in R.record_verdicts(run(spark, rows)).collect()}
    assert v[2]["reason"] == "dirty:long_digit_run" and not v[1]["quarantined"]


def test_offsets_equal_pythons(spark):
    texts = ["x 12-3456 a@b.co é a.b@c.org", "my name is Ann Lee and this is Bob", "ssn 123-45-6789 and 078-05-1120", "", "GB29 NWBK 6016 1331 9268 19"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in R.PATTERNS:
        if p.check:
            continue
        for t, spans in df.select("t", R.pattern_spans(F.col("t"), p)).collect():
            assert [(s["s"], s["e"]) for s in spans] == [m.span(p.group) for m in re.finditer(p.regex, t)], p.name


def test_validators(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "021000021", "GB29 NWBK 6016 1331 9268 19"), ("4111111111111112", "021000022", "GB28NWBK60161331926819"), (None, None, None)], "c string, a string, i string")
    assert [tuple(r) for r in df.select(validators.luhn(F.col("c")), validators.aba(F.col("a")), validators.iban(F.col("i"))).collect()] == [(True,) * 3, (False,) * 3, (False,) * 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "zed"]), st.sampled_from(["x.co", "mail.org"])), min_size=1, max_size=4))
def test_never_leaks_and_is_idempotent(spark, parts):
    text = " and ".join(f"write to {a}@{b}" for a, b in parts)
    once = run(spark, [(1, 0, text, None, None)]).first()["text"]
    assert "@" not in once
    assert run(spark, [(1, 0, once, None, None)]).first()["text"] == once


def test_detokenize_and_empty(spark):
    df = spark.createDataFrame([("hi [EMAIL_1] [PHONE_9]", {"[EMAIL_1]": "a@y.co"})], "t string, v map<string,string>")
    assert df.select(R.detokenize(F.col("t"), F.col("v"))).first()[0] == "hi a@y.co [PHONE_9]"
    assert run(spark, []).count() == 0


def test_queries_read_turns_transcript_and_notes(spark, tmp_path):
    rows = [
        (1, [("a", "mail a@y.co"), None, ("b", "num 1234567890123456 x")], None, "from A@y.co or b@y.co"),
        (2, None, "call +1 312 555 0144", None), (3, None, None, None), (4, [("a", None)], None, "num 1234567890123456 x"),
    ]
    spark.createDataFrame(rows, "row_id long, turns array<struct<speaker:string,text:string>>, transcript string, notes string").write.parquet(f"{tmp_path}/call_records.parquet")
    q = {n: catalogue.queries()[n](spark, str(tmp_path)).collect() for n in ("r9_redacted_notes", "r18_entity_counts", "r20_record_verdicts", "r1_text_counts")}
    texts = {(r["record"], r["turn"]): r["text"] for r in q["r9_redacted_notes"]}
    assert texts == {(1, 0): "mail [EMAIL_1]", (1, 1): None, (1, 2): "", (1, 4): "from [EMAIL_1] or [EMAIL_2]", (2, 0): "call [PHONE_1]", (3, 0): None, (4, 0): None, (4, 2): ""}
    verdicts = {r["record"]: (r["turns"], r["quarantined"], r["reason"], r["entities"]) for r in q["r20_record_verdicts"]}
    assert verdicts == {1: (4, True, "dirty:long_digit_run", 3), 2: (1, False, None, 1), 3: (1, False, None, 0), 4: (2, True, "dirty:long_digit_run", 0)}
    assert {r["entity"]: r["n"] for r in q["r18_entity_counts"]} == {"email": 3, "phone": 1}
    assert {(r["record"], r["turn"]): r["emails"] for r in q["r1_text_counts"]} == {(1, 0): 1, (1, 2): 0, (1, 4): 2, (2, 0): 0, (4, 2): 0}
