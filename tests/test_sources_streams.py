import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from turnmill.sources import readers, sinks
from turnmill.streaming import sessions


def test_json_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n[1]\n{"id": 2}\n')
    (tmp_path / "b.json").write_text('[{"id": 3}, 4, null, {"id": 5}]')
    got = readers.json_objects(spark, str(tmp_path)).select(F.try_variant_get("v", "$.id", "int")).collect()
    assert sorted(r[0] for r in got) == [1, 2, 3, 5]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text('flags,instruction,category,intent,response\nB,hello,A Cat,Do It,"yes, sir"\n,,x,y,z\nB,again,,,\n')
    got = readers.labelled_csv(spark, str(tmp_path / "l.csv")).orderBy("record_id", "turn").collect()
    assert [(r["record_id"], r["speaker"], r["text"], r["intent"]) for r in got] == [("l:0", "caller", "hello", "do_it"), ("l:0", "human_agent", "yes, sir", "do_it"), ("l:2", "caller", "again", "unknown")]
    (tmp_path / "m.csv").write_text("cid,who,said,from\nc1,Agent,hi,-5\nc1,client,  ,3\nc1,IVR,x,12.5\n")
    rows = readers.mapped_csv(spark, str(tmp_path / "m.csv"), {"conversation_id": "cid", "speaker": "who", "text": "said", "start_ms": "from"}).collect()
    assert [(r["speaker"], r["text"], r["start_ms"], r["end_ms"]) for r in rows] == [("human_agent", "hi", None, None), ("ivr", "x", 12, None)]


def test_row_numbers_count_per_file(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"f{k:02}.csv").write_text("instruction,intent\n" + f"ask {k},x\n,y\nmore {k},z\n")
    got = {r["record_id"]: r["text"] for r in readers.labelled_csv(spark, str(tmp_path)).collect()}
    assert got == {f"f{k:02}:{n}": f"{w} {k}" for k in range(12) for n, w in ((0, "ask"), (2, "more"))}


def test_scripts_and_zips(spark, tmp_path):
    df = spark.createDataFrame([(1, "Agent: hi\n\n[Caller] hello\n(bot) – beep\nCUSTOMER - yes\n[laughter] ha\nuser says no"), (2, None)], "i long, s string")
    assert [(r["speaker"], r["text"]) for r in readers.script_turns(df, "i", "s").orderBy("turn").collect()] == [("human_agent", "hi"), ("caller", "hello"), ("bot", "beep"), ("caller", "yes"), ("caller", "[laughter] ha"), ("caller", "user says no")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.json", json.dumps({"words": [{"text": "hi", "start": 0, "end": 5}, {"text": " "}, 3]}))
        z.writestr("b.json", "{")
        z.writestr("__MACOSX/a.json", "{}")
    got = readers.zipped_words(spark, str(tmp_path)).collect()
    assert [(r["member"], r["text"], r["end_ms"]) for r in got] == [("a.json", "hi", 5.0)]


def test_sinks(spark, tmp_path):
    at = datetime.datetime(2025, 1, 2, 23, 59)
    rows = [(i, "s", at, i == 0, "dirty:x", "t") for i in range(30)]
    df = spark.createDataFrame(rows, "record_id long, source string, at timestamp, quarantined boolean, reason string, words string")
    stats = sinks.write_call_logs(df, str(tmp_path / "o"))
    assert stats["emitted"] == 29
    assert readers.call_logs(spark, str(tmp_path / "o"), "s").count() == 29
    assert spark.read.json(str(tmp_path / "o/_quarantine")).columns == ["reason", "record_id"]
    with pytest.raises(ValueError):
        sinks.write_call_logs(df.limit(2), str(tmp_path / "o"))
    with pytest.raises(ValueError):
        sinks.write_call_logs(df.limit(0), str(tmp_path / "o"))
    assert readers.call_logs(spark, str(tmp_path / "o"), "s").count() == 29  # what was there stays
    with pytest.raises(ValueError):
        sinks.guard(df.withColumn("Text", F.lit("x")))


def test_vector_cache_encodes_once(spark, tmp_path):
    seen = []

    def encode(d):
        seen.append(d.count())
        return d.withColumn("vector", F.array(F.length("text").cast("double")))

    t = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    assert sinks.cached_vectors(spark, t, str(tmp_path / "c"), "m", encode).count() == 2
    assert sinks.cached_vectors(spark, t.union(spark.createDataFrame([("ccc",)], "text string")), str(tmp_path / "c"), "m", encode).count() == 3
    assert seen == [2, 1]


def test_keypad_entries_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2025, 1, 1)
    keys = [("s", t0 + datetime.timedelta(seconds=s), k) for s, k in ((0, "1"), (1, "*"), (2, "4"), (3, "2"), (4, "#"), (5, "9"), (20, "7"), (40, "*"))]
    df = spark.createDataFrame(keys, "session string, at timestamp, key string")
    want = [(r["session"], r["digits"]) for r in sessions.keypad_entries(df).orderBy("began").collect()]
    assert want == [("s", "42"), ("s", "7")]
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = (sessions.keypad_entries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("keys").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    # the last window stays open behind the watermark
    assert ("s", "42") in [(r["session"], r["digits"]) for r in spark.table("keys").collect()]


def test_speech_turns_stream_equals_batch(spark, tmp_path):
    loud = [0] * 2 + [1] * 6 + [0] * 2 + [1] * 3 + [0] * 8 + [1] * 3
    frames = spark.createDataFrame([("s", i * 20, 0.5 * x) for i, x in enumerate(loud)], "session string, ts_ms long, rms double")
    want = sorted(tuple(r) for r in sessions.speech_turns(frames).collect())
    assert want == [("s", 40, 260)]
    frames.repartition(1).write.parquet(str(tmp_path / "in"))
    q = (sessions.speech_turns(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("speech").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("speech").collect()) == want


def test_pushed_rows_come_once(spark, tmp_path):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n")], "id string, at int, v string")
    assert sinks.push_once(d, str(tmp_path / "t"), "id", "at") == 2 and sinks.push_once(d, str(tmp_path / "t"), "id", "at") == 0
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["y", "z"]


def test_taxonomies_are_one_object_each(spark, tmp_path):
    n = spark.createDataFrame([("t", "b", 2), ("t", "a", 1), ("u", "c", 1)], "taxonomy_id string, intent_id string, level int")
    sinks.write_taxonomy(n, str(tmp_path / "x"))
    assert {r["taxonomy_id"]: [x["intent_id"] for x in r["nodes"]] for r in spark.read.json(str(tmp_path / "x")).collect()} == {"t": ["a", "b"], "u": ["c"]}


def test_generated_records_are_the_same_and_their_cards_valid(spark):
    from turnmill.functions.validators import luhn
    from turnmill.sources.generated import conversations

    a, b = conversations(spark, 300, 5, pii=0.5), conversations(spark, 10, 5, pii=0.5, limit=300).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 900
    told = a.where("text LIKE '%my card is%'").select(luhn(F.substring_index("text", " ", -1)).alias("ok")).collect()
    assert 90 < len(told) < 210 and all(r["ok"] for r in told)
    assert conversations(spark, 300, 6).exceptAll(conversations(spark, 300, 5)).count() > 0


def test_audio(spark):
    import struct

    from turnmill.streaming import audio

    d = spark.createDataFrame([(bytearray(struct.pack("<4h", 16384, -16384, 16384, -16384) + b"\1"),), (bytearray(),), (None,)], "pcm binary")
    assert [r[0] for r in d.select(audio.rms(F.col("pcm"))).collect()] == [0.5, 0.0, None]
    assert [(r["frame"], bytes(r["chunk"])) for r in audio.chunks(spark.createDataFrame([(bytearray(b"abcde"),), (None,)], "b binary"), "b", 2).orderBy("frame").collect()] == [(0, b"ab"), (1, b"cd"), (2, b"e")]
    frames = audio.scripted_frames(spark, [(40, 200, 200)]).withColumn("session", F.lit("s"))
    assert [tuple(r) for r in sessions.speech_turns(frames).collect()] == [("s", 40, 240)]
    e = spark.createDataFrame([("s", 1, 300), ("s", 2, 100), ("s", 3, None)], "session string, at_ms int, played_ms int")
    assert [(r["at_ms"], r["action"]) for r in audio.may_interrupt(e).orderBy("step").collect()] == [(1, "clear_playback"), (1, "cancel_speech"), (1, "cancel_turn")]
    assert audio.may_interrupt(e, enabled=False).count() == 0


def test_unknown_source_names_the_known():
    with pytest.raises(ValueError, match="labelled_csv"):
        readers.source_reader("tape")
