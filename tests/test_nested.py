import json

from turnmill.operators import nested

D = "row_id long, dialogue_id string, payload string, v string, record_id string"
T = "taxonomy_id string, payload string, nodes string, l0 string"


def test_dialogue_arrangements_and_dirt(spark):
    rows = [
        (1, "a", json.dumps({"turns": [{"text": "x"}, None, {"text": "y"}]}), "c", "c"),
        (2, "b", json.dumps(json.dumps({"utterances": {"transcript": "z"}})), None, None),
        (3, "c", json.dumps([{"utterances": [{"a": 1}]}, {"turns": [{"b": 1}]}]), None, None),
        (4, "d", '{"turns": [', None, None), (5, "e", None, None, None), (6, "f", "null", None, None), (7, "g", "", None, None),
        (8, None, json.dumps({"turns": [{"text": "x"}]}), None, None), (9, "a", json.dumps({"turns": [{"text": "x"}]}), None, None),
    ]
    got = sorted((r["record_id"] or "", r["position"]) for r in nested.dialogue_items(spark.createDataFrame(rows, D)).collect())
    assert got == [("", 0), ("a", 0), ("a", 0), ("a", 2), ("b", 0), ("c", 0), ("c", 0)]


def test_taxonomy_arrangements(spark):
    deep = {"intent_id": "p", "children": [{"intent_id": "p.q", "slots": {"name": "s"}, "children": [{"intent_id": "p.q.r", "volume": {"utterance_count": "12"}}]}]}
    rows = [
        ("t1", json.dumps({"nodes": [deep, None]}), None, None),
        ("t2", json.dumps({"data": {"taxonomy": {"nodes": {"k": {"parent_id": "gone", "volume": {"utterance_count": "n/a"}, "automation": {"thresholds": {"complexity": 0.5}}}}}}}), None, None),
        ("t3", json.dumps({"nodes": [{"intent_id": "m", "parent_id": "", "slots": [{"name": "a"}, {"name": None}, None], "volume": None, "automation": None}]}), None, None),
        ("t4", "{", None, None), ("t5", None, None, None), (None, json.dumps({"nodes": []}), None, None),
    ]
    snap = spark.createDataFrame(rows, T)
    keys = nested.parent_child_keys(spark.createDataFrame([], D), snap)
    got = sorted(tuple(r) for r in keys.collect())
    assert got == sorted([
        ("t1", "node", "t1", "p"), ("t1", "node", "p", "p.q"), ("t1", "node", "p.q", "p.q.r"), ("t1", "slot", "p.q", "s"), ("t1", "volume", "p.q.r", "utterance_count"),
        ("t2", "node", "gone", "k"), ("t2", "thresholds", "k", "complexity"), ("t3", "node", "t3", "m"), ("t3", "slot", "m", "a")])


def test_nodes_of_any_depth(spark):
    node = {"intent_id": "n11", "slots": [{"name": "s"}], "volume": {"utterance_count": 3}}
    for k in range(10, 0, -1):
        node = {"intent_id": f"n{k}", "children": {f"n{k + 1}": node} if k == 8 else [node]}
    tables = nested.taxonomy_tables(spark.createDataFrame([("t", json.dumps({"nodes": [node]}), None, None)], T))
    assert {(r["parent_id"], r["intent_id"]) for r in tables["nodes"].collect()} == {(f"n{k - 1}" if k > 1 else None, f"n{k}") for k in range(1, 12)}
    assert [(r["intent_id"], r["name"]) for r in tables["slots"].collect()] == [("n11", "s")] and tables["volumes"].count() == 1


def test_empty(spark):
    assert nested.parent_child_keys(spark.createDataFrame([], D), spark.createDataFrame([], T)).count() == 0
    assert nested.utterances(spark.createDataFrame([], D)).count() == 0
