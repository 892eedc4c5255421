from turnmill.llm import pairs, speech

P = "row_id long, instruction string, response string, source string, defect string, last string"


def found(spark, rows):
    return {r["row_id"]: r["defect"] for r in pairs.broken_pairs(spark.createDataFrame(rows, P)).collect()}


def test_defects_one_each(spark):
    good = "I have checked this and the entry is now with the desk. Thank you for your patience"
    ask = "where is the parcel that I sent back on Monday"
    rows = [(i, ask, good, "s", "x", "y") for i in range(10)]
    rows += [
        (20, ask, None, None, None, None), (21, ask, " \n", None, None, None), (22, ask, "<p></p>", None, None, None), (23, ask, "N/A", None, None, None),
        (24, ask, "You asked: " + ask.upper() + "?", None, None, None), (25, ask, ask + " " + ask, None, None, None),
        (26, ask, "I'm sorry, but I can't help with that. Please contact another service.", None, None, None),
        (27, ask, "I can't see a second entry, but the first one is clear. It leaves today.", None, None, None),
        (28, ask, "I have checked this and the entry is no", None, None, None), (29, ask, "Next,", None, None, None), (30, ask, "Do this:\n1. Open the page\n2.", None, None, None),
        (31, ask, "Ich habe das geprüft, und die Stelle erledigt es am Montag.", None, None, None), (32, ask, 'It is done. The box reads "Vorsicht, nicht kippen".', None, None, None),
        (33, " ", None, None, None, None), (34, None, None, None, None, None), (None, ask, None, None, None, None), (35, ask, "word " * 40_000 + "end.", None, None, None),
    ]
    assert found(spark, rows) == {20: "empty", 21: "empty", 22: "empty", 23: "empty", 24: "copied", 25: "copied", 26: "refusal", 28: "truncated", 29: "truncated", 30: "truncated", 31: "wrong_language"}


def test_continued_counts_equal_brute_force(spark):
    import random

    random.seed(4)
    lines = ["".join(random.choice("ab ") for _ in range(random.randint(1, 14))) for _ in range(200)]
    inv = spark.createDataFrame([(x, lines.count(x), 0, 2 * lines.count(x)) for x in set(lines)], "line string, n long, n_complete long, copies long")
    asked = {x[: random.randint(1, len(x))] for x in lines}
    got = {r["line"]: (r["ends"], r["goes_on"]) for r in pairs._continued(spark, spark.createDataFrame([(x,) for x in asked], "line string"), inv).collect()}
    assert got == {q: (lines.count(q), sum(x.startswith(q) and x != q for x in lines)) for q in asked}


def test_empty_table_and_peaks(spark):
    assert found(spark, []) == {}
    rows = [("x", n, 1000 * n + k) for n in range(100, 200) for k in range(90 if n == 150 else 10)] + [("x", 6000, k) for k in range(80)] + [("x", 170, 170_000)] * 500
    peaks = pairs._peaks(spark.createDataFrame(rows, "last string, length int, text long")).collect()
    assert sorted(r["length"] for r in peaks) == [150, 6000]  # copies make no peak, long limits are seen


def test_copies_of_a_cut_response_are_cut_all_the_same(spark):
    ask, full = "where is my parcel", "I have looked into it and the parcel is on its way to you with the second carrier"
    rows = [(i, ask, f"{full}, number {i}.", None, None, None) for i in range(3)] + [(100 + i, ask, "I have looked into it and the parcel is on its w", None, None, None) for i in range(40)]
    assert found(spark, rows) == {100 + i: "truncated" for i in range(40)}


def roles(transcript=None, items=None):
    return [t[0] for t in speech.turns_of(transcript, items)]


def test_layouts_of_transcripts():
    assert roles("[00:00:05] Client: yes\n[00:00:02] Agent: hi, how can I help?\n[00:00:09] Client: um.") == ["human_agent", "caller"]
    assert roles("00:00:01,025 --> 00:00:01,425\n**AGENT**: hello\n\n00:00:04,1 --> 00:00:05,0\n**Member**: uh-huh\nyes please") == ["human_agent", "caller"]
    assert roles("S1: Thank you for calling, how can I help?\nS2: hm, my rug\nS1: [music]\nS2: it broke") == ["human_agent", "caller"]
    assert roles("Speaker A: my rug broke | Speaker B: Good morning, you are through to us") == ["caller", "human_agent"]
    assert roles("Feria (Rep)> hi  CUSTOMER> hello  BOT> wait") == ["human_agent", "caller", "bot"]
    assert roles("Let me read it back: 12") == ["caller"] and roles("") == [] and roles(None) == []


def test_items_and_dirt(spark):
    items = [{"speaker": "IVR", "text": "press one"}, {"speaker": "", "text": "CSR: hello"}, {"speaker": None, "text": "(typing)"}, None, {"speaker": "User:", "text": "*sighs*"}, {"speaker": " user", "text": None}, {"speaker": "Agent", "text": "[00:09:10] so"}]
    assert roles(None, items) == ["ivr", "human_agent"]
    df = spark.createDataFrame([(1, None, [], "n"), (2, "A: x", None, None), (None, "Caller: y", None, None), (1, None, [("caller", "okay")], "n")], "row_id long, transcript string, turns array<struct<speaker:string,text:string>>, label string")
    got = sorted((r["row_id"] or 0, r["turn_no"], r["speaker"]) for r in speech.speaker_turns(df).collect())
    assert got == [(0, 0, "caller"), (1, 0, "caller"), (2, 0, "human_agent")]
    assert speech.speaker_turns(df.limit(0)).count() == 0


def test_label_clusters():
    c = speech.cluster_labels(["rep", "representative", "csr", "customer service representative", "custommer", "customer", "s1", "s2"])
    assert c["rep"] == c["representative"] and c["csr"] == c["customer service representative"] and c["custommer"] == "customer" and c["s1"] != c["s2"]
    assert speech.clean("Um, the *sighs* rug, you know, broke. [music]") == "the rug, broke."
