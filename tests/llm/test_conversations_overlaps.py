import random

from turnmill.llm import conversations as C
from turnmill.llm import overlaps as O

M = "message_id long, conversation_id string, speaker string, text string, start_ms string, segment long, role string"


def test_verdicts(spark):
    rows = []
    add = lambda c, *ms: rows.extend((len(rows) + i, c, *m, 1, "x") for i, m in enumerate(ms))
    add("ok", ("Customer ", "hi", "5"), ("BOT", "yes", "9.0"), ("ivr", "wait", "9"), ("bot", " yes ", "9"))
    add("empty", ("ivr", "wait", "1"), ("user", "  ", "2"))
    add("blank", (None, None, None))
    add("norole", ("?", "x", "1"), ("agent", "y", "2"))
    add("nostart", ("user", "x", "NaN:NaN"), ("agent", "y", "2"))
    add("negative", ("user", "x", "-3"), ("agent", "y", "2"))
    add("tie", ("user", "x", "7"), ("agent", "y", "7.0"))
    add("oneside", ("user", "x", "7"), ("member", "y", "8"))
    add("badivr", ("ivr", "x", "late"), ("user", "y", "1"), ("rep", "z", "2"))
    add(None, ("user", "x", "1"))
    df = spark.createDataFrame(rows, M)
    assert {r[0]: r[1] for r in C.dropped(df).collect()} == {
        "empty": "empty", "blank": "empty", "norole": "broken", "nostart": "broken", "negative": "broken", "tie": "broken", "oneside": "no_reply", "badivr": "broken"}
    got = [(r["position"], r["role"], r["text"], r["deliveries"]) for r in C.rebuild_conversations(df).orderBy("position").collect()]
    assert got == [(0, "caller", "hi", 1), (1, "ivr", "wait", 1), (2, "agent", "yes", 2)]
    assert C.dropped(df.limit(0)).count() == 0 and C.rebuild_conversations(df.limit(0)).count() == 0


def test_positions_across_segments(spark):
    starts = random.Random(1).sample(range(0, 40 * C.SEGMENT_MS * 60, 997), 300)
    df = spark.createDataFrame([(i, "hot", "user" if i % 2 else "agent", f"t{i}", str(s), 0, "") for i, s in enumerate(starts)], M)
    got = C.rebuild_conversations(df).orderBy("position").collect()
    assert [r["start_ms"] for r in got] == sorted(map(float, starts)) and [r["position"] for r in got] == list(range(300))


S = "row_id long, intent string, split string, source string, instruction string, train boolean, n int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_pairs_equal_brute_force(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    base = [[r.choice(vocab) for _ in range(r.randint(3, 12))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice(vocab)], [w[k], "new"]])
            w = w or ["x"]
        rows.append((i, r.choice(["Open-Return", "open_return ", "other", None]), r.choice(["train", "train", "dev", "test"]), "s", " ".join(w), None, 1))
    rows += [(900, "other", "train", "s", "Ça va, l'été est là: 12.50!", None, 1), (901, "OTHER", "test", None, "ca  va lete est la 1250", None, 1), (902, "other", "test", "s", None, None, 1), (903, "other", None, "s", "a b c d e", None, 1), (None, "other", "train", "s", "a b c d e", None, 1)]
    got = {(x["row_a"], x["row_b"]): x["edits"] for x in O.cross_split_pairs(spark.createDataFrame(rows, S)).collect()}
    want = {}
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    for a in rows:
        for b in rows:
            if a[0] is None or b[0] is None or a[2] != "train" or b[2] not in ("dev", "test") or not key(a[1]) or key(a[1]) != key(b[1]) or not a[4] or not b[4]:
                continue
            wa, wb = O.plain_words(a[4]), O.plain_words(b[4])
            if len(wa) >= 5 and len(wb) >= 5:
                e = 0 if "".join(wa) == "".join(wb) else edits(wa, wb)
                if e <= 3:
                    want[min(a[0], b[0]), max(a[0], b[0])] = e
    assert got == want and (900, 901) in got


def test_empty_and_report(spark):
    df = spark.createDataFrame([], S)
    assert O.cross_split_pairs(df).count() == 0 and O.overlap_report(df).count() == 0
    a = ("a b c d e f", None, 1)
    df = spark.createDataFrame([(1, "i", "train", "s", *a), (2, "I", "dev", "s", *a), (3, "i", "test", None, *a), (4, "i", "dev", "s", "q", None, 1)], S)
    got = {(r["split"], r["source"]): (r["rows"], r["overlapping_rows"], r["exact_pairs"]) for r in O.overlap_report(df).collect()}
    assert got == {("dev", "s"): (2, 1, 1), ("test", None): (1, 1, 1)}
