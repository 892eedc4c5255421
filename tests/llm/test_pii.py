import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.llm import pii, tagger
from turnmill.llm.pii_rules import label_spans

C = "row_id long, transcript string, notes string, turns array<struct<speaker:string,text:string>>, field string"
I = "row_id long, instruction string, item_pos long"


def test_gradients_equal_differences():
    m, r = tagger.Tagger.new(5, 1), np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, live, n = tagger._stack([r.integers(32, 100, k) for k in (17, 13, 13, 6)])
    y = np.zeros(x.shape[1:], np.int64)
    for j, k in enumerate(n):
        y[:k, j] = r.integers(0, tagger.TAGS, k)
    _, g = m.gradients(x, live, n, y)
    for k in m.p:
        i = tuple(int(r.integers(0, s)) for s in m.p[k].shape)
        i = (int(x[0, 0, 0]), i[1]) if k[0] == "x" else i
        old, h = m.p[k][i], 1e-5
        m.p[k][i] = old + h
        a, _ = m.gradients(x, live, n, y)
        m.p[k][i] = old - h
        b, _ = m.gradients(x, live, n, y)
        m.p[k][i] = old
        assert abs((a - b) / (2 * h) - g[k][i]) < 1e-5, k


def test_viterbi_equals_brute_force():
    m, r = tagger.Tagger.new(4, 3), np.random.default_rng(1)
    m.p["t"] = r.normal(0, 1, m.p["t"].shape).astype(np.float32)
    w = [r.integers(32, 100, n) for n in (6, 5, 3, 1)]
    for v, tags in zip(w, m.decode(w)):
        e = m.emissions(*tagger._stack([v])[:2])[:, 0]
        score = lambda q: m.p["s"][q[0]] + sum(e[t, q[t]] for t in range(len(q))) + sum(m.p["t"][a, b] for a, b in zip(q, q[1:]))
        assert tuple(tags) == max(itertools.product(range(tagger.TAGS), repeat=(len(v) + 1) // 2), key=score)


def test_decoding_runs_the_trained_network():
    m, r = tagger.Tagger.new(6, 2), np.random.default_rng(4)
    x, live, _ = tagger._stack([r.integers(32, 100, k) for k in (41, 20, 7)])
    for d in "fb":
        assert np.allclose(m._infer(x, d, live)[:, :, :-1], m._run(x, d, live)[0], atol=1e-5)


def test_tags_and_spans_of_pairs():
    spans = [(2, 7, "email"), (9, 12, "person")]
    assert tagger.spans_of(tagger.tags_of(13, spans)) == [(2, 8, "email"), (8, 12, "person")]


def test_windows_cover_and_reconcile_is_best():
    r = random.Random(1)
    for _ in range(50):
        t = "".join(r.choice("abc .\n" if _ % 2 else "abcdef ") for _ in range(r.randint(0, 900)))
        ws = pii.windows(tagger.encode(t).tobytes())
        covered = {i for a, e, _, _ in ws for i in range(a, e)}
        assert all(i in covered or not c.strip() for i, c in enumerate(t))
        owned = [i for _, _, a, e in ws for i in range(a, e)]
        assert len(owned) == len(set(owned)) and set(owned) == covered
        s = [(a, a + r.randint(1, 9), "email", r.random()) for a in (r.randint(0, 25) for _ in range(7))]
        got = {(a, e) for a, e, _ in pii.reconcile(s)}
        best = 0.0
        for k in range(1, 8):
            for q in itertools.combinations(s, k):
                if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(q, 2)):
                    best = max(best, sum(x[3] for x in q))
        assert abs(sum(max(x[3] for x in s if (x[0], x[1]) == g) for g in got) - best) < 1e-9


def test_rules():
    at = lambda t: [(t[a:e], k) for a, e, k in label_spans(t)]
    assert at("mail a.b+c@mail.example, or ann dot lee at post dot test") == [("a.b+c@mail.example", "email"), ("ann dot lee at post dot test", "email")]
    assert at("Call +44 (0)20 7946 0049 or (617) 555-0102") == [("+44 (0)20 7946 0049", "phone"), ("(617) 555-0102", "phone")]
    assert at("ORD-005275044 and $1234.50, Tracking 00347211286636388267") == []
    assert at("My ID number is 738-29-5894.") == [("738-29-5894", "national_id")]
    assert at("I live at Flat 24, 233 Corlowley Street, Marlemouth") == [("Flat 24, 233 Corlowley Street", "address")]
    assert at("Right, Mr Orrister, one moment.") == [("Orrister", "person")]
    assert at("[EMAIL_1] and [PHONE_2] already masked.") == [] and at("") == []


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("call_records", "instruction_pairs")))


def test_held_out_mentions_and_placeholders(spark, model):
    text = "Caller: My email is padoc.walaby@mail.example. I was charged twice."
    recs = spark.createDataFrame([(1, text, None, [("a", None), None, ("b", text)], "x"), (2, None, "", None, None), (None, text, None, None, None)], C)
    pairs = spark.createDataFrame([(5, "where is my order, I am Kemel Norister and my number is (617) 555-0111, please help", 1), (6, None, 1)], I)
    got = {(r["field"], r["row_id"], r["item_pos"], r["start_pos"], r["end_pos"], r["entity"]) for r in pii.mentions(recs, pairs, model).collect()}
    assert got == {("call_records.transcript", 1, 0, 20, 45, "email"), ("call_records.turns.text", 1, 2, 20, 45, "email"), ("instruction_pairs.instruction", 5, 0, 24, 38, "person"), ("instruction_pairs.instruction", 5, 0, 56, 70, "phone")}
    red = {r["row_id"]: r["text"] for r in pii.redacted(recs, pairs, model).where("field = 'call_records.transcript'").collect()}
    assert red[1] == text.replace("padoc.walaby@mail.example", "[EMAIL_1]")


def test_held_out_accuracy(spark, model):
    """Against the labels of other rows, by start and entity; what no pattern knows counts as wrong here."""
    behind = lambda t, n: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").orderBy(F.xxhash64("row_id"), "row_id").offset(n).limit(200)
    fields = pii._fields(behind("call_records", pii.TRAIN_ROWS["records"]), behind("instruction_pairs", pii.TRAIN_ROWS["pairs"]))
    texts = [r["text"] for r in fields.collect()]
    found, right, want, beyond = 0, 0, 0, 0
    for t, spans in zip(texts, pii.Finder(tagger.Tagger(model)).find(texts)):
        known = {(a, k) for a, _, k in label_spans(t)}
        found, want, right = found + len(spans), want + len(known), right + len(known & {(a, k) for a, _, k in spans})
        beyond += sum((a, k) not in known for a, _, k in spans)
    assert right / found > 0.95 and right / want > 0.95 and beyond > 0, (found, right, want, beyond)


def test_the_model_finds_what_no_pattern_knows(model):
    texts = ["as i said my naem is Tamsel Walaby and I want my money back", "you can mail me under (ann.walaby@mail.example)", "please call Mr. and Mrs Walaby back on +1 (617) 555-0144 x"]
    got = [{k for _, _, k in spans} - {k for _, _, k in label_spans(t)} for t, spans in zip(texts, pii.Finder(tagger.Tagger(model)).find(texts))]
    assert any(got)


def test_limits_and_bare_forms():
    t = 'mail "ann.lee@x.example", call (617) 555-0101. ref ORD-005275044'
    assert pii._limits(t, 5, 20, "email") == (6, 23)
    assert pii._limits(t, 30, 46, "phone") == (31, 45) == pii._limits(t, 32, 46, "phone")
    assert not pii._form_ok(t, 55, 64, "national_id") and not pii._form_ok("Anna 7", 0, 6, "person") and not pii._form_ok("no at sign", 0, 2, "email")


def test_saved_model_is_the_model(tmp_path, model):
    pii.save_model(str(tmp_path / "m.npz"), model)
    back = pii.load_model(str(tmp_path / "m.npz"))
    assert back.keys() == model.keys() and all(np.array_equal(back[k], model[k]) for k in model)


def test_placeholders_and_empty(spark):
    t = "a@b.co, A@b.co and c@d.co"
    assert pii.placeholders(t, [(0, 6, "email"), (8, 14, "email"), (19, 25, "email")]) == "[EMAIL_1], [EMAIL_1] and [EMAIL_2]"
    assert pii.mentions(spark.createDataFrame([], C), spark.createDataFrame([], I)).count() == 0


def test_long_texts_are_reconciled_over_overlapping_windows(model):
    one = "my email is padoc.walaby@mail.example and I am Kemel Norister and my number is (617) 555-0111 and "
    found = pii.Finder(tagger.Tagger(model)).find([one * 30])[0]
    assert len(found) >= 80 and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
