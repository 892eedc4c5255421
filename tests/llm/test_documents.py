import random

import numpy as np
from pyspark.sql import functions as F

from turnmill.llm import containers, mixing, shared_spans
from turnmill.llm.fm_index import FMIndex, WaveletTree, suffix_array

D = "doc_id long, text string, lang string, source string, domain_hint string, r long, hash long, tokens long"
S = "container_kind string, capacity_tokens long, separator_tokens long"
T = "source string, target_share double, max_repeats long"


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, None, source, None, 1, 2, 3) for i, t in enumerate(texts)], D)


def test_suffix_array_and_index():
    r = random.Random(0)
    for _ in range(60):
        s = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 150))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for _ in range(60):
        n = r.choice([5, 8])
        words = ["".join(r.choice("abc") for _ in range(r.randint(2, 12))) for _ in range(6)]
        texts = ["".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(8)]
        own, multi = [r.randint(0, 5) for _ in texts], [r.random() < 0.1 for _ in texts]
        t, a, e = FMIndex([np.array([ord(c) for c in x], np.uint32) for x in texts], np.array(own), np.array(multi)).shared_passages(n)
        got = {(x, c) for x, b, d in zip(t, a, e) for c in range(b, d)}
        want = {(i, c) for i, x in enumerate(texts) for p in range(len(x) - n + 1) if any(x[p : p + n] in y and (own[j] != own[i] or multi[j]) for j, y in enumerate(texts)) for c in range(p, p + n)}
        assert got == want


def test_index_over_many_symbols():
    r = random.Random(3)
    for symbols in (1, 2, 16, 17, 200, 70_000):
        s = np.array([r.randrange(symbols) for _ in range(500)])
        tree = WaveletTree(s, symbols)
        assert len(tree.levels) == max(1, -(-int(symbols - 1).bit_length() // 4))  # one for four bits
        for c in {0, symbols - 1, *s[:20].tolist()}:
            at = np.arange(len(s) + 1)
            got = tree.rank(np.full(len(at), c), at)
            assert (got - got[0]).tolist() == [0, *np.cumsum(s == c).tolist()]


def test_shared_texts_take_few_backward_steps(monkeypatch):
    r = random.Random(4)
    text = lambda n: np.array([r.randint(97, 122) for _ in range(n)], np.uint32)
    steps, one = [0], FMIndex.step
    monkeypatch.setattr(FMIndex, "step", lambda self, symbol, lo, hi: (steps.__setitem__(0, steps[0] + len(symbol)), one(self, symbol, lo, hi))[1])
    for n, most in ((299, 2 * 200), (200, 200), (199, 0)):  # the passages at the begin and at the end
        steps[0], a = 0, text(n)
        got = FMIndex([a, np.append(text(1), a)[1:]], np.array([1, 2]), np.array([False, False])).shared_passages(200)
        assert [x.tolist() for x in got] == ([[0, 1], [0, 0], [n, n]] if n >= 200 else [[], [], []])
        assert steps[0] <= 2 * most
    # shared parts of any lengths with unlike texts between: in fewer steps than halving takes (about 25,000)
    steps[0] = 0
    for k in range(200, 290, 9):
        a = text(k)
        x, y = np.concatenate([a, text(299 - k)]), np.concatenate([text(299 - k), a])
        assert [z.tolist() for z in FMIndex([x, y], np.array([1, 2]), np.array([False, False])).shared_passages(200)] == [[0, 1], [0, 299 - k], [k, 299]]
    assert steps[0] < 16_000


def test_index_without_a_shared_passage():
    r = random.Random(5)
    for texts in ([], [[]], [[], []], [[r.randint(97, 122) for _ in range(n)] for n in (250, 199, 300)], [[97] * 250]):
        index = FMIndex([np.array(x, np.uint32) for x in texts], np.arange(len(texts)), np.zeros(len(texts), bool))
        assert [x.tolist() for x in index.shared_passages(200)] == [[], [], []]


def test_anchors_of_joined_texts_are_those_of_each():
    r = random.Random(9)
    texts = ["".join(r.choice("ab é😀") for _ in range(r.choice([200, 201, 350, 900]))) for _ in range(30)] + ["x" * 5000]
    points = [shared_spans._points(t) for t in texts]
    powers = shared_spans._powers(1 << 15)
    t, p, h, first, last = shared_spans.anchors(np.concatenate(points), np.array([len(x) for x in points]), powers)
    want = [(k, *x) for k, a in enumerate(points) for x in zip(*(y.tolist() for y in shared_spans.anchors(a, np.array([len(a)]), powers)[1:]))]
    assert list(zip(*(x.tolist() for x in (t, p, h, first, last)))) == want
    for k, x in enumerate(texts):  # each window has one anchor, which stands in it
        assert [w for i, _, _, b, c in want if i == k for w in range(b, c + 1)] == list(range(len(x) - 199))
    assert all(b <= c <= q <= b + 100 for _, q, _, b, c in want)
    grams = {}
    for k, q, x, _, _ in want:  # one hash is one gram, and each window holds an anchor
        assert grams.setdefault(x, texts[k][q : q + 100]) == texts[k][q : q + 100]
    for k, x in enumerate(texts):
        at = sorted(q for i, q, *_ in want if i == k)
        assert at[0] <= 100 and at[-1] >= len(x) - 200 and all(b - a <= 101 for a, b in zip(at, at[1:]))


def brute(texts, n=200):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - n + 1):
            seen.setdefault(t[p : p + n], set()).add(i)
    for i, t in enumerate(texts):
        c = {q for p in range(len(t or "") - n + 1) if len(seen[t[p : p + n]]) > 1 for q in range(p, p + n)}
        if c:
            out[i] = c
    return out


def spans(df):
    out = {}
    for r in shared_spans.shared_passages(df).collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return out


def corpus(r):
    text = lambda n: "".join(r.choice("abcdefgh é😀") for _ in range(n))
    parts = [text(r.choice([150, 199, 200, 201, 450])) for _ in range(6)]
    out = [text(r.randint(0, 300)) + "".join(r.choice(parts) + text(r.randint(0, 120)) for _ in range(r.randint(0, 3))) for _ in range(25)]
    return out + [out[0], out[0], None, "", " " * 500, "x" * 70_000, "x" * 199]


def test_passages_equal_brute_force(spark):
    texts = corpus(random.Random(5))
    assert spans(docs(spark, texts)) == brute(texts)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    texts = corpus(random.Random(6))
    monkeypatch.setattr(shared_spans, "HOT", 3)
    assert spans(docs(spark, texts)) == brute(texts)


def test_stretches_are_cut_once_for_the_search_and_once_for_the_spans(spark):
    plan = shared_spans.shared_passages(docs(spark, ["a" * 300]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 7  # each cut has two passes for the anchors, then one search


def test_report_and_empty(spark):
    df = docs(spark, ["p" + "ab" * 120, "q" + "ab" * 120, None])
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_spans.shared_report(df).collect()}
    assert got == {0: (241, 240), 1: (241, 240), 2: (0, 0)}
    assert shared_spans.found(df.limit(0)).count() == 0
    one = df.withColumn("doc_id", F.lit(7).cast("long"))
    assert shared_spans.found(one).count() == 0  # rows of one document share nothing with another


def test_completion_packs_all_and_never_worse():
    r = random.Random(2)
    for _ in range(150):
        cap = r.choice([20, 100, 513])
        w = [r.randint(1, cap) for _ in range(r.randint(0, 60))]
        b = containers.complete(w, cap)
        assert sorted(i for x in b for i in x) == list(range(len(w))) and all(sum(w[i] for i in x) <= cap for x in b)
        assert containers.lower_bound(np.array(w), cap) <= len(b) <= len(containers.best_fit(w, cap))


def test_best_on_small_sets():
    import itertools

    r = random.Random(8)
    for _ in range(25):
        w = [r.randint(1, 20) for _ in range(7)]
        least = next(k for k in range(1, 8) if any(all(sum(w[i] for i in range(7) if a[i] == b) <= 20 for b in range(k)) for a in itertools.product(range(k), repeat=7)))
        assert len(containers.complete(w, 20)) == least


def test_containers(spark):
    texts = ["word " * n for n in (3, 30, 90, 250, 7, 7)] + [None, "", "   "]
    specs = spark.createDataFrame([("s", 64, 1), ("w", 100, 0), ("bad", 0, 1), ("none", None, None)], S)
    rows = containers.fill_containers(docs(spark, texts), specs).collect()
    assert {r["container_kind"] for r in rows} == {"s", "w"}
    size = {0: 4, 1: 31, 2: 91, 3: 251}
    for kind, cap, sep in (("s", 64, 1), ("w", 100, 0)):
        part = [r for r in rows if r["container_kind"] == kind]
        assert {r["doc_id"] for r in part} == set(range(9))
        bins = {}
        for r in part:
            bins.setdefault(r["container_id"], []).append(r)
        for b in bins.values():
            assert sum(r["tokens"] for r in b) + sep * (len(b) - 1) <= cap and sorted(r["position"] for r in b) == list(range(len(b)))
        for d, n in size.items():
            pieces = sorted((r["start_token"], r["tokens"]) for r in part if r["doc_id"] == d)
            assert sum(t for _, t in pieces) == n and (n > cap or len(pieces) == 1)
    assert containers.fill_containers(docs(spark, []), specs).count() == 0
    assert containers.fill_summary(docs(spark, texts), specs).count() == 2


def test_mix(spark):
    texts = ["word " * (5 + i % 40) for i in range(400)]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 300, "big").when(F.col("doc_id") < 305, "tiny").when(F.col("doc_id") < 390, "mid").when(F.col("doc_id") < 395, None).otherwise("other")).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "EN").when(F.col("doc_id") % 3 == 1, "en-US"))
    t = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.2, 3), ("mid", 0.2, 2), ("gone", 0.1, 2), (None, 0.1, 1)], T)
    records, report = mixing.mix(df, t)
    most = {"big": 1, "tiny": 3, "mid": 2}
    for r in records.collect():
        assert 1 <= r["uses"] <= most[r["source"]]
    rep = {r["source"]: r for r in report.collect()}
    assert rep["tiny"]["uses"] == 15 and rep["gone"]["actual_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    for r in rep.values():
        assert abs(r["actual_tokens"] - r["target_tokens"]) <= 0.08 * max(r["target_tokens"], 1) + 60
    empty, rep0 = mixing.mix(df.limit(0), t)
    assert empty.count() == 0 and rep0.count() == 4


def test_raking_meets_margins():
    import pandas as pd

    r = np.random.default_rng(1)
    cells = pd.DataFrame([(s, k, t, int(r.integers(50, 500)), 5) for s in "abc" for k in "xy" for t in "uv"], columns=["source", "language", "topic", "tokens", "most"])
    sizes = {"a": 600.0, "b": 900.0, "c": 300.0}
    w = mixing.rake(cells, sizes) * cells["tokens"]
    assert np.allclose(w.groupby(cells["source"]).sum(), [600, 900, 300])
    assert np.allclose(w.groupby(cells["language"]).sum(), cells.groupby("language")["tokens"].sum() * 1800 / cells["tokens"].sum(), rtol=1e-5)
    assert mixing.source_sizes({"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 100.0}, 80.0) == {"a": 10.0, "b": 70.0}


def test_exact_packing_is_the_least_number_of_bins():
    import random
    from functools import lru_cache

    from turnmill.llm import containers

    r = random.Random(8)
    for _ in range(60):
        capacity = r.randint(8, 20)
        w = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]

        @lru_cache(None)
        def least(left, room, capacity=capacity):
            if not left:
                return 0
            best = 99
            for k in range(len(left)):
                rest = left[:k] + left[k + 1 :]
                best = min(best, least(rest, room - left[k]) if left[k] <= room else 1 + least(rest, capacity - left[k]))
            return best

        bins = containers.complete(w, capacity, exact=True)
        assert sorted(i for b in bins for i in b) == list(range(len(w))) and all(sum(w[i] for i in b) <= capacity for b in bins)
        assert len(bins) == least(tuple(sorted(w)), 0), (w, capacity)


def test_dominance():
    import numpy as np

    from turnmill.llm import containers

    count = np.bincount([6, 5, 3, 3], minlength=11)
    assert containers.dominated((5,), count, 6) and containers.dominated((3, 3), count, 6) and not containers.dominated((6,), count, 6)
    assert containers.all_fillings(count, 6, 3, 10) == [(6,)]


def test_no_cap_on_the_search():
    import random

    from turnmill.llm import containers

    # a search of four steps a bin and three fillings a document found one more, or could not tell
    for n, mean, capacity, seed, want in ((300, 4.2, 200, 4, 130), (400, 4.2, 150, 2, 207), (400, 4.2, 150, 10, 213), (300, 5.9, 513, 7, 199)):
        r = random.Random(seed)
        w = [min(capacity, max(1, round(r.lognormvariate(mean, 0.8)))) for _ in range(n)]
        bins, least = containers.searched(w, capacity)[:2]
        assert sorted(i for b in bins for i in b) == list(range(len(w))) and all(sum(w[i] for i in b) <= capacity for b in bins)
        assert len(bins) == least == want


def test_bound_of_patterns_and_enumeration_by_prices():
    import random

    from turnmill.llm import column_prices, containers

    w = [4] * 7 + [7] * 4 + [5] * 3
    r = random.Random(3)
    for w, capacity in [(w, 11)] + [([r.randint(3, 24) for _ in range(10)], 30) for _ in range(20)]:
        start = [[w[i] for i in b] for b in containers.best_fit(w, capacity)]
        prices, whole = column_prices.priced(w, capacity, [start])
        price, best = prices.tolist(), len(start) + 1
        for found in containers.enumerated(w, capacity, best, lambda count, room, need: containers.priced_fillings(count, room, price, need), price, whole):
            if found:
                assert sorted(x for b in found for x in b) == sorted(w) and all(sum(b) <= capacity for b in found) and len(found) < best
                best = len(found)
        assert -(-sum(price[x] for x in w) // whole) <= best == len(containers.complete(w, capacity, exact=True)) == len(containers.complete(w, capacity))


def test_report_meets_the_bound(spark):
    import random

    r = random.Random(10)
    texts = ["word " * (min(150, max(1, round(r.lognormvariate(4.2, 0.8)))) - 1) for _ in range(400)]
    for row in containers.fill_report(docs(spark, texts), spark.createDataFrame([("m", 150, 0)], S)).collect():
        assert row["at_bound"] == row["blocks"] == 1 and row["containers"] == row["lower_bound"]
