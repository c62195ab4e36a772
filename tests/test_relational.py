import random
from datetime import date

from pyspark.sql import functions as F

from lawlake.operators import findings, graph, quality, search, timeline, versioned


def fold(effects, as_at):
    """The ordered reading of a provision's effects."""
    states, commenced = {}, {}
    for a, t, when, applied in sorted(effects, key=lambda e: (e[2] is None, e[2] or date.min)):
        if t is None:
            continue
        if a == "entryIntoForce":
            if applied is not False:
                commenced.setdefault(t, []).append(when)
            continue
        if when is None or when > as_at or applied is False:
            continue
        if a == "repeal":
            states[t] = ("repealed", when)
        elif a in ("substitution", "insertion"):
            if states.get(t, ("",))[0] != "repealed":
                states[t] = ("text_unapplied", when)
        elif t not in states:
            states[t] = ("affected", when)
    for t, days in commenced.items():
        if states.get(t, ("",))[0] == "repealed":
            continue
        live = [x for x in days if x is not None and x <= as_at]
        if live:
            states.setdefault(t, ("in_force", max(live)))
        else:
            future = [x for x in days if x is not None]
            states[t] = ("not_yet_in_force", min(future) if future else None)
    return states


def test_state_at_equals_the_ordered_reading(spark):
    rnd = random.Random(8)
    for _ in range(4):
        rows = [(rnd.choice(["repeal", "substitution", "insertion", "renumbering", "entryIntoForce", "variation"]), rnd.choice(["a", "b", "c", "d", "e", "f", None]), rnd.choice([None, *[date(2020, 1, k) for k in range(1, 28)]]), rnd.choice([True, False, None])) for _ in range(25)]
        df = spark.createDataFrame([("w", *r) for r in rows], "work string, akn_action string, target string, in_force_date date, applied boolean")
        got = {r.target: (r.state, r.since) for r in timeline.state_at(df, "work", "target", "2020-01-14").collect()}
        assert got == fold(rows, date(2020, 1, 14))
    none = df.limit(0)
    assert timeline.state_at(none, "work", "target", "2020-01-14").count() == 0 and timeline.holes(none, "target", "2020-01-14").head().no_target == 0


def test_walk_by_paths_closes_cycles_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("b", "d"), ("d", "x"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.depth, r.near, r.node) for r in graph.walk(e, start, 5).collect())
    assert got == [(1, "a", "b"), (1, "a", "d"), (2, "b", "c"), (2, "b", "d"), (2, "d", "x"), (3, "c", "a"), (3, "d", "x")]
    assert {(r.node, r.depth) for r in graph.walk(e, start, 5, once=True).collect()} == {("b", 1), ("d", 1), ("c", 2), ("x", 2), ("a", 3)}
    c = e.withColumn("akn_category", F.when(F.col("dst") == "d", "textual").otherwise("force"))
    assert [r.node for r in graph.walk(c, start, 3, classes=["textual"]).collect()] == ["d"] and graph.walk(c, start, 3, classes=[]).count() == 0
    back = graph.walk(e, spark.createDataFrame([("d",)], "node string"), 1, inbound=True)
    assert {r.node for r in back.collect()} == {"a", "b"}
    assert {r.node for r in graph.walk(e, start, 3, allowed=spark.createDataFrame([("b",), ("c",)], "node string")).collect()} == {"b", "c"}
    assert graph.walk(e, start, 0).count() == 2 and graph.walk(e.limit(0), start, 3).count() == 0


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Water water act"), (2, "the WATER"), (3, None), (4, ""), (5, "Straße")], "id int, text string")
    s = {r.id: r.score for r in search.bm25(docs, "text", ["water", "water"]).collect()}
    assert set(s) == {1, 2} and s[1] > 0
    assert search.bm25(docs, "text", []).count() == 0 and search.bm25(docs.limit(0), "text", ["x"]).count() == 0
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id int, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 5.0)], "id int, score double")
    fused = [(r.id, round(r.rrf_score, 6)) for r in search.reciprocal_rank_fusion([a, b], "id", 3).collect()]
    assert fused == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]


def test_nearest_in_blocks_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [0.0] * 6)]
    v = spark.createDataFrame(rows, "i int, e array<float>").repartition(4)
    got = {}
    for r in search.nearest_of_queries(v, v.where("i % 7 = 0"), "i", "e", 3, block=4).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.i))
    import numpy as np

    x = {i: np.array(e, np.float32).astype(float) for i, e in rows[:60]}
    for q in range(0, 60, 7):
        want = sorted((-round(float(x[q] @ y / np.linalg.norm(x[q]) / np.linalg.norm(y)), 6), i) for i, y in x.items() if i != q)[:3]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_rates_are_tri_state(spark):
    f = spark.createDataFrame([("x", True), ("x", False), ("x", None), ("y", None)], "k string, failed boolean")
    r = {x.k: (x.failed, x.passed, x.not_run, x.rate) for x in findings.rates(f, ["k"]).collect()}
    assert r == {"x": (1, 1, 1, 0.5), "y": (0, 0, 1, None)}
    d = {x.k: (x.delta, x.stopped, x.started) for x in findings.rate_delta(findings.rates(f, ["k"]), findings.rates(f.where("k = 'y'"), ["k"]), ["k"]).collect()}
    assert d == {"x": (None, True, False), "y": (None, False, False)}
    s = {x.k: x.share for x in findings.share_or_null(f, ["k"], "failed").collect()}
    assert s == {"x": None, "y": None}


def test_pages_scopes_and_latest(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(10)], "id int, t int")
    seen, cursor = [], None
    while page := versioned.keyset_page(df, "t", "id", 4, cursor).collect():
        seen += [r.id for r in page]
        cursor = seen[-1]
    assert seen == list(range(9, -1, -1)) and versioned.keyset_page(df, "t", "id", 4, 99).count() == 0
    laws = spark.createDataFrame([("x", None, "act"), ("x", 1990, "act"), ("y", 2020, "order")], "jurisdiction_code string, year int, doctype string")
    count = lambda **k: laws.where(versioned.scope(**k)).count()
    assert (count(), count(jurisdictions=[]), count(years=(1980, 2000)), count(years=(1980, 2000), undated=False), count(doctypes=["order"])) == (3, 0, 2, 1, 1)


def test_quality_measures_abstain(spark):
    loop = "the same words again and again here " * 20
    df = spark.createDataFrame([(1, loop), (2, "short"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.repeat_density for r in quality.repeat_densities(df, "text").collect()}
    assert got[1] > 0.9 and got[2] is got[3] is got[4] is None
    red = spark.createDataFrame([("mail a.b@c.example or 10.0.0.1, Bearer abc.def; not 1.2.3, 999.1.1.1 or a@b; fe80::1",)], "t string").select(quality.redact(F.col("t")).alias("t")).head().t
    assert red == "mail [redacted mailbox] or [redacted address], [redacted token]; not 1.2.3, 999.1.1.1 or a@b; [redacted address]"
    cite = spark.createDataFrame([("No 12 of 1999",), ("1 2 3",), ("7",), (None,), ("5 and 6",)], "t string").select(quality.citation(F.col("t")).alias("c")).collect()
    assert (cite[0].c.number, cite[0].c.year) == (12, 1999) and [r.c for r in cite[1:]] == [None] * 4
    g = quality.gaps(spark.createDataFrame([("a", n) for n in (1, 2, 4)] + [("b", n) for n in (1, 9)] + [("c", 1)], "k string, n int"), ["k"], "n")
    assert {r.k: r.gap for r in g.collect()} == {"a": "repeal", "b": "defect", "c": "none"}
    grades = spark.createDataFrame([(0.995, 0.0, None), (0.96, 0.0, None), (0.5, 0.0, None), (None, 0.0, None)], "r double, f double, j double").select(quality.translation_grade(F.col("r"), F.col("f"), F.col("j")).alias("g")).collect()
    assert [x.g for x in grades] == ["A", "B", "C", None]


def test_lineage_is_bounded(spark):
    v = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent_version_id string")
    got = {(r.id, r.ancestor_id, r.depth) for r in versioned.lineage(v, most=5).collect()}
    assert {("c", "c", 0), ("c", "b", 1), ("c", "a", 2), ("z", "gone", 1)} <= got and max(d for i, _, d in got if i == "x") == 5


def test_payloads(spark):
    df = spark.createDataFrame([('{"actionable": false, "k": [1, {"a": 2}, 3]}',), ('{"actionable": true}',), ("{}",), (None,), ("broken",)], "p string")
    r = df.select(findings.actionable("p").alias("a"), findings.actionable("p", True).alias("b")).collect()
    assert [x.a for x in r] == [False, True, False, False, False] and [x.b for x in r] == [False, True, True, True, True]
    s = spark.createDataFrame([('[1, {"a": 2}, "x"]',), (None,)], "j string").select(findings.json_slice("j", 1, 5).alias("s")).collect()
    assert s[0].s == ['{"a":2}', "x"] and s[1].s is None


def test_terms_of_which_a_token_looks_like_a_part(spark):
    def tri(w):
        padded = f"  {w} "
        return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))

    def similarity(a, b):
        q, t = set(tri(a)), tri(b)
        return max(len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1))

    tokens, terms = ["وزير", "act", "certificate", "banana", "ab"], ["الوزير", "accident", "certificación", "bananas", "act", "nab"]
    got = search.expand_terms(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(t, 1) for t in terms], "term string, ndoc int"), 0.0, 99)
    found = {(r.token, r.term): r.similarity for r in got.collect()}
    assert found["وزير", "الوزير"] == 0.6  # a word is found with its article
    assert all(abs(v - similarity(*k)) < 1e-6 for k, v in found.items()) and "ab" not in {k[0] for k in found}
    assert {k for k in ((a, b) for a in tokens for b in terms) if len(k[0]) > 2 and k[0] != k[1] and set(tri(k[0])) & set(tri(k[1]))} == set(found)


def test_reasons_for_exclusion(spark):
    cases = [
        ("[Schedule 2 not transcribed: form]", "sec_1", True, "placeholder"), ("[repealed]", "sec_1", False, None), ("[illegible]", "sec_1", False, None), ("The fee is 4.", "sec_1", True, "marked"),
        ("a | b | c", "sec_1", False, "table"), ("The fee shall be | 4 | 5", "sec_1", False, None), ("12.5 13.5 kg", "att_1", False, "digits"), ("  ", "att_1", True, None), (None, "att_1", None, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, e string, m boolean").select(quality.exclusion_reason(F.col("t"), F.col("e"), F.col("m")).alias("r"))
    assert [r.r for r in df.collect()] == [c[3] for c in cases]
