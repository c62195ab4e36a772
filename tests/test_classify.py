from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawlake.operators import classify, translation


def test_rules_by_priority_dates_and_missing_signals(spark):
    rules = [classify.Rule("a", "t", "x", priority=1), classify.Rule("b", "t", "x", priority=1), classify.Rule("c", "t", "y", since="2000-01-01", priority=5), classify.Rule("old", until="1950-12-31", since="1900-01-01")]
    df = spark.createDataFrame([("x", "2001-01-01"), ("xy", "2001-01-01"), ("xy", None), ("q", "1920-05-05"), (None, None)], "t string, d string").withColumn("d", F.col("d").cast("date"))
    assert [r.c for r in df.select(classify.document_class(rules, "d").alias("c")).collect()] == ["a", "c", "a", "old", None]
    years = spark.createDataFrame([(1980,), (1989,), (2000,), (None,)], "y int")
    assert [r.e for r in years.select(classify.era(F.col("y"), [("one", None, 1989), ("two", 1989, 1999)]).alias("e")).collect()] == ["one", "one", "outside_declared_eras", "unknown"]
    labels = spark.createDataFrame([(["Free movement of Goods", "Tax"],), (["tax"],), ([],), (None,)], "l array<string>")
    assert [r.c for r in labels.select(classify.chapter(F.col("l"), [(16, ["tax"]), (1, ["goods"])]).alias("c")).collect()] == [16, 16, None, None]


def test_page_regions(spark):
    rows = [(1, p, b, t, y, 100.0) for p in (1, 2, 3) for b, (t, y) in enumerate([(f"Gazette {p}", 2.0), (f"Body text of page {p}.", 40.0), ("1) a note", 80.0), (f"- {p} -", 97.0)])]
    r = classify.regions(spark.createDataFrame(rows, "doc_id int, page_no int, block_no int, text string, top double, height double"))
    assert {(x.block_no, x.region) for x in r.collect()} == {(0, "header"), (1, "body"), (2, "footnote"), (3, "number")}
    assert classify.structure_text(r).head().text == "Body text of page 1.\nBody text of page 2.\nBody text of page 3."
    leaks = classify.furniture_leaks(r, spark.createDataFrame([(1, "so Gazette 2 leaks"), (2, None)], "doc_id int, body string"))
    assert {x.doc_id: x.leaks for x in leaks.collect()} == {1: 1, 2: 0}


@given(st.text(st.sampled_from(list("ab 0129.,%")), max_size=40))
def test_numbers_round_trip(text):
    coded, numbers = translation.encode_numbers(text)
    assert not any(c.isdigit() for c in translation._SLOT.sub("", coded))
    assert translation.decode_numbers(coded, numbers) == (text, [])


def test_lost_numbers_are_named_and_audits_compare(spark):
    df = spark.createDataFrame([(1, "pay 5 of 1,000"), (2, None)], "i int, t string")
    got = {r.i: (r.translated, list(r.lost)) for r in translation.translate(df, "i", "t", lambda s: s.str.replace("⟨N001⟩", "")).collect()}
    assert got == {1: ("pay  of 1,000", ["5"]), 2: ("", [])}
    s = spark.createDataFrame([("a", "five 5 and 6"), ("b", "words here"), ("c", "x"), ("d", None)], "k string, text string")
    t = spark.createDataFrame([("a", "fünf 5 und 7"), ("b", " "), ("e", "new"), ("d", None)], "k string, text string")
    assert {(r.k, r.check_name) for r in translation.audit(s, t, ["k"]).collect()} == {("a", "numbers_differ"), ("b", "text_lost"), ("c", "unit_missing"), ("e", "unit_added")}
