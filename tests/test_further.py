import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawlake import registry, session
from lawlake.functions import texts
from lawlake.operators import anchors, bluebell, compare, documents, search, stores, versioned
from lawlake.sources import deliverable, lanes

WORDS = st.text(st.sampled_from("abc &<é"), min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(lambda s: s)
UNIT = st.recursive(
    st.tuples(st.sampled_from(["SECTION", "POINT", "PARAGRAPH"]), st.sampled_from(["", "1", "2a", "10"]), st.one_of(st.none(), WORDS), st.one_of(st.none(), WORDS), st.just([])),
    lambda kids: st.tuples(st.sampled_from(["PART", "CHAPTER", "ARTICLE"]), st.sampled_from(["", "3"]), st.one_of(st.none(), WORDS), st.one_of(st.none(), WORDS), st.lists(kids, max_size=3)),
    max_leaves=8,
)


def lines(unit, d=0):
    kind, num, heading, words, kids = unit
    out = ["  " * d + kind + (f" {num}" if num else "") + (f" - {heading}" if heading else "")]
    return out + (["  " * (d + 1) + words] if words else []) + [x for k in kids for x in lines(k, d + 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(UNIT, min_size=1, max_size=4))
def test_text_to_xml_and_back(units):
    text = "\n".join(x for u in units for x in lines(u))
    assert bluebell.to_text(bluebell.to_xml(text)) == text


def test_bluebell_dirt(spark):
    assert bluebell.to_text(None) is None and bluebell.to_text("<broken") is None and bluebell.to_xml(None) is None
    assert bluebell.to_text(bluebell.to_xml("")) == ""
    df = spark.createDataFrame([("SECTION 1 - A\n  words",), (None,)], "t string")
    assert [r.x for r in df.select(bluebell.text_of(bluebell.xml_of("t")).alias("x")).collect()] == ["SECTION 1 - A\n  words", None]


def test_registries_and_prior_decisions(spark):
    @registry.register(registry.LENSES, "short")
    def short(units):
        return units.where(F.length("text") < 5).select("unit_id", F.lit("warning").alias("severity"))

    @registry.register(registry.PARSERS, "words")
    def words(text):
        return [{"word": w, "n": i} for i, w in enumerate(text.split())]

    units = spark.createDataFrame([(1, "abc"), (2, "long enough"), (3, "x"), (4, None)], "unit_id int, text string")
    decided = spark.createDataFrame([(1, 1, "open"), (1, 2, "accepted")], "unit_id int, at int, decision string")
    got = {r.unit_id: r.prior_decision for r in registry.run_lens("short", units, decided).collect()}
    assert got == {1: "accepted", 3: None}
    assert registry.parse_all(units, "words", "unit_id", "text", "word string, n int").count() == 4
    with pytest.raises(KeyError):
        registry.run_lens("none", units)
    doubled = registry.run_model(units.select("unit_id"), lambda f: pd.DataFrame({"x": f["unit_id"] * 2}), "x int")
    assert sorted(r.x for r in doubled.collect()) == [2, 4, 6, 8]


def test_compare(spark):
    a = spark.createDataFrame([(i, "x", [float(i == k) for k in range(6)]) for i in range(6)], "i int, chapter string, e array<float>")
    pairs = compare.candidates(a, a, "i", "e", 2)
    verdicts = compare.judged(pairs, lambda f: f["query_id"].map(lambda q: "covered" if q < 5 else "not_found"))
    s = compare.summarise(a.select(F.col("i").alias("query_id"), "chapter"), verdicts, "chapter").head()
    assert (s.assessed, s.covered, s.level) == (6, 5, "partial")
    units = spark.createDataFrame([("section", "t", None), ("part", "t", None), ("point", " ", None), ("point", "t", True)], "akn_type string, text string, excluded_from_pool boolean")
    assert compare.assessable(units).count() == 1


def test_deliverable_is_whole_and_never_overwritten(spark):
    folder = session.shared_dir(spark, "out")
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    m = deliverable.write(df, folder, "first", "json", ["k"])
    assert m["rows"] == 10 and m["files"] and all(len(f["sha256"]) == 64 for f in m["files"])
    assert json.loads(session.read_text(spark, f"{folder}/first/manifest.json")) == m
    with pytest.raises(OSError):
        deliverable.write(df, folder, "first")
    assert spark.read.json(f"{folder}/first/data").count() == 10


def test_small_functions(spark):
    assert texts.ordinal("third") == 3 and texts.ordinal("21st") == 21 and texts.ordinal(None) is None
    assert texts.money_mismatches("pay 500 (four hundred) and 12 (twelve), 7 (x)") == [(500, 400)] and texts.money_mismatches(None) == []
    df = spark.createDataFrame([("Act No. 12 of 1999",), ("Ferry Act, 1970",), ("none",), (None,)], "t string")
    ids = [tuple(r.x) for r in df.select(texts.identity_from_title(F.col("t")).alias("x")).collect()]
    assert ids == [("12", 1999), (None, 1970), (None, None), (None, None)]
    nums = spark.createDataFrame([("1,000.5 and ٣٤ or 7.",), (None,)], "t string").select(texts.numeric_tokens(F.col("t")).alias("n")).collect()
    assert nums[0].n == ["1000.5", "34", "7"] and nums[1].n == []
    langs = spark.createDataFrame([("EN",), ("fre",), ("deu",), (" ",), (None,), ("en-GB",), ("xx",)], "t string").select(texts.language(F.col("t")).alias("x")).collect()
    assert [r.x for r in langs] == ["eng", "fra", "deu", None, None, "eng", "xx"]
    g = spark.createDataFrame([("water authority",), ("act",), ("",)], "term string")
    t = spark.createDataFrame([(1, "The Water Authority acts"), (2, "an act"), (3, None)], "i int, text string")
    assert sorted((r.i, r.term) for r in search.pinned_terms(t, "text", g).collect()) == [(1, "water authority"), (2, "act")]
    c = stores.containment(t, t.where("i = 1"), "text").head()
    assert (c.n, c.n_held) == (2, 1)


def test_nearest_holding(spark):
    v = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "id string, parent_version_id string")
    held = spark.createDataFrame([("a", "A"), ("b", "B")], "version_id string, v string")
    got = {r.id: (r.held_by, r.depth, r.v) for r in versioned.nearest_holding(versioned.lineage(v), held, ["v"]).collect()}
    assert got == {"a": ("a", 0, "A"), "b": ("b", 0, "B"), "c": ("b", 1, "B")}


def test_arabic_light_stems_agree_with_and_without_clitics(spark):
    words = ["والكتاب", "الكتاب", "كتاب", "وللنقيب", "للنقيب", "وزير", "الوزير", "ولد", "المدينة", "مدينه", "كتابها", "ال", None]
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(texts.stem_arabic(F.col("w")).alias("s")).collect()]
    assert got == ["كتاب", "كتاب", "كتاب", "نقيب", "نقيب", "زير", "وزير", "ولد", "مدين", "مدين", "كتاب", "ال", None]
    assert texts.tokenise("والكتابُ الوزير", "ara") == ["كتاب", "وزير"] and texts.stem("ولد", "ara") == "ولد"


def test_publishers_wordings(spark):
    cases = {
        "words inserted": ("insertion", "textual"), "Applied (with modifications)": ("extensionOfScope", "scope"), "applied in part by S.I. 4": ("extensionOfScope", "scope"), "excluded": ("exceptionOfScope", "scope"),
        "repealed in part": ("repeal", "textual"), "in force": ("entryIntoForce", "force"), "coming into force": ("entryIntoForce", "force"), "modified for ss. 2, 3": ("variation", "meaning"), "amended": (None, None), "ceases to have effect": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(w,) for w in cases], "w string").select("w", lanes.crosswalk(F.col("w")).alias("x"))
    assert {r.w: tuple(r.x) for r in df.collect()} == cases


def test_windows_hold_their_size_and_cover_the_text(spark):
    at = [{"pos": p} for p in (100, 5400, 5590, 11000, 16900)]
    docs = spark.createDataFrame([(k, "x" * n) for k, n in enumerate((1, 6000, 6001, 12_345, 17_000, 22_399))], "i int, t string")
    anchored = spark.createDataFrame([(k, at) for k in range(6)], "i int, anchors array<struct<pos:int>>")
    rows = {}
    for r in anchors.windows(anchored, docs, "i", "t").orderBy("i", "window_no").collect():
        rows.setdefault(r.i, []).append((r.start, r.stop))
    for k, n in enumerate((1, 6000, 6001, 12_345, 17_000, 22_399)):
        assert rows[k][0][0] == 0 and rows[k][-1][1] == n and all(0 < b - a <= 6000 for a, b in rows[k])
        assert all(y[0] <= x[1] for x, y in zip(rows[k], rows[k][1:]))


def test_cells_with_spans_stand_at_every_place_they_cover(spark):
    xml = "<act><table eId='t'><tr><th colspan='2'>Fee</th><th rowspan='2'>Due</th></tr><tr><th>min</th><th>max</th></tr><tr><td rowspan='2'>1</td><td>2</td><td>May</td></tr><tr><td>3</td><td rowspan='x'>June</td></tr></table></act>"
    cells = documents.table_rows(documents.nodes(spark.createDataFrame([("v", xml), ("w", "<act><table/></act>")], "id string, akn_xml string")))
    got = sorted((r.row_no, r.column_no, r.label, r.text) for r in cells.collect())
    assert got == [(3, 1, "Fee / min", "1"), (3, 2, "Fee / max", "2"), (3, 3, "Due", "May"), (4, 1, "Fee / min", "1"), (4, 2, "Fee / max", "3"), (4, 3, "Due", "June")]


def test_moves_that_are_not_allowed_change_nothing(spark):
    log = [("a", "queued", 1), ("a", "succeeded", 2), ("b", "queued", 1), ("b", "running", 2), ("b", "succeeded", 3), ("b", "failed", 4), ("c", "succeeded", 1), ("d", None, 1), ("e", "running", 2), ("e", "queued", 3)]
    got = stores.run_states(spark.createDataFrame(log, "run string, state string, t int"), "run", "state", "t").collect()
    assert sorted(map(tuple, got)) == [("a", "queued", 1), ("b", "succeeded", 3), ("e", "running", 2)]
