import random
from datetime import date, datetime

from pyspark.sql import functions as F

from lawlake import session
from lawlake.operators import change_feed as c

CREATE = session.create_text
SCHEMA = "feed_seq bigint, received_at timestamp_ntz, publisher_effect_id string, revision int, akn_action string, target_frbr_uri string, target_akn_wid string, effect_no int, in_force_date date, applied boolean, new_text string, rev_seq string"
ACTIONS = ["insertion", "REENACTMENT ", "substitution", " Replacement", "variation", "repeal", "endOfEnactment", "renumbering", None]


def brute(rows):
    held = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
        held[r[2]] = r
    out = {}
    live = [r for r in held.values() if r[9] and r[8] and r[6] is not None and r[5] is not None and r[7] is not None and r[2] is not None]
    for r in sorted(live, key=lambda r: (r[8], r[7], r[2])):
        action, key = (r[4] or "").strip().lower(), (r[5], r[6])
        if action in c.PUTS or action in c.REPLACES and key in out:
            out[key] = r[2]
        elif action in c.REMOVES:
            out.pop(key, None)
    return sorted((*k, v) for k, v in out.items())


def feed(n, seed, hot=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        e = rnd.randrange(n // 2)
        own = random.Random(e * 7919 + seed)
        rev = rnd.randrange(3)
        content = random.Random((e, rev, seed).__hash__())
        hot_key = hot and own.random() < 0.4
        rows.append((i, datetime(2024, 1, 1), f"fx{e}", rev, content.choice(ACTIONS), "/a" if hot_key else own.choice(["/a", "/b"]), "s1" if hot_key else own.choice(["s1", "s2", "s3", "", None]), e, content.choice([None, *[date(2020, 1, d) for d in range(1, 20)]]), content.choice([True, True, True, False, None]), content.choice(["t", None, "", "é" * 3000]), "clash"))
    rows += rnd.sample(rows, n // 5)
    rnd.shuffle(rows)
    return rows


def test_against_ordered_fold(spark):
    for seed in range(3):
        rows = feed(400, seed, hot=seed == 2)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert sorted(map(tuple, c.found(spark, df).collect())) == brute(rows)


def test_batches_split_anywhere_give_the_state_of_the_whole(spark):
    rows = feed(120, 7)
    for cuts in ((40,), (1, 60, 119), (0, 30)):
        provisions = c.Provisions(spark, session.shared_dir(spark, "batches"))
        for a, b in zip((0, *cuts), (*cuts, len(rows))):
            part = rows[a:b] + rows[max(0, a - 5) : a]  # overlapping the batch before
            provisions.apply(spark.createDataFrame(part, SCHEMA))
        assert sorted((r[0], r[1], r[2]) for r in provisions.standing().collect()) == brute(rows), cuts


def test_a_revision_takes_back_what_an_earlier_one_did(spark):
    row = lambda seq, rev, action, wid: (seq, datetime(2024, 1, 1), "fx", rev, action, "/a", wid, 1, date(2020, 1, 1), True, "t", None)
    provisions = c.Provisions(spark, session.shared_dir(spark, "revised"))
    got = []
    for batch in ([row(1, 1, "insertion", "s1")], [row(2, 2, "insertion", "s2")], [row(1, 1, "insertion", "s1")], [row(3, 3, "repeal", "s2")]):
        provisions.apply(spark.createDataFrame(batch, SCHEMA))
        got.append([r.target_akn_wid for r in provisions.standing().collect()])
    assert got == [["s1"], ["s2"], ["s2"], []]


def test_a_crash_before_publishing_leaves_the_state_before(spark, monkeypatch):
    rows, provisions = feed(60, 3), c.Provisions(spark, session.shared_dir(spark, "crash"))
    provisions.apply(spark.createDataFrame(rows[:30], SCHEMA))
    for broken in (lambda *a: (_ for _ in ()).throw(OSError("lost")), lambda s, p, text: CREATE(s, p, text[:5])):
        with monkeypatch.context() as mp:
            mp.setattr(session, "create_text", broken)
            try:
                provisions.apply(spark.createDataFrame(rows, SCHEMA))
            except OSError:
                pass
        assert sorted((r[0], r[1], r[2]) for r in provisions.standing().collect()) == brute(rows[:30])
    provisions.apply(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r[0], r[1], r[2]) for r in provisions.standing().collect()) == brute(rows)


def test_null_payload_of_the_last_change_holds(spark):
    df = spark.createDataFrame([("k", "1", "old"), ("k", "2", None)], "k string, s string, v string").repartition(2)
    got = c.apply_changes(df, ["k"], F.col("s"), [c.Register("r", "true", ("v",))]).collect()
    assert [(r.k, r.r_seq, r.r_v) for r in got] == [("k", "2", None)]


def test_tombstone_keeps_late_changes_out(spark):
    df = spark.createDataFrame([("k", "3", "del"), ("k", "1", "put"), (None, "9", "put"), ("q", None, "put")], "k string, s string, a string")
    got = c.apply_changes(df, ["k"], F.col("s"), [c.Register("gone", "a = 'del'"), c.Register("put", "a = 'put'")]).collect()
    assert {(r.k, r.gone_seq, r.put_seq) for r in got} == {("k", "3", "1")}


def test_empty_feed_publishes_an_empty_table(spark):
    assert c.found(spark, spark.createDataFrame([], SCHEMA)).count() == 0
