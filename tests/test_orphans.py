import random
from datetime import datetime

from lawlake import session
from lawlake.operators import orphans as o

T = datetime
EFFECTS = "id string, version_id string, source_akn_wid string, target_frbr_uri string, target_akn_wid string, created_at timestamp_ntz, k1 string"
LAWS = "id string, frbr_work_uri string, created_at timestamp_ntz, deleted_at timestamp_ntz"
VERSIONS = "id string, law_id string"
PROVISIONS = "id string, version_id string, akn_wid string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def tables(spark, effects, laws, versions, provisions):
    make = spark.createDataFrame
    return make(effects, EFFECTS), make(laws, LAWS), make(versions, VERSIONS), make(provisions, PROVISIONS)


def test_reasons_and_dirt(spark):
    t0, t1, t2 = T(2024, 1, 1), T(2024, 2, 1), T(2024, 3, 1)
    laws = [("l1", "/akn/a", t0, None), ("l1", "/akn/a", t0, None), ("l2", "/akn/gone", t0, t1), ("l3", "/akn/new", t2, None), ("l4", None, t0, None), ("l5", "/akn/both", t0, t1), ("l6", "/akn/both", t2, None)]
    versions = [("v1", "l1"), ("v1", "l1"), ("v9", "nolaw")]
    provisions = [("p1", "v1", "sec_1", t0, None), ("p2", "v1", "sec_2", t0, t1), ("p3", "v1", "sec_3", t2, None), ("p4", "v9", "sec_1", t0, None), ("p5", "v1", None, t0, None)]
    effects = [
        ("e1", "v1", "sec_1", " /AKN/a/ ", "#sec_1 ", t1, "x"),
        ("e1", "v1", "sec_1", " /AKN/a/ ", "#sec_1 ", t1, "x"),
        ("e2", "v1", "#sec_2", "/akn/gone", "sec_9", t1, "x"),
        ("e3", "v1", " sec_3", "/akn/new", None, t1, "x"),
        ("e4", "v1", None, "/akn/none", "sec_1", t1, "x"),
        ("e5", "v9", "sec_1", "/akn/both", None, t1, "x"),
        ("e6", "v1", "sec_3", None, "sec_3", T(2024, 4, 1), "x"),
        ("e7", "v1", "", "", "", None, "x"),
    ]
    got = sorted(map(tuple, o.found(*tables(spark, effects, laws, versions, provisions)).collect()), key=str)
    assert got == sorted(
        [
            ("e2", "source_akn_wid", "2024-02", "deleted"), ("e2", "target_akn_wid", "2024-02", "missing"), ("e2", "target_frbr_uri", "2024-02", "deleted"),
            ("e3", "source_akn_wid", "2024-02", "late"), ("e3", "target_frbr_uri", "2024-02", "late"), ("e4", "target_frbr_uri", "2024-02", "missing"),
            ("e5", "target_frbr_uri", "2024-02", "late"), ("e7", "source_akn_wid", None, "missing"), ("e7", "target_frbr_uri", None, "missing"),
        ],
        key=str,
    )
    counted = {(r.ref_field, r.period, r.reason): r.n_orphans for r in o.counts(o.found(*tables(spark, effects, laws, versions, provisions))).collect()}
    assert counted["target_frbr_uri", "2024-02", "late"] == 2


def states_of(spark, effects, laws, versions, provisions):
    """(delivered, new) of a batch, versions and laws being those to look keys up in."""
    e, l, v, p = tables(spark, effects, laws, versions, provisions)
    ids = [df.select(o.F.lit(k).alias("kind"), "id") for k, df in (("effect", e), ("law", l), ("provision", p))]
    return ids[0].union(ids[1]).union(ids[2]), o.effect_states(e).unionByName(o.law_states(l)).unionByName(o.provision_states(p, v, l))


class Store:
    """States and balance, written between batches."""

    def __init__(self, spark):
        self.spark, self.store = spark, session.Generations(spark, session.shared_dir(spark, "orphans"))

    def read(self):
        _, at = self.store.current()
        return [self.spark.read.parquet(f"{at}/{x}") for x in ("states", "balance")]

    def take(self, delivered, new):
        number, before = self.store.current()
        made, at = o.advance(*self.read(), delivered, new) if before else o.first_load(new), self.store.start()
        for df, name in zip(made, ("states", "balance")):
            df.write.parquet(f"{at}/{name}")
        self.store.publish(at, number)

    def report(self):
        return sorted(map(tuple, o.orphan_report(*self.read()).collect()), key=str)


def test_a_deletion_that_arrives_as_a_change_makes_an_orphan(spark):
    store, t0, t1 = Store(spark), T(2024, 1, 1), T(2024, 2, 1)
    store.take(*states_of(spark, [("e1", "v", None, "/a", None, t1, "")], [("l1", "/a", t0, None)], [], []))
    assert store.report() == []
    store.take(*states_of(spark, [], [("l1", "/a", t0, t1)], [], []))
    assert store.report() == [("e1", "target_frbr_uri", "2024-02", "deleted")]
    store.take(*states_of(spark, [], [("l1", "/A/", T(2024, 3, 1), None)], [], []))  # it comes back later
    assert store.report() == [("e1", "target_frbr_uri", "2024-02", "late")]
    store.take(*states_of(spark, [], [("l2", "/a", t0, None), ("l2", "/a", t0, None)], [], []))
    assert store.report() == []
    gone = spark.createDataFrame([("law", "l1"), ("law", "l2")], "kind string, id string")
    store.take(gone, store.read()[0].limit(0))
    assert store.report() == [("e1", "target_frbr_uri", "2024-02", "missing")]
    store.take(*states_of(spark, [("e1", "v", None, None, None, t1, "")], [], [], []))  # the reference is taken back
    assert store.report() == [] and store.read()[1].count() == 0


def test_batches_of_deliveries_give_the_report_of_the_last_states(spark):
    rnd = random.Random(5)
    when = lambda: T(2024, rnd.randrange(1, 6), 1)
    store, laws, effects = Store(spark), {}, {}
    for _ in range(4):
        new_laws = [(f"l{rnd.randrange(6)}", rnd.choice(["/a", "/b", "/c"]), when(), rnd.choice([None, None, when()])) for _ in range(4)]
        new_effects = [(f"e{rnd.randrange(9)}", "v", None, rnd.choice(["/a", "/b", "/c", None]), rnd.choice([None, "s1"]), when(), "") for _ in range(5)]
        new_laws, new_effects = list({r[0]: r for r in new_laws}.values()), list({r[0]: r for r in new_effects}.values())
        laws.update({r[0]: r for r in new_laws})
        effects.update({r[0]: r for r in new_effects})
        store.take(*states_of(spark, new_effects, new_laws, [], []))
        whole = o.found(*tables(spark, list(effects.values()), list(laws.values()), [], []))
        assert store.report() == sorted(map(tuple, whole.collect()), key=str)


def test_empty(spark):
    assert o.found(*tables(spark, [], [], [], [])).count() == 0
