import glob
import os
import random
import shutil
from datetime import datetime, timedelta, timezone

import pytest

from lawlake import session
from lawlake.operators import incremental as i

FETCHES = "fetch_id bigint, source_url string, fetched_at timestamp_ntz, landed_at timestamp_ntz, etag string, last_modified string, run_idx int"
RUNS = "run_id int, cutoff_at timestamp_ntz, logged_at timestamp_ntz, status string"
T0 = datetime(2024, 6, 1)


def brute(fetches, runs):
    last = {}
    for r in sorted(runs, key=lambda r: r[2]):
        last[r[0]] = r
    good = sorted((r for r in last.values() if (r[3] or "").strip().lower() == "success"), key=lambda r: r[1])
    first = {}
    for f in sorted(fetches, key=lambda f: f[3]):
        first.setdefault(f[0], f)
    tag = lambda x: (x.strip().removeprefix("W/").strip('"') or None) if x else None
    seen, out = {}, set()
    for run in good:
        current = {}
        for f in first.values():
            if f[3] <= run[1] and f[1] is not None and (f[1] not in current or (f[2], f[0]) > (current[f[1]][2], current[f[1]][0])):
                current[f[1]] = f
        for url, f in current.items():
            old = seen.get(url)
            if old is None:
                case = True
            elif old[0] == f[0]:
                case = False
            elif tag(old[4]) and tag(f[4]):
                case = tag(old[4]) != tag(f[4])
            elif old[5] and f[5]:
                case = old[5] != f[5]
            else:
                case = True
            if case:
                seen[url] = f
                out.add((run[0], f[0]))
    return out


def data(seed, n=300):
    rnd = random.Random(seed)
    fetches = []
    for k in range(n):
        at = T0 + timedelta(hours=rnd.randrange(20 * 24))
        url = "hot" if rnd.random() < 0.4 else rnd.choice(["u1", "u2", "u3", "u4", None])
        modified = rnd.choice([None, *[(T0 - timedelta(days=x)).strftime("%a, %d %b %Y 10:00:00 GMT") for x in (1, 2)]])
        row = (k, url, at, at + timedelta(hours=rnd.choice([0, 1, 50])), rnd.choice([None, '"a"', 'W/"a"', "b", '"c"']), modified, 5)
        fetches.append(row)
        if rnd.random() < 0.1:
            fetches.append((*row[:3], row[3] + timedelta(hours=30), *row[4:]))
    runs = []
    for r in range(20):
        cut = T0 + timedelta(days=r, hours=3)
        runs.append((r, cut, cut, "running"))
        if r % 4:
            runs.append((r, cut, cut + timedelta(hours=1), rnd.choice(["success", "SUCCESS", "failed"])))
        if r % 7 == 3:
            runs.append((r, cut, cut + timedelta(hours=2), "rolled_back"))
    return fetches, runs


def table(spark, folder, rows, name="a.parquet"):
    """Rows as one file of a folder."""
    spark.createDataFrame(rows, FETCHES).coalesce(1).write.mode("overwrite").parquet(f"{folder}-made")
    os.makedirs(folder, exist_ok=True)
    (made,) = glob.glob(f"{folder}-made/*.parquet")
    os.replace(made, f"{folder}/{name}")
    return str(folder)


def rows_of(df):
    return sorted((r.run_id, r.fetch_id) for r in df.collect())


def test_catch_up_against_brute_force(spark, tmp_path):
    fetches, runs = data(1)
    got = rows_of(i.found(spark, table(spark, tmp_path / "in", fetches), spark.createDataFrame(runs, RUNS)))
    assert got == sorted(brute(fetches, runs))


@pytest.mark.parametrize("seed", [1, 5])
def test_runs_taken_apart_or_together_give_the_same(spark, tmp_path, seed):
    fetches, runs = data(seed, 150)
    due = i.successful_runs(spark.createDataFrame(runs, RUNS))
    manifest = i.Manifest(spark, session.shared_dir(spark, "apart"))
    for k, (run, cutoff) in enumerate(due[:3]):  # a file arrives per run; the last ones come in one file with what is left
        before = due[k - 1][1] if k else datetime.min
        table(spark, tmp_path / "in", [f for f in fetches if before < f[3] <= cutoff], f"{k}.parquet")
        assert i.catch_up(manifest, str(tmp_path / "in"), [(run, cutoff)]) == 1
        assert i.catch_up(manifest, str(tmp_path / "in"), [(run, cutoff)]) == 0
    table(spark, tmp_path / "in", [f for f in fetches if f[3] > due[2][1]], "rest.parquet")
    assert i.catch_up(manifest, str(tmp_path / "in"), due[:5]) == 2
    assert not manifest.inputs().where("path LIKE '%rest%' AND complete").count()  # it holds rows of later runs
    assert i.catch_up(manifest, str(tmp_path / "in"), due) == len(due) - 5
    assert rows_of(i.cases(manifest)) == sorted(brute(fetches, runs))
    assert manifest.damaged() == []
    with pytest.raises(ValueError, match="earlier"):
        i.catch_up(manifest, str(tmp_path / "in"), [(99, T0)])


def lost(*_, **__):
    raise OSError("lost")


def half(spark, path, text):
    CREATE(spark, path, text[: len(text) // 2])
    raise OSError("lost")


CREATE = session.create_text


@pytest.mark.parametrize("where, stand_in", [("create_text", lost), ("create_text", half), ("list_files", None)])
def test_a_crash_at_any_step_of_the_commit_keeps_the_history(spark, tmp_path, monkeypatch, where, stand_in):
    fetches, runs = data(1, 80)
    due = i.successful_runs(spark.createDataFrame(runs, RUNS))
    folder, manifest = table(spark, tmp_path / "in", fetches), i.Manifest(spark, session.shared_dir(spark, "crash"))
    i.catch_up(manifest, folder, due[:4])
    first = rows_of(i.cases(manifest))
    with monkeypatch.context() as mp:
        calls = []
        listing = session.list_files
        mp.setattr(session, where, stand_in or (lambda *a: lost() if "batches" in a[1] or calls.append(a) else listing(*a)))
        with pytest.raises(OSError):
            i.catch_up(i.Manifest(spark, manifest.folder), folder, due[:6])
    again = i.Manifest(spark, manifest.folder)  # a new process
    assert len(again.committed()) == 1 and rows_of(i.cases(again)) == first
    assert i.catch_up(again, folder, due) == len(due) - 4
    assert rows_of(i.cases(again)) == sorted(brute(fetches, runs))


def test_two_writers_cannot_commit_the_same_number(spark):
    path = session.shared_dir(spark, "one") + "/commits/000000000001.json"
    session.create_text(spark, path, "{}")
    with pytest.raises(Exception, match="exists"):
        session.create_text(spark, path, "[]")
    assert session.read_text(spark, path) == "{}"


@pytest.mark.parametrize("text", ["Thu, 21 Mar 2024 15:12:59 GMT", "2024-03-21T15:12:59Z", "2024-03-21T10:12:59-05:00", "2024-03-21T20:42:59+0530", "21-Mar-2024 15:12:59 GMT"])
def test_instants(spark, text):
    got = spark.createDataFrame([(text,)], "v string").select(i.instant(i.F.col("v")).alias("s")).head().s
    assert got == datetime(2024, 3, 21, 15, 12, 59, tzinfo=timezone.utc).timestamp()


def test_unreadable_validators_are_absent(spark):
    df = spark.createDataFrame([("yesterday", ' W/"x"'), ("", '""'), (None, None), ("Thu, 99 Foo 2024 15:12:59 GMT", "w/y")], "m string, e string")
    got = df.select(i.instant(i.F.col("m")).alias("m"), i.entity_tag(i.F.col("e")).alias("e")).collect()
    assert [(r.m, r.e) for r in got] == [(None, "x"), (None, None), (None, None), (None, "y")]


def test_files_are_taken_once_and_again_when_changed(spark, tmp_path):
    m, folder = i.Manifest(spark, session.shared_dir(spark, "files")), tmp_path / "in"
    spark.range(3).coalesce(1).write.parquet(str(folder))
    double = lambda df: df.select((i.F.col("id") * 2).alias("x"))
    assert [i.run_files(m, k, str(folder), double) for k in (1, 1, 2)] == [1, 0, 0]
    (name,) = folder.glob("*.parquet")
    os.utime(name, (1, 1))  # touched, same contents
    shutil.copy(name, folder / "copy.parquet")
    assert i.run_files(m, 2, str(folder), double) == 0
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(str(folder))
    assert i.run_files(m, 3, str(folder), double) == 1
    assert m.fresh(str(folder), verify=True).count() == 0
    assert sorted(r.x for r in m.entries("x bigint").collect()) == [0, 2, 4, 20, 22]
    assert m.damaged() == [] and m.inputs().count() == 2
    spark.range(1).select((i.F.col("id") + 5).alias("x")).write.mode("overwrite").parquet(m.path(3))
    assert m.damaged() == [3]


def test_empty_tables(spark, tmp_path):
    runs = spark.createDataFrame(data(1)[1], RUNS)
    assert i.found(spark, table(spark, tmp_path / "none", []), runs).count() == 0
    assert i.found(spark, table(spark, tmp_path / "some", data(1)[0]), runs.limit(0)).count() == 0
