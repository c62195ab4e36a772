import zipfile

from pyspark.sql import functions as F

from lawlake.operators import stores
from lawlake.plans import structure
from lawlake.sources import lanes
from lawlake.streaming import events


def test_routes(spark):
    df = spark.createDataFrame([("https://eur-lex.example/CELEX:32016R0679",), ("/x/a.PDF?v=1",), ("a.akn.xml",), ("b.htm#c",), ("noext",), (None,)], "u string")
    assert [r.l for r in df.select(lanes.route(F.col("u")).alias("l")).collect()] == ["eu", "pdf", "akn", "html", "unknown", "unknown"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.xml", "<a/>")
        z.writestr("two.bin", "no")
    (tmp_path / "bad.zip").write_bytes(b"broken")
    rows = lanes.read_archives(spark, f"file://{tmp_path}").collect()
    assert [(r.archive, r.member, bytes(r.content)) for r in rows] == [("a.zip", "d/one.xml", b"<a/>")]
    spark.dataSource.register(lanes.ArchiveSource)
    assert [(r.archive, r.member) for r in spark.read.format("law_archive").load(str(tmp_path)).collect()] == [("a.zip", "d/one.xml")]


def test_feeds_tables_and_registers(spark, tmp_path):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><link rel="next" href="/2"/><entry><id>i</id><title>T</title><updated>2024-01-02T03:04:05Z</updated><link href="/x"/></entry></feed>'
    r = lanes.atom_entries(spark.createDataFrame([(1, atom), (2, "<feed"), (3, None)], "id int, x string"), "id", "x").collect()
    assert [(x.feed, x.entry_id, x.link, x.next_page) for x in r] == [(1, "i", "/x", "/2")]
    (tmp_path / "e.csv").write_text("a,b,c,d,e\nL1,s. 1,words substituted (temp.),L9,Yes\nL1,s. 2,weird,L9,No\n")
    dates = spark.createDataFrame([("L1", "s. 1", "2024-05-01"), ("L1", "s. 1", "2024-01-01")], "target string, target_provision string, d string").withColumn("in_force_date", F.col("d").cast("date"))
    e = {x.target_provision: (x.akn_action, x.applied, str(x.in_force_date)) for x in lanes.effects_csv(spark, str(tmp_path / "e.csv"), dates).collect()}
    assert e == {"s. 1": ("substitution", True, "2024-01-01"), "s. 2": (None, False, "None")}
    (tmp_path / "q.csv").write_text("act,amendment,on_date\nA,x,2020-01-01\nA,y,2021-01-01\n")
    g = lanes.grouped_results(spark, str(tmp_path / "q.csv")).head()
    assert g.act == "A" and len(g.amendments) == 2 and str(g.last_change) == "2021-01-01"
    laws = spark.createDataFrame([("l1", "5", 2001, "Ferry Act"), ("l2", "6", 2001, "Dyke Act"), ("l3", "6", 2001, "Mill Act")], "id string, number string, year int, title string")
    cards = spark.createDataFrame([(1, "5", 2001, "x"), (2, "6", 2001, "mill act"), (3, "9", 2001, "no")], "card_id int, number string, year int, title string")
    assert {x.card_id: (x.law_id, x.rung) for x in lanes.match_register(cards, laws).collect()} == {1: ("l1", "number"), 2: ("l3", "title"), 3: (None, None)}


def test_html_blocks(spark):
    page = "<html><head><title>no</title><script>no</script></head><body><h1>A <b>b</b></h1><p>one<br>two<ul><li>x<li>y</ul></body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, h string")
    assert [(r.tag, r.text) for r in lanes.html_blocks(df, "id", "h").orderBy("block_no").collect()] == [("h1", "A b"), ("p", "one two"), ("li", "x"), ("li", "y")]


def test_stream_equals_batch_and_is_written_once(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 2, "ab"[i % 2], 1.5, "{}") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    query = events.windowed_counts(events.stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, events.windowed_counts(df).collect()))
    assert events.sessions(df).agg(F.sum("n")).head()[0] == 30
    texts = spark.createDataFrame([(1, "Ferry Act"), (2, None)], "id bigint, text string")
    texts.write.parquet(str(tmp_path / "docs"))
    sink = events.tokenising_sink(str(tmp_path / "out"), "id", "text")
    for _ in range(2):
        events.drain(spark, spark.readStream.schema("id bigint, text string").parquet(str(tmp_path / "docs")), sink, str(tmp_path / "cp"))
    sink(texts, 0)  # delivered again
    assert sorted((r.id, list(r.tokens)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, ["ferry", "act"]), (2, [])]


def test_drained_counts_have_open_windows_and_late_events(spark, tmp_path):
    rows = [(i, f"2024-01-{9 - i // 6:02d} {23 - i % 6}:30:00" if i else None, i, "ab"[i % 2], 0.25 * i, "{}") for i in range(48)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    df = df.select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    batch = sorted(map(tuple, structure.windowed_counts(spark, str(tmp_path)).collect()))
    assert sum(r[2] for r in batch) == 47 and sorted(map(tuple, structure.stream_counts(spark, str(tmp_path)).collect())) == batch
    for i in range(8):  # one file a micro-batch, the latest day first
        df.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("event_id").between(6 * i, 6 * i + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = events.drained_counts(spark, str(tmp_path / "in"), str(tmp_path / "counts"), str(tmp_path / "counts-cp"), per_trigger=1)
    assert sorted(map(tuple, got.collect())) == batch


def test_acquisitions_are_inserted_beside_stored_ones(spark, tmp_path, monkeypatch):
    rows = [("a", "2024-01-01"), ("a", "2024-01-09"), ("b", "2024-01-02"), ("c", "2024-01-09"), ("c", "2024-01-08"), ("d", None)]
    df = spark.createDataFrame(rows, "fetch_id string, t string").select("fetch_id", F.col("t").cast("timestamp_ntz").alias("landed_at"))
    df.write.parquet(str(tmp_path / "acquired_documents.parquet"))
    seen, insert = [], stores.insert_new
    monkeypatch.setattr(stores, "insert_new", lambda stored, new, keys: (seen.append((stored, new)), insert(stored, new, keys))[1])
    got = {r.fetch_id: str(r.landed_at)[:10] for r in structure.idempotent_acquisitions(spark, str(tmp_path)).collect()}
    assert got == {"a": "2024-01-01", "b": "2024-01-02", "c": "2024-01-08", "d": "None"}
    keys = [{r.fetch_id for r in x.collect()} for x in seen[0]]
    assert keys == [{"a", "b"}, {"a", "c", "d"}]
