"""Processing only new or changed records, with a manifest of input files.

The manifest names the input files that committed batches took, with size and checksum. A batch lists the
files there are, anti-joins the listing against the manifest, reads the rest, writes its result to the folder
of its batch identifier (overwriting what a failed attempt left) and then commits by creating one new file.
A crash before the commit leaves the manifest as it was, so the batch is repeated whole; a crash after it
leaves nothing to do; a repeated identifier is a no-op. Nothing committed is ever replaced or deleted.

For fetches of sources (``catch_up``) the result of a batch is also the state the next one starts from: one row
per source with its current fetch and its latest case. A batch reads that state and the new files, never
the history, and any number of due runs is one batch: the cost doesn't grow with the number of runs.

Defined results: rows without source, fetch id, fetched_at or landed_at cannot be listed and are ignored;
fetches that land again keep their first arrival; blank validators count as absent, unreadable
last_modified values too; no successful run, or an empty table, gives no rows; a due run earlier than
the last committed one is refused; a record that comes in a file later than its landed_at is taken by the
next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawlake import session

FETCH = "struct<fetched_at:timestamp_ntz,fetch_id:bigint,tag:string,modified:bigint>"
CASES = "array<struct<run_id:int,fetch_id:bigint>>"
STATE = f"source_url string, current {FETCH}, last {FETCH}, cases {CASES}"
INPUT = "path string, bytes bigint, changed timestamp_ntz, rows bigint, checksum bigint, complete boolean"
LANDING = "fetch_id bigint, source_url string, fetched_at timestamp_ntz, landed_at timestamp_ntz, etag string, last_modified string"
USED = ["fetch_id", "source_url", "fetched_at", "landed_at", "etag", "last_modified"]


def entity_tag(c: Column) -> Column:
    """An entity tag without weakness mark and quotes; null if blank."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[Ww]/", ""), '^"|"$', "")
    return F.when(bare != "", bare)


def instant(c: Column) -> Column:
    """Seconds since 1970 of an HTTP date or an ISO date-time with offset; null if neither."""
    v = F.trim(c)
    iso = F.regexp_extract(v, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.\d+)?(Z|[+-]\d\d:?\d\d)$", 0)
    http = r"^(?:[A-Za-z]{3,9}, +)?(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4}) (\d\d):(\d\d):(\d\d) (GMT|UTC|[+-]\d{4})$"
    names = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    month = ((F.instr(names, F.lower(F.regexp_extract(v, http, 2))) + 2) / 3).cast("int")
    text = F.format_string("%s-%02d-%s %s:%s:%s", F.regexp_extract(v, http, 3), month, F.lpad(F.regexp_extract(v, http, 1), 2, "0"), F.regexp_extract(v, http, 4), F.regexp_extract(v, http, 5), F.regexp_extract(v, http, 6))

    def seconds(local: Column) -> Column:
        return F.unix_seconds(F.try_to_timestamp(F.concat(local, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))

    def offset(zone: Column) -> Column:
        digits = F.regexp_replace(zone, ":", "")
        size = F.substring(digits, 2, 2).cast("int") * 3600 + F.substring(digits, 4, 2).cast("int") * 60
        return F.when(digits.rlike(r"^[+-]\d{4}$"), F.when(digits.startswith("-"), -size).otherwise(size)).otherwise(0)

    iso_local = F.concat(F.substring(v, 1, 10), F.lit(" "), F.substring(v, 12, 8))
    return (
        F.when(iso != "", seconds(iso_local) - offset(F.regexp_extract(v, r"(Z|[+-]\d\d:?\d\d)$", 1)))
        .when(v.rlike(http), seconds(text) - offset(F.regexp_extract(v, http, 7)))
    )


def successful_runs(runs: DataFrame) -> list[tuple[int, object]]:
    """(run_id, cutoff_at) of the runs whose last-logged row says success, by cutoff. The log has one entry per run and day."""
    last = runs.where("run_id IS NOT NULL AND cutoff_at IS NOT NULL").groupBy("run_id").agg(
        F.max(F.struct("logged_at", F.lower(F.trim("status")).alias("status"), "cutoff_at")).alias("x")
    )
    rows = last.where("x.status = 'success'").select("run_id", "x.cutoff_at").collect()
    return sorted(((r.run_id, r.cutoff_at) for r in rows), key=lambda r: (r[1], r[0]))


class Manifest:
    """The committed batches of a pipeline in a folder.

    ``batches/batch_id=N`` holds the rows of a batch, ``inputs/batch_id=N`` the input files it took with size,
    time of change and checksum, ``commits/<number>.json`` says that batch N is done. Commits are only ever
    created, never replaced or deleted; one that was cut off while being written doesn't count.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, dict] = {}

    def committed(self) -> list[dict]:
        """The complete commits in order; each is read once."""
        for name, _ in session.list_files(self.spark, f"{self.folder}/commits"):
            if name not in self._read:
                try:
                    self._read[name] = json.loads(session.read_text(self.spark, f"{self.folder}/commits/{name}") or "")
                except Exception as cut_off:  # a commit that never ended: no JSON, or bytes that miss their checksum
                    if "Checksum" not in str(cut_off) and not isinstance(cut_off, ValueError):
                        raise
        return [self._read[name] for name in sorted(self._read)]

    def has(self, batch_id: int) -> bool:
        return any(b["batch_id"] == batch_id for b in self.committed())

    def path(self, batch_id: int, kind: str = "batches") -> str:
        return f"{self.folder}/{kind}/batch_id={batch_id}"

    def entries(self, schema: str | T.StructType) -> DataFrame:
        """All rows of the committed batches; what a failed attempt wrote isn't among them."""
        return self._rows(schema, [self.path(b["batch_id"]) for b in self.committed() if b["files"]])

    def _rows(self, schema: str | T.StructType, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def inputs(self) -> DataFrame:
        """The input files of all committed batches."""
        return self._rows(INPUT, [self.path(b["batch_id"], "inputs") for b in self.committed() if b["n_inputs"]])

    def fresh(self, folder: str, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
        """The parquet files of a folder (or one file) that no committed batch took whole, as rows of ``INPUT``.

        Files known by path, size and time of change aren't opened (all are with ``verify``); of the others the
        checksum over ``columns`` is taken, and what was taken before with this size and checksum is left out,
        whatever its name.
        """
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        listed = listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("changed"))
        known = self.inputs().where("complete")
        unknown = listed if verify else listed.join(known, ["path", "bytes", "changed"], "left_anti")
        at = {r.path: r.changed for r in unknown.collect()}  # new files only, as the reader lists them too
        if not at:
            return self.spark.createDataFrame([], INPUT)
        rows = self.spark.read.parquet(*at)
        sums = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(*_checksum(columns or rows.columns))
        times = self.spark.createDataFrame(list(at.items()), "name string, changed timestamp_ntz")
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        taken = sums.join(F.broadcast(times), bare(F.col("path")) == bare(F.col("name"))).join(known, ["bytes", "checksum"], "left_anti")
        return taken.select(F.col("name").alias("path"), "bytes", "changed", "rows", "checksum", F.lit(True).alias("complete"))

    def write(self, batch_id: int, rows: DataFrame, inputs: DataFrame | None = None, **facts) -> None:
        """Write a batch over what a failed attempt left of it, then commit it; its checksum is taken in passing."""
        seen = Observation()
        rows.observe(seen, *_checksum(rows.columns)).write.mode("overwrite").parquet(self.path(batch_id))
        n_inputs = 0
        if inputs is not None:
            counted = Observation()
            inputs.observe(counted, F.count("*").alias("n")).write.mode("overwrite").parquet(self.path(batch_id, "inputs"))
            n_inputs = counted.get["n"]
        self.commit(batch_id, {**seen.get, "n_inputs": n_inputs, **facts})

    def commit(self, batch_id: int, facts: dict) -> None:
        """Record the batch with its files, their sizes and its checksum; that this file is there whole is the success."""
        files = session.list_files(self.spark, self.path(batch_id))
        entry = {"batch_id": batch_id, "files": [{"name": n, "bytes": b} for n, b in files], **facts}
        used = [int(n.partition(".")[0]) for n, _ in session.list_files(self.spark, f"{self.folder}/commits")]
        session.create_text(self.spark, f"{self.folder}/commits/{max(used, default=0) + 1:012d}.json", json.dumps(entry))

    def damaged(self) -> list[int]:
        """Committed batches whose files or contents are no longer those recorded."""
        out = []
        for b in self.committed():
            if session.list_files(self.spark, self.path(b["batch_id"])) != [(f["name"], f["bytes"]) for f in b["files"]]:
                out.append(b["batch_id"])
            elif b["files"]:
                rows = self.spark.read.parquet(self.path(b["batch_id"]))
                if rows.agg(*_checksum(rows.columns)).head().asDict() != {"rows": b["rows"], "checksum": b["checksum"]}:
                    out.append(b["batch_id"])
        return out


def _checksum(columns: list[str]) -> list[Column]:
    """The number of rows and an order-free checksum of them."""
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("checksum")]


def changed(landings: DataFrame, state: DataFrame, runs: list[tuple[int, object]]) -> DataFrame:
    """One row per source, of ``STATE``: its current fetch, its latest case, and its cases at these runs.

    Landings are reduced to the newest per source and run before sources are brought together, so a source
    with a third of all rows leaves a task as at most one row per run; then each source's few rows are
    folded in order over what the state says of it.
    """
    at = F.array(*[F.lit(c).cast("timestamp_ntz") for _, c in runs])
    idx = F.size(F.filter(at, lambda c: c < F.col("landed_at").cast("timestamp_ntz")))
    seen = landings.where("source_url IS NOT NULL AND fetch_id IS NOT NULL AND fetched_at IS NOT NULL AND landed_at IS NOT NULL")
    fetch = F.struct(F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), F.col("fetch_id").cast("bigint").alias("fetch_id"), entity_tag(F.col("etag")).alias("tag"), instant(F.col("last_modified")).alias("modified"))
    seen = seen.select("source_url", idx.alias("run_idx"), fetch.alias("f")).where(F.col("run_idx") < len(runs))
    newest = seen.groupBy("source_url", "run_idx").agg(F.max("f").alias("f"))
    none = F.lit(None).cast(FETCH)
    both = newest.select("source_url", F.struct("run_idx", "f").alias("e"), none.alias("current"), none.alias("last")).unionByName(
        state.select("source_url", F.lit(None).cast(f"struct<run_idx:int,f:{FETCH}>").alias("e"), "current", "last")
    )
    per_source = both.groupBy("source_url").agg(F.sort_array(F.collect_list("e")).alias("es"), F.max("current").alias("current"), F.max("last").alias("last"))
    run_ids = F.array(*[F.lit(r) for r, _ in runs])
    no_cases = F.array().cast(CASES)

    def step(acc: Column, e: Column) -> Column:
        f, cur, last = e["f"], acc["current"], acc["last"]
        moved = cur.isNull() | (F.struct(f["fetched_at"], f["fetch_id"]) > F.struct(cur["fetched_at"], cur["fetch_id"]))
        tags = f["tag"].isNotNull() & last["tag"].isNotNull()
        dates = f["modified"].isNotNull() & last["modified"].isNotNull()
        other = F.when(tags, f["tag"] != last["tag"]).when(dates, f["modified"] != last["modified"]).otherwise(True)
        case = moved & (last.isNull() | ((f["fetch_id"] != last["fetch_id"]) & other))
        said = F.struct(F.element_at(run_ids, e["run_idx"] + 1).alias("run_id"), f["fetch_id"].alias("fetch_id"))
        return F.struct(
            F.when(moved, f).otherwise(cur).alias("current"), F.when(case, f).otherwise(last).alias("last"),
            F.when(case, F.concat(acc["cases"], F.array(said))).otherwise(acc["cases"]).alias("cases"),
        )

    folded = per_source.select("source_url", F.aggregate("es", F.struct("current", "last", no_cases.alias("cases")), step).alias("x"))
    return folded.select("source_url", "x.current", "x.last", "x.cases")


def catch_up(manifest: Manifest, folder: str, runs: list[tuple[int, object]]) -> int:
    """Take what the given successful runs must take, from the files the manifest doesn't know; returns how many runs were due.

    Runs already committed are skipped. The due ones are one batch: its identifier is that of the last run,
    its rows are the next state of all sources with their cases. A file with rows that land after the last
    cutoff is recorded as incomplete and read again by the next batch; rows met again change nothing.
    """
    done = {r for b in manifest.committed() for r in b["runs"]}
    due = sorted(((r, c) for r, c in runs if r not in done), key=lambda x: (x[1], x[0]))
    if not due:
        return 0
    before = manifest.committed()
    if before and due[0][1].isoformat() < before[-1]["cutoff"]:
        raise ValueError(f"run {due[0][0]} is earlier than what is committed")
    spark, (batch, cutoff) = manifest.spark, due[-1]
    state = manifest._rows(STATE, [manifest.path(before[-1]["batch_id"])] if before else [])
    pending = f"{manifest.folder}/pending/batch_id={batch}"
    manifest.fresh(folder, USED).write.mode("overwrite").parquet(pending)
    fresh = spark.read.schema(INPUT).parquet(pending)
    paths = [r.path for r in fresh.select("path").collect()]
    landings = spark.read.parquet(*paths) if paths else spark.createDataFrame([], LANDING)
    later = landings.where(F.col("landed_at").cast("timestamp_ntz") > F.lit(cutoff).cast("timestamp_ntz"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    open_files = later.select(bare(F.col("_metadata.file_path")).alias("p")).distinct() if paths else spark.createDataFrame([], "p string")
    inputs = fresh.join(open_files, bare(fresh.path) == open_files.p, "left").select("path", "bytes", "changed", "rows", "checksum", F.col("p").isNull().alias("complete"))
    manifest.write(batch, changed(landings, state, due), inputs, runs=[r for r, _ in due], cutoff=cutoff.isoformat())
    session.remove(spark, pending)
    return len(due)


def cases(manifest: Manifest) -> DataFrame:
    """``(run_id, fetch_id)`` of all committed batches."""
    return manifest.entries(STATE).select(F.explode("cases").alias("c")).select("c.run_id", "c.fetch_id")


def run_files(manifest: Manifest, batch_id: int, folder: str, process: Callable[[DataFrame], DataFrame]) -> int:
    """Process the new or changed parquet files of a folder as one batch; returns how many there were."""
    if manifest.has(batch_id):
        return 0
    fresh = manifest.fresh(folder).collect()  # new files only
    if fresh:
        rows = process(manifest.spark.read.parquet(*[f.path for f in fresh]))
        manifest.write(batch_id, rows, manifest.spark.createDataFrame(fresh, INPUT), runs=[])
    return len(fresh)


def found(spark: SparkSession, fetches_path: str, runs: DataFrame) -> DataFrame:
    """p5_found: what each successful run must take, of the table's files."""
    manifest = Manifest(spark, session.shared_dir(spark, "incremental"))
    catch_up(manifest, fetches_path, successful_runs(runs))
    return cases(manifest)
