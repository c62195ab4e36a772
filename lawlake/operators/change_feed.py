"""Current state of a table from a feed of inserts, updates and deletes in any order.

Every bucket of keys holds its state in an embedded DuckDB table and takes changes as conditional
upserts: a change is stored only if its sequence is above the one stored, so repeated and late changes do
nothing, and a removal stays behind as a tombstone sequence. All registers are maxima, hence the order of
arrival is irrelevant and partial states merge by the same upsert: each input task first compacts its own
changes (a key that holds a third of the feed leaves a task as one row), then rows meet in their bucket with
the bucket's stored registers.

A batch of the feed starts from the published state and publishes the next one (``session.Generations``): all
buckets become visible together, a crash leaves the state before. An effect's revision can take back what
an earlier one did to a provision, which maxima can't; so the effects are a state of their own, and the
provisions that a changed effect meets or met are folded anew from it, the others kept.

Memory of a bucket is that of its keys (DuckDB spills beyond its limit); the number of buckets follows
spark.sql.shuffle.partitions.

Defined results: a change with a null key or null sequence has no effect; of changes that agree in key and
sequence either holds, as they are repeats; an empty feed publishes an empty table; a feed applied in any
number of batches, overlapping or not, gives the state of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawlake import session


@dataclass(frozen=True)
class Register:
    """The change of greatest ``seq`` among those where ``when`` holds, with its payload columns."""

    name: str
    when: str
    payload: tuple[str, ...] = ()


def _upsert(keys: list[str], registers: list[Register], memory: str):
    """mapInArrow function: upserts the rows of a partition, changes and stored registers, into its bucket and emits the state."""
    import duckdb  # noqa: F401  (fail on the driver if it isn't installed)

    def q(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def columns(r: Register) -> list[str]:
        return [f"{r.name}_seq", *[f"{r.name}_{p}" for p in r.payload]]

    key_list = ", ".join(map(q, keys))
    state_cols = [c for r in registers for c in columns(r)]
    ddl = f"CREATE TABLE state ({', '.join(q(k) + ' VARCHAR' for k in keys)}, {', '.join(q(c) + ' VARCHAR' for c in state_cols)}, PRIMARY KEY ({key_list}))"

    def statement(r: Register) -> str:
        cols = columns(r)
        seq, pay = q(cols[0]), cols[1:]
        sets = ", ".join(f"{q(c)} = excluded.{q(c)}" for c in cols)
        # one row per key and statement: the greatest sequence of the batch (the struct keeps null payloads)
        best = f", arg_max(struct_pack({', '.join(f'{q(p)} := {q(p)}' for p in pay)}), {seq}) AS best" if pay else ""
        source = f"SELECT {key_list}, max({seq}) AS {seq}{best} FROM changes WHERE {seq} IS NOT NULL GROUP BY {key_list}"
        if pay:
            source = f"SELECT {key_list}, {seq}, {', '.join(f'best.{q(p)}' for p in pay)} FROM ({source})"
        return (
            f"INSERT INTO state ({key_list}, {', '.join(map(q, cols))}) {source} "
            f"ON CONFLICT ({key_list}) DO UPDATE SET {sets} WHERE state.{seq} IS NULL OR excluded.{seq} > state.{seq}"
        )

    statements = [statement(r) for r in registers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if con is None:
                con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
                con.execute(ddl)
            con.register("changes", pa.Table.from_batches([batch]))
            for s in statements:
                con.execute(s)
            con.unregister("changes")
        if con is not None:
            yield from con.sql(f"SELECT {key_list}, {', '.join(map(q, state_cols))} FROM state").to_arrow_reader(50_000)
            con.close()

    return run


def apply_changes(feed: DataFrame, keys: list[str], seq: Column, registers: list[Register], stored: DataFrame | None = None, memory: str = "400MB") -> DataFrame:
    """One row per key: for each register the sequence and payload of its greatest change (null if none).

    ``seq`` must be a string whose order is that of the changes; ``stored`` is an earlier result to start
    from. Columns come out as ``<register>_seq`` and ``<register>_<payload>``, all strings.
    """
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    made = feed.withColumn("__seq", seq)
    for r in registers:
        hit = F.expr(r.when) & F.col("__seq").isNotNull()
        cols.append(F.when(hit, F.col("__seq")).alias(f"{r.name}_seq"))
        cols += [F.when(hit, F.col(p).cast("string")).alias(f"{r.name}_{p}") for p in r.payload]
    changes = made.select(*cols)
    for k in keys:
        changes = changes.where(F.col(k).isNotNull())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in changes.columns])
    run = _upsert(keys, registers, memory)
    compacted = changes.mapInArrow(run, schema)
    met = compacted if stored is None else compacted.unionByName(stored)
    return met.repartition(*keys).mapInArrow(run, schema)


PUTS = "insertion", "reenactment"
REPLACES = "substitution", "replacement", "variation"
REMOVES = "repeal", "endofenactment"


def _one_of(actions: tuple[str, ...]) -> str:
    return "action IN (" + ", ".join(f"'{a}'" for a in actions) + ")"


def _order(date: str, number: str, last: str) -> Column:
    """A string that sorts like (date, number, last)."""
    return F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), F.lpad((F.col(number).cast("long") + F.lit(1 << 40)).cast("string"), 14, "0"), F.col(last))


CONTENT = {"akn_action": "string", "target_frbr_uri": "string", "target_akn_wid": "string", "effect_no": "int", "in_force_date": "date", "applied": "boolean", "new_text": "string"}
KEYS = ["target_frbr_uri", "target_akn_wid"]


def latest_revisions(feed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Of each publisher_effect_id the content of its highest revision (of repeated deliveries the last), as registers."""
    seq = F.concat_ws("|", *[F.lpad((F.coalesce(F.col(c), F.lit(-1)).cast("long") + F.lit(1 << 50)).cast("string"), 17, "0") for c in ("revision", "feed_seq")])
    return apply_changes(feed, ["publisher_effect_id"], seq, [Register("rev", "true", tuple(CONTENT))], stored)


def _contents(effects: DataFrame) -> DataFrame:
    return effects.select("publisher_effect_id", *[F.col(f"rev_{c}").cast(t).alias(c) for c, t in CONTENT.items()])


def provision_registers(effects: DataFrame) -> DataFrame:
    """Per provision its last removal, its last placing and the last effect that set its text."""
    live = _contents(effects).where("applied AND in_force_date IS NOT NULL AND target_akn_wid IS NOT NULL AND target_frbr_uri IS NOT NULL")
    live = live.withColumn("action", F.lower(F.regexp_replace("akn_action", r"^\s+|\s+$", "")))
    seq = F.when(F.col("effect_no").isNotNull(), _order("in_force_date", "effect_no", "publisher_effect_id"))
    registers = [
        Register("removed", _one_of(REMOVES)),
        Register("put", _one_of(PUTS)),
        Register("text", _one_of(PUTS + REPLACES), ("publisher_effect_id", "new_text")),
    ]
    return apply_changes(live, KEYS, seq, registers)


def standing(registers: DataFrame) -> DataFrame:
    """``(target_frbr_uri, target_akn_wid, publisher_effect_id, new_text)`` of the provisions there in the end.

    A provision stands if it was put there after its last removal; its text is that of the last effect that
    put or replaced it, which then lies after that removal as well.
    """
    there = F.col("put_seq").isNotNull() & (F.col("removed_seq").isNull() | (F.col("put_seq") > F.col("removed_seq")))
    return registers.where(there).select(*KEYS, F.col("text_publisher_effect_id").alias("publisher_effect_id"), F.col("text_new_text").alias("new_text"))


class Provisions:
    """The provisions standing after all batches of a feed, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, session.Generations(spark, folder)

    def _stored(self, folder: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{folder}/{kind}")

    def apply(self, feed: DataFrame) -> None:
        """Apply a batch of the feed and publish the next state."""
        number, before = self.store.current()
        after = self.store.start()
        latest_revisions(feed, self._stored(before, "effects") if before else None).write.parquet(f"{after}/effects")
        effects = self._stored(after, "effects")
        if before is None:
            provision_registers(effects).write.parquet(f"{after}/provisions")
        else:
            ids = feed.select("publisher_effect_id").where("publisher_effect_id IS NOT NULL").distinct()
            of = lambda state: state.join(ids, "publisher_effect_id", "left_semi").select(*[F.col(f"rev_{k}").alias(k) for k in KEYS])
            met = of(self._stored(before, "effects")).union(of(effects)).dropna().distinct()
            met.write.parquet(f"{after}/met")
            met = self._stored(after, "met")
            again = effects.join(met.select(*[F.col(k).alias(f"rev_{k}") for k in KEYS]), [f"rev_{k}" for k in KEYS], "left_semi")
            kept = self._stored(before, "provisions").join(met, KEYS, "left_anti")
            kept.unionByName(provision_registers(again)).write.parquet(f"{after}/provisions")
        self.store.publish(after, number)

    def standing(self) -> DataFrame:
        _, current = self.store.current()
        if current is None:
            raise ValueError("nothing was published yet")
        return standing(self._stored(current, "provisions"))


def found(spark: SparkSession, feed: DataFrame) -> DataFrame:
    """p7_found: the standing provisions with the effect their text comes from."""
    provisions = Provisions(spark, session.shared_dir(spark, "change-feed"))
    provisions.apply(feed)
    return provisions.standing().select(*KEYS, "publisher_effect_id")
