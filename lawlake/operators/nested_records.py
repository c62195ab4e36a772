"""Deeply nested XML records into flat, linked tables.

1. Every record is stream-parsed once (expat, no tree in memory) into path-value-ordinal triples: an element's
   opening (no value), its attributes (``path@name``) and its text (``path#text``), in document order, which is
   the ordinal. The triples are written once to the shared folder, whole.
2. The groups are found from them: an element that somewhere has a sibling of its name is repeated. Paths
   are grouped by their nearest repeated ancestor. Elements may also be declared rows, repeated or not.
3. Every group is pivoted into one table: a row per element with its number and its parent row, a column per
   path below it. As a path says at which depths its ancestors are rows, the row a triple belongs to is the
   last one opened at that depth, found for a batch of records at once in arrays; no triple is shuffled.

Declared rows share one numbering per record (``node_no``), so that ``parent_no`` means one row; rows of other
groups are numbered within their group, and their parent is named with its group.

Defined results: a null, blank or not well-formed record yields no row; of a record delivered more than once
(same id) one delivery holds, the one of least hash where they differ; attributes and texts absent from an
element are null; a path met more than once below a row gives its values joined by a blank in document order;
comments, CDATA sections and processing instructions open no element; namespace prefixes are dropped;
external entities are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake import session

# The elements of the schema that are rows wherever they stand.
ROW_ELEMENTS = (
    "part", "chapter", "section", "article", "subsection", "paragraph", "point",
    "hcontainer", "attachment", "table", "tr", "ref",
)


def xml_triples(text: str | bytes | None) -> tuple[list[str], list[str | None], set[str]] | None:
    """Paths and values of one record's triples in document order, and its repeated element names; None if it isn't well-formed."""
    if text is None or not text.strip():
        return None
    paths: list[str] = []
    values: list[str | None] = []
    repeated: set[str] = set()
    stack: list[tuple[str, list[str], set[str]]] = [("", [], set())]  # path, pieces of text, names of children

    def start(name: str, attrs: dict[str, str]) -> None:
        tag = name.rpartition(":")[2]
        above, _, seen = stack[-1]
        if tag in seen:
            repeated.add(tag)
        seen.add(tag)
        path = f"{above}/{tag}"
        paths.append(path)
        values.append(None)
        for key, value in attrs.items():
            if not key.startswith("xmlns"):
                paths.append(f"{path}@{key.rpartition(':')[2]}")
                values.append(value)
        stack.append((path, [], set()))

    def end(name: str) -> None:
        path, pieces, _ = stack.pop()
        if said := "".join(pieces).strip():
            paths.append(f"{path}#text")
            values.append(said)

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.buffer_text = True
    parser.CharacterDataHandler = lambda data: stack[-1][1].append(data)
    try:
        parser.Parse(text.encode() if isinstance(text, str) else text, True)
    except expat.ExpatError:
        return None
    return paths, values, repeated


TRIPLES = "record_id string, digest bigint, paths array<string>, `values` array<string>, repeated array<string>"


def triples(records: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """One row of ``TRIPLES`` per well-formed delivery of a record with an id."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, paths, values, names, ends, name_ends = [], [], [], [], [0], [0]
            for at, text in enumerate(batch.column(2).to_pylist()):
                if (found := xml_triples(text)) is not None:
                    keep.append(at)
                    paths += found[0]
                    values += found[1]
                    names += found[2]
                    ends.append(len(paths))
                    name_ends.append(len(names))
            offsets, name_offsets = pa.array(ends, pa.int32()), pa.array(name_ends, pa.int32())
            kept = pa.array(keep, pa.int32())
            columns = [batch.column(0).take(kept), batch.column(1).take(kept)]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.string())) for x in (paths, values)]
            columns.append(pa.ListArray.from_arrays(name_offsets, pa.array(names, pa.string())))
            yield pa.RecordBatch.from_arrays(columns, ["record_id", "digest", "paths", "values", "repeated"])

    said = records.select(F.col(id_col).cast("string").alias("record_id"), F.xxhash64(xml_col).alias("digest"), F.col(xml_col).alias("xml"))
    return said.where("record_id IS NOT NULL AND xml IS NOT NULL").mapInArrow(parse, TRIPLES)


@dataclass(frozen=True)
class Place:
    """What a path says: kind of triple, depth of its element, its group and column, depth of its row and of that row's parent."""

    opens: bool
    depth: int
    group: str
    column: str
    row_depth: int
    parent_depth: int
    parent_group: str


def place(path: str, declared: frozenset[str], groups: frozenset[str]) -> Place:
    element, mark, name = path, "", ""
    for sign in "@#":
        if sign in path:
            element, mark, name = path.partition(sign)
    tags = element.split("/")[1:]
    rows = [d for d, tag in enumerate(tags, 1) if tag in declared or tag in groups]
    row = rows[-1] if rows else 0
    group = tags[row - 1] if row else ""
    # a declared row's parent is the nearest declared one, so that all of them form one tree
    above = [d for d in rows if d < row and (group not in declared or tags[d - 1] in declared)]
    parent = above[-1] if above else 0
    below = "/".join(tags[row:])
    column = f"{below}@{name}" if mark == "@" else below or "#text"
    return Place(not mark and row == len(tags), len(tags), group, "" if not mark else column, row, parent, tags[parent - 1] if parent else "")


class Pivot:
    """The rows of a batch of records' triples, in arrays."""

    def __init__(self, paths: pa.Array, declared: frozenset[str], groups: frozenset[str]):
        """``paths`` is the column of path arrays."""
        known = lru_cache(1 << 16)(lambda p: place(p, declared, groups))
        coded = paths.flatten().dictionary_encode()
        self.places = [known(p) for p in coded.dictionary.to_pylist()]
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = paths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.record = np.repeat(np.arange(len(lengths)), lengths)
        is_open = np.array([not set(p) & set("@#") for p in coded.dictionary.to_pylist()], bool)
        pick = lambda f, kind: np.array([f(p) for p in self.places], kind)[self.code] if len(self.code) else np.array([], kind)
        self.opens, self.depth = pick(lambda p: p.opens, bool), pick(lambda p: p.depth, np.int64)
        self._elements = is_open[self.code] if len(self.code) else np.array([], bool)
        names = {g: i for i, g in enumerate(sorted({p.group for p in self.places}))}
        self.group_names = np.array([*names, ""], dtype=object)
        group = pick(lambda p: names[p.group], np.int64)
        in_tree = pick(lambda p: p.group in declared, bool)
        self.rows = np.flatnonzero(self.opens)
        self.number = np.zeros(len(self.code), np.int64)
        # declared rows share one numbering, other groups have their own
        for member in (self.opens & in_tree, *(self.opens & (group == i) & ~in_tree for g, i in names.items() if g not in declared and g)):
            count = np.cumsum(member)
            first = np.concatenate([[0], count])[np.searchsorted(self.record, self.record)] if len(count) else count
            self.number[member] = (count - first)[member]
        self.group = group
        self.owner = self._last_open(pick(lambda p: p.row_depth, np.int64))
        parent = self._last_open(pick(lambda p: p.parent_depth, np.int64))
        self.parent = np.where(parent >= 0, self.number[np.maximum(parent, 0)], 0) if len(parent) else parent
        above = {g: i for i, g in enumerate(sorted({p.parent_group for p in self.places}))}
        self.parent_names, self.parent_group = np.array([*above, ""], dtype=object), pick(lambda p: above[p.parent_group], np.int64)

    def _last_open(self, wanted: np.ndarray) -> np.ndarray:
        """For each triple the place of the last element opened at the wanted depth (-1 for depth 0); it is open still."""
        out = np.full(len(wanted), -1)
        opened, asked = np.flatnonzero(self._elements), np.flatnonzero(wanted)
        opened, asked = opened[np.argsort(self.depth[opened], kind="stable")], asked[np.argsort(wanted[asked], kind="stable")]
        open_depths, ask_depths = self.depth[opened], wanted[asked]
        for d in np.unique(ask_depths):
            mine = opened[np.searchsorted(open_depths, d) : np.searchsorted(open_depths, d, "right")]
            these = asked[np.searchsorted(ask_depths, d) : np.searchsorted(ask_depths, d, "right")]
            out[these] = mine[np.searchsorted(mine, these, "right") - 1]
        return out

    def links(self, ids: pa.Array) -> list[pa.Array]:
        """``record_id, akn_type, node_no, parent_type, parent_no`` of all rows."""
        r = self.rows
        return [
            ids.take(pa.array(self.record[r])), pa.array(self.group_names[self.group[r]], pa.string()), pa.array(self.number[r], pa.int32()),
            pa.array(self.parent_names[self.parent_group[r]], pa.string()), pa.array(self.parent[r], pa.int32()),
        ]

    def columns(self, values: pa.Array, group: str, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        """The rows of a group and, for each named path below them, its values."""
        mine = self.rows[self.group_names[self.group[self.rows]] == group] if len(self.rows) else self.rows
        said, out = values.flatten(), []
        for name in names:
            hit = np.array([p.group == group and p.column == name for p in self.places], bool)
            at = np.flatnonzero(hit[self.code]) if len(self.code) else np.array([], np.int64)
            row: dict[int, list[str]] = {}
            for owner, value in zip(self.owner[at].tolist(), said.take(pa.array(at)).to_pylist()):
                row.setdefault(owner, []).append(value)
            out.append(pa.array([" ".join(row[k]) if k in row else None for k in mine.tolist()], pa.string()))
        return mine, out


class Tables:
    """The flat tables of a collection of records, from triples written once."""

    def __init__(self, spark: SparkSession, records: DataFrame, id_col: str, xml_col: str, declared: Iterable[str] = ROW_ELEMENTS):
        self.declared = frozenset(declared)
        folder = session.shared_dir(spark, "triples")
        triples(records, id_col, xml_col).withColumn("delivery", F.monotonically_increasing_id()).write.parquet(f"{folder}/all")
        written = spark.read.parquet(f"{folder}/all")
        # of records delivered again one delivery holds; written, so that the size of their list decides how it meets the triples
        again = written.groupBy("record_id").agg(F.min(F.struct("digest", "delivery")).alias("keep"), F.count("*").alias("n")).where("n > 1")
        again.select("record_id", F.col("keep.delivery").alias("only")).write.parquet(f"{folder}/again")
        met = written.join(spark.read.parquet(f"{folder}/again"), "record_id", "left")
        self.triples = met.where("only IS NULL OR delivery = only").drop("only", "delivery", "digest")
        self._repeated = written.select(F.explode("repeated").alias("name")).distinct()
        self._groups: frozenset[str] | None = None

    def groups(self) -> frozenset[str]:
        """Names of all groups: declared rows and elements repeated anywhere. As many as the schema has names."""
        if self._groups is None:
            self._groups = frozenset(r.name for r in self._repeated.collect())
        return self._groups | self.declared

    def links(self) -> DataFrame:
        """``(record_id, akn_type, node_no, parent_type, parent_no)``: the link columns of all tables."""
        declared, groups = self.declared, self.groups()

        def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(Pivot(batch.column(1), declared, groups).links(batch.column(0)), ["record_id", "akn_type", "node_no", "parent_type", "parent_no"])

        return self.triples.select("record_id", "paths").mapInArrow(pivot, "record_id string, akn_type string, node_no int, parent_type string, parent_no int")

    def fields(self, group: str) -> list[str]:
        """The paths below the rows of a group, each a column of its table."""
        declared, groups = self.declared, self.groups()
        paths = self.triples.select(F.explode(F.array_distinct("paths")).alias("path")).where(F.contains("path", F.lit(f"/{group}"))).distinct()
        found = (place(r.path, declared, groups) for r in paths.collect())  # as many as the schema has paths
        return sorted({p.column for p in found if p.group == group and p.column})

    def table(self, group: str, fields: dict[str, str] | None = None) -> DataFrame:
        """The table of one group: ``record_id, node_no, parent_type, parent_no`` and a column per path.

        ``fields`` maps columns to paths (``@eId``, ``num``, ``content/p``); without it every path is a column
        of its own name.
        """
        declared, groups = self.declared, self.groups()
        wanted = {p: p for p in self.fields(group)} if fields is None else fields
        names = ["record_id", "node_no", "parent_type", "parent_no", *wanted]

        def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = Pivot(batch.column(1), declared, groups)
                rows, columns = p.columns(batch.column(2), group, list(wanted.values()))
                links = [batch.column(0).take(pa.array(p.record[rows])), pa.array(p.number[rows], pa.int32()), pa.array(p.parent_names[p.parent_group[rows]], pa.string()), pa.array(p.parent[rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(links + columns, names)

        schema = "record_id string, node_no int, parent_type string, parent_no int" + "".join(f", `{c}` string" for c in wanted)
        return self.triples.select("record_id", "paths", "values").mapInArrow(pivot, schema)


def found(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """p2_found: the link columns of the tables of the declared elements of every well-formed ``akn_xml``."""
    links = Tables(spark, versions, "id", "akn_xml").links().where(F.col("akn_type").isin(*ROW_ELEMENTS))
    return links.select(F.col("record_id").alias("version_id"), "node_no", "parent_no", "akn_type")


def group_sizes(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """``(akn_type, parent_type, n_rows)``: how many rows each table has under each kind of parent row ("" for none)."""
    links = Tables(spark, versions, "id", "akn_xml").links()
    return links.groupBy("akn_type", "parent_type").agg(F.count("*").alias("n_rows"))
