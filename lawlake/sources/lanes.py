"""Source lanes: routing of files and readers for text, XML, HTML, archives, feeds and publishers' tables.

Defined results: unknown suffixes go to the ``unknown`` lane; unreadable members of an archive, malformed
feeds and blank lines yield no rows; values that are absent are null.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Lanes by suffix.
SUFFIXES = {"pdf": "pdf", "txt": "text", "md": "text", "akn": "akn", "xml": "xml", "html": "html", "htm": "html", "xhtml": "html", "zip": "archive", "json": "json", "csv": "table"}


def route(location: Column) -> Column:
    """The lane of a path or URL: by publisher for EU acts, else by suffix."""
    bare = F.lower(F.regexp_replace(location, r"[?#].*$", ""))
    suffix = F.regexp_extract(bare, r"\.([a-z0-9]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    eu = bare.rlike(r"^https?://[^/]*eur-lex\.") | bare.rlike(r"celex[:_%3a]*3\d{4}[lrd]\d{4}")
    return F.when(eu, "eu").when(bare.endswith(".akn.xml"), "akn").otherwise(F.coalesce(F.try_element_at(table, suffix), F.lit("unknown")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class _Blocks(HTMLParser):
    KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote"}
    SKIP = {"script", "style", "title", "nav"}

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, str]] = []
        self.tag, self.text, self.skip = "p", [], 0

    def flush(self, following: str) -> None:
        said = " ".join("".join(self.text).split())
        if said:
            self.rows.append((self.tag, said))
        self.text, self.tag = [], following

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.KEPT:
            self.flush(tag)
        elif tag in ("br", "tr", "ul", "ol", "div"):
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.KEPT:
            self.flush("p")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, block_no, tag, text)`` of HTML pages in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                parser.flush("p")
                rows += [(key, n, *r) for n, r in enumerate(parser.rows, 1)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], [id_col, "block_no", "tag", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, block_no int, tag string, text string")


def _members(content: bytes, suffixes: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir() and info.filename.lower().endswith(suffixes):
                    try:
                        yield info.filename, z.read(info)
                    except (zipfile.BadZipFile, OSError, RuntimeError):
                        continue
    except zipfile.BadZipFile:
        return


class ArchiveSource(DataSource):
    """``spark.read.format("law_archive").load(folder)``: members of the zip files of a folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "law_archive"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema: object) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffixes = options["path"], tuple(options.get("suffixes", ".xml,.html,.txt").split(","))

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path.removeprefix("file://")).glob("*.zip"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with open(partition.value, "rb") as f:
                for name, content in _members(f.read(), self.suffixes):
                    yield partition.value.rsplit("/", 1)[-1], name, content


def read_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".xml", ".html", ".txt")) -> DataFrame:
    """``(archive, member, content)`` of zip files anywhere Spark can read (an archive is opened in one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for member, data in _members(content, suffixes):
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([member]), pa.array([data], pa.binary())], ["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, content binary")


def atom_entries(feeds: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``(feed, entry_id, title, updated, link, next_page)`` of Atom feeds."""
    ns = "{http://www.w3.org/2005/Atom}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = ElementTree.fromstring(text or "")
                except ElementTree.ParseError:
                    continue
                following = next((x.get("href") for x in root.findall(f"{ns}link") if x.get("rel") == "next"), None)
                for e in root.findall(f"{ns}entry"):
                    link = next((x.get("href") for x in e.findall(f"{ns}link") if x.get("rel", "alternate") == "alternate"), None)
                    rows.append((key, e.findtext(f"{ns}id"), e.findtext(f"{ns}title"), e.findtext(f"{ns}updated"), link, following))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *[pa.array(c, pa.string()) for c in cols[1:]]], ["feed", "entry_id", "title", "updated", "link", "next_page"])

    kind = feeds.schema[id_col].dataType.simpleString()
    made = feeds.select(id_col, xml_col).mapInArrow(run, f"feed {kind}, entry_id string, title string, updated string, link string, next_page string")
    return made.withColumn("updated", F.try_to_timestamp("updated"))


# publishers' verbs of effects with the action and the category they are; a verb that isn't here is left unmapped.
VERBS = {
    "textual": {"insertion": ["inserted", "added"], "repeal": ["omitted", "repealed", "revoked"], "substitution": ["substituted"], "renumbering": ["renumbered"]},
    "meaning": {"variation": ["modified"]},
    "scope": {"extensionOfScope": ["extended", "applied"], "exceptionOfScope": ["excluded", "restricted"]},
    "force": {"entryIntoForce": ["coming into force", "in force", "commencement order"]},
}
# What stands before a verb and narrows it, and what follows it and is no part of it.
NARROWING = "word words sum para paras comma entry entries heading".split()
FOLLOWING = ["by", "in earlier", "for", "of", "conferred"]


def effect_verb(wording: Column) -> Column:
    """The verb of a publisher's wording, without brackets, provenance and what narrows it."""
    bare = F.regexp_replace(F.lower(F.trim(wording)), r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, rf"\s+(?:{'|'.join(FOLLOWING)})\b.*$", "")
    bare = F.regexp_replace(bare, r"\bin part\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"^(?:(?:and )?(?:{'|'.join(NARROWING)})\s+)+", ""), r"\s+", " "))


def crosswalk(wording: Column) -> Column:
    """struct<action, category> that a publisher's wording stands for; null parts if it isn't known."""
    known = [(v, a, c) for c, actions in VERBS.items() for a, verbs in actions.items() for v in verbs]
    table = F.create_map(*[x for v, a, c in known for x in (F.lit(v), F.struct(F.lit(a).alias("action"), F.lit(c).alias("category")))])
    hit = F.try_element_at(table, effect_verb(wording))
    return F.struct(hit["action"].alias("action"), hit["category"].alias("category"))


def effects_csv(spark: SparkSession, path: str, in_force: DataFrame | None = None) -> DataFrame:
    """A publisher's CSV of effects (Changed Legislation, Changed Provision, Type of Effect, Changing Legislation, Applied) with the first date of the sidecar."""
    raw = spark.read.csv(path, header=True, schema="target string, target_provision string, effect string, source string, applied string")
    out = raw.withColumn("__as", crosswalk(F.col("effect"))).withColumn("akn_action", F.col("__as.action")).withColumn("akn_category", F.col("__as.category")).drop("__as").withColumn("applied", F.lower(F.trim("applied")).isin("yes", "y", "true", "applied"))
    if in_force is not None:
        first = in_force.groupBy("target", "target_provision").agg(F.min("in_force_date").alias("in_force_date"))
        out = out.join(first, ["target", "target_provision"], "left")
    return out


def grouped_results(spark: SparkSession, path: str) -> DataFrame:
    """A query result in CSV, one row per (act, amendment), grouped per act."""
    raw = spark.read.csv(path, header=True, schema="act string, amendment string, on_date date")
    return raw.groupBy("act").agg(F.sort_array(F.collect_set(F.struct("on_date", "amendment"))).alias("amendments"), F.max("on_date").alias("last_change"))


def match_register(cards: DataFrame, laws: DataFrame) -> DataFrame:
    """``(card_id, law_id, rung)``: cards by number and year, else by title and year; ambiguous matches are refused."""
    by_number = laws.groupBy("number", "year").agg(F.min("id").alias("n_id"), F.count_distinct("id").alias("n_k")).where("number IS NOT NULL AND n_k = 1")
    by_title = laws.groupBy(F.lower("title").alias("t"), "year").agg(F.min("id").alias("t_id"), F.count_distinct("id").alias("t_k")).where("t_k = 1")
    j = cards.join(by_number, ["number", "year"], "left").withColumn("t", F.lower("title")).join(by_title, ["t", "year"], "left")
    return j.select("card_id", F.coalesce("n_id", "t_id").alias("law_id"), F.when(F.col("n_id").isNotNull(), "number").when(F.col("t_id").isNotNull(), "title").alias("rung"))
