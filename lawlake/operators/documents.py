"""Structured documents as a node table, its checks, its tables, and rebuilding documents from rows.

Each XML is parsed once by a stream parser in Arrow batches; everything after is relational over nodes
``(version_id, pos, parent_pos, depth, tag, eid, wid, num, heading, text, href, quoted)``.

Defined results: what isn't well-formed has no nodes and fails ``akn_parseable``; a null document isn't
run (null outcome); nodes inside quoted amendments are marked and left out of numbering checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawlake.functions import eids

# Provisions, containers and the parents each tag may stand under.
UNITS = ("part", "book", "title", "chapter", "section", "article", "subsection", "paragraph", "subparagraph", "point", "hcontainer")
CONTAINERS = ("part", "book", "title", "chapter")
NODES = "version_id string, pos int, parent_pos int, depth int, tag string, eid string, wid string, num string, heading string, text string, href string, quoted boolean, rows int, columns int"
_KEPT = frozenset(UNITS) | {"table", "tr", "td", "th", "ref", "attachment", "quotedStructure"}


def _span(said: str | None) -> int:
    return int(said) if said and said.isascii() and said.isdigit() and 0 < int(said) <= 1000 else 1


def parse_nodes(xml: str | None) -> list[dict] | None:
    """The nodes of a document in order; None if it isn't well-formed."""
    if xml is None:
        return None
    rows: list[dict] = []
    stack: list[dict | None] = []
    tags: list[str] = []
    texts: list[str] = []

    def start(name: str, attrs: dict) -> None:
        tag = name.rpartition(":")[2]
        tags.append(tag)
        if tag not in _KEPT:
            return
        flush()
        holder = next((r for r in reversed(stack) if r), None)
        get = lambda key: next((v for k, v in attrs.items() if k.rpartition(":")[2] == key), None)
        row = {
            "pos": len(rows) + 1, "parent_pos": holder["pos"] if holder else 0, "depth": holder["depth"] + 1 if holder else 1, "tag": tag, "eid": get("eId"), "wid": get("wId") or get("eId"),
            "num": None, "heading": None, "text": "", "href": get("href"), "quoted": "quotedStructure" in tags[:-1] or "meta" in tags,
            "rows": _span(get("rowspan")), "columns": _span(get("colspan")),
        }
        rows.append(row)
        stack.append(row)

    def flush() -> None:
        said = " ".join("".join(texts).split())
        texts.clear()
        if not said:
            return
        row = next((r for r in reversed(stack) if r), None)
        if row is not None:
            inner = tags[::-1]
            field = next((t for t in inner if t in ("num", "heading") or t == row["tag"]), "text")
            field = field if field in ("num", "heading") else "text"
            row[field] = f"{row[field]} {said}".strip() if row[field] else said

    def end(name: str) -> None:
        tag = name.rpartition(":")[2]
        if tag in _KEPT or tag in ("num", "heading", "p"):
            flush()
        tags.pop()
        if tag in _KEPT:
            row = stack.pop()
            if tag == "ref" and stack and (holder := next((r for r in reversed(stack) if r), None)) is not None and row and row["text"]:
                holder["text"] = f"{holder['text']} {row['text']}".strip()

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, texts.append
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        return None
    return rows


def nodes(versions: DataFrame, id_col: str = "id", xml_col: str = "akn_xml") -> DataFrame:
    names = [c.strip().split()[0] for c in NODES.split(",")]
    kinds = {"pos": pa.int32(), "parent_pos": pa.int32(), "depth": pa.int32(), "quoted": pa.bool_(), "rows": pa.int32(), "columns": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for vid, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in parse_nodes(xml) or ():
                    cols["version_id"].append(vid)
                    for n in names[1:]:
                        cols[n].append(row[n])
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], kinds.get(n, pa.string())) for n in names], names)

    return versions.select(id_col, xml_col).where(F.col(xml_col).isNotNull()).mapInArrow(run, NODES)


def parse_verdicts(versions: DataFrame, id_col: str = "id", xml_col: str = "akn_xml") -> DataFrame:
    """``(version_id, check_name, failed)``: whether the XML parses; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [None if x is None or not x.strip() else parse_nodes(x) is None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad, pa.bool_())], ["version_id", "failed"])

    made = versions.select(F.col(id_col).alias("version_id"), xml_col).mapInArrow(run, "version_id string, failed boolean")
    return made.select("version_id", F.lit("akn_parseable").alias("check_name"), "failed")


def structural_scan(versions: DataFrame, id_col: str = "id", xml_col: str = "akn_xml") -> DataFrame:
    """``(version_id, check_name, failed)``: the structural checks of single documents with three outcomes."""
    own = nodes(versions, id_col, xml_col).where(F.col("tag").isin(*UNITS) & ~F.col("quoted"))
    all_ids = versions.select(F.col(id_col).alias("version_id"))
    per = own.groupBy("version_id").agg(F.count_if(F.col("tag").isin("section", "article")).alias("basic"), F.count("eid").alias("n"), F.count_distinct("eid").alias("d"))
    key = eids.sibling_key(F.col("eid"))
    w = W.partitionBy("version_id", "parent_pos", "tag").orderBy("pos")
    steps = own.withColumn("k", key).where("k IS NOT NULL").withColumn("prev", F.lag("k").over(w)).where("prev IS NOT NULL")
    broken = (F.col("k") <= F.col("prev")) | (F.col("k.dup") > 0)
    basic = F.col("tag").isin("section", "article")
    order = steps.groupBy("version_id").agg(F.max(F.when(basic, broken)).alias("basic_broken"), F.max(F.when(~basic, broken)).alias("child_broken"))
    # a document that parses and has no unit has none, which is a failure; one that doesn't parse wasn't run
    verdicts = parse_verdicts(versions, id_col, xml_col)
    parsed = verdicts.where("NOT failed").select("version_id", F.lit(0).alias("none")).dropDuplicates()
    wide = all_ids.join(per, "version_id", "left").join(order, "version_id", "left").join(parsed, "version_id", "left")
    checks = F.array(
        F.struct(F.lit("body_units_present").alias("check_name"), (F.coalesce("basic", "none") == 0).alias("failed")),
        F.struct(F.lit("eid_unique").alias("check_name"), F.when(F.col("n") > 0, F.col("n") > F.col("d")).alias("failed")),
        F.struct(F.lit("numbering_monotonic_basic_unit").alias("check_name"), F.col("basic_broken").alias("failed")),
        F.struct(F.lit("numbering_monotonic_children").alias("check_name"), F.col("child_broken").alias("failed")),
    )
    return wide.select("version_id", F.inline(checks)).unionByName(verdicts).dropDuplicates(["version_id", "check_name"])


# Patterns of texts that are no law, and parents that tags don't stand under.
MARKUP_TEXT = r"(?i)^\s*</?(p|div|span|article|section|heading|num|content)\b[^>]*>\s*$"
ARTEFACT = r'```|^\s*\{\s*"[a-z_]+"\s*:|"\s*\}\s*$'
MOJIBAKE = r"Ã[\x{80}-\x{BF}]|â€[\x{99}\x{9C}\x{9D}“”™]|\x{FFFD}"
BAD_PARENT = {"part": ["section", "article", "paragraph", "point"], "chapter": ["section", "article", "paragraph", "point"], "section": ["paragraph", "point"], "article": ["paragraph", "point"]}


def validate(all_nodes: DataFrame) -> DataFrame:
    """``(version_id, check_name, severity, eid)``: one row per defect found in a node table.

    The table is read once per check, so it should be written, not the plan that parses the XML. Defects of what it
    leaves out (prose of the body, terms, formulas, sums in words) come from ``xml_checks``.
    """
    units = all_nodes.where(F.col("tag").isin(*UNITS) & ~F.col("quoted"))
    w = W.partitionBy("version_id", "parent_pos", "tag").orderBy("pos")

    def say(rows: DataFrame, check: str, severity: str, eid: str = "eid") -> DataFrame:
        return rows.select("version_id", F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), F.col(eid).alias("eid"))

    number = F.regexp_extract(F.coalesce("num", F.lit("")), r"(\d{1,6})", 1).try_cast("int")
    numbered = units.withColumn("n", number).withColumn("prev", F.lag("n").over(w)).withColumn("first", F.row_number().over(w) == 1)
    # a unit's own words and those of everything below it
    kids = units.groupBy("version_id", F.col("parent_pos").alias("pos")).agg(F.count("*").alias("n_kids"))
    holders = units.select("version_id", F.col("pos").alias("parent_pos"), F.col("tag").alias("parent_tag"))
    with_kids = units.join(kids, ["version_id", "pos"], "left")
    bad_parent = F.lit(False)
    for tag, parents in BAD_PARENT.items():
        bad_parent |= (F.col("tag") == tag) & F.col("parent_tag").isin(*parents)
    targets = all_nodes.where(F.col("href").startswith("#")).select("version_id", "eid", F.substring("href", 2, 10_000).alias("to"))
    have = all_nodes.where("eid IS NOT NULL").select("version_id", F.col("eid").alias("to")).distinct()
    whole = units.groupBy("version_id").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("tag").isin(*CONTAINERS)).alias("n_containers"))
    dup_number = numbered.where("n IS NOT NULL").groupBy("version_id", "parent_pos", "tag", "n").agg(F.count("*").alias("c"), F.max("eid").alias("eid")).where("c > 1")
    dup_eid = units.where("eid IS NOT NULL").groupBy("version_id", "eid").agg(F.count("*").alias("c")).where("c > 1")
    text = F.col("text")
    found = [
        say(dup_number, "duplicate_number", "warning"),
        say(numbered.where("n > prev + 1"), "number_gap", "warning"),
        say(numbered.where("first AND n > 1 AND parent_pos = 0"), "leading_gap", "warning"),
        say(dup_eid, "eid_uniqueness", "error"),
        say(units.where((eids.depth(F.col("eid")) > 12) | (F.length("eid") > 255)), "eid_unusable", "error"),
        say(numbered.where(F.col("tag").isin("section", "article") & (F.col("n") - F.col("prev") > 2)), "section_numbering", "info"),
        say(units.join(holders, ["version_id", "parent_pos"]).where(bad_parent), "hierarchy_coherence", "warning"),
        say(units.where(text.rlike(MARKUP_TEXT)), "markup_as_text", "error"),
        say(units.where(text.rlike(ARTEFACT)), "body_artefact", "error"),
        say(units.where(text.rlike(MOJIBAKE)), "ocr_garble", "warning"),
        say(with_kids.where("n_kids IS NULL AND text = ''"), "empty_article", "warning"),
        say(targets.join(have, ["version_id", "to"], "left_anti"), "ref_resolution", "warning"),
        say(units.where(F.col("tag").isin(*CONTAINERS) & F.col("heading").isNull()), "missing_container_title", "warning"),
        say(units.where(F.col("tag").isin(*CONTAINERS) & (F.col("heading") == F.col("num"))), "container_heading_restates_num", "warning"),
        say(units.where(F.col("tag").isin("section", "article") & (F.col("parent_pos") == 0)).join(whole.where("n_containers > 0"), "version_id"), "orphan_articles", "warning"),
        say(whole.where("n_units = 1 AND chars > 4000").withColumn("eid", F.lit(None).cast("string")), "structureless_body", "warning"),
    ]
    found += _further(all_nodes, units, numbered, say)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _further(all_nodes: DataFrame, units: DataFrame, numbered: DataFrame, say) -> list[DataFrame]:
    """Checks that compare a unit with its neighbours, its words or the anchors of its text."""
    text, w = F.col("text"), W.partitionBy("version_id", "parent_pos").orderBy("pos")
    letters = units.withColumn("bis", eids.sibling_key(F.col("eid"))["bis"]).withColumn("n", eids.sibling_key(F.col("eid"))["n"])
    letters = letters.withColumn("pb", F.lag("bis").over(w)).withColumn("pn", F.lag("n").over(w))
    seam = units.where(F.length("text") > 200).where(F.substring(text, 81, 800).contains(F.substring(text, 1, 80)))
    steps = numbered.withColumn("next", F.lead("n").over(W.partitionBy("version_id", "parent_pos", "tag").orderBy("pos")))
    swallowed = steps.where("next > n + 1").where(text.contains(F.concat(F.lit("("), (F.col("n") + 1).cast("string"), F.lit(")"))))
    last = units.withColumn("r", F.row_number().over(W.partitionBy("version_id").orderBy(F.desc("pos")))).where("r = 1")
    headers = units.where(F.col("tag").isin("section", "article")).groupBy("version_id").agg(F.count("*").alias("k"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*((?:Section|Article|Artikel|Abschnitt|Artículo) \d+)"), F.lit(1)))).alias("h"))
    no_eid = F.lit(None).cast("string")
    return [
        say(letters.where("bis > 0 AND pn = n AND bis <= pb"), "collapsed_bis_article", "error"),
        say(seam, "seam_duplication", "warning"),
        say(swallowed, "swallowed_enumerator", "warning"),
        say(numbered.where("n <= prev"), "undetected_amendment_shape", "warning"),
        say(last.where(text.rlike(r"(?i)\b(done at|in witness whereof|geschehen zu|fait à|dado en|signed by)\b")), "displaced_terminal_material", "warning"),
        say(units.where(text.rlike(r"(…|\.\.\.)\s*$") & text.rlike(r"(?i)^(be it enacted|it is hereby|le parlement|der landtag)")), "formula_truncated", "error"),
        say(headers.where("h > k").withColumn("eid", no_eid), "header_coverage", "warning"),
        say(units.where(F.col("tag").isin("section", "article") & F.col("heading").isNull() & F.col("num").isNull()), "unit_unidentified", "info"),
        say(all_nodes.where((F.col("tag") == "ref") & (F.coalesce("href", F.lit("")) == "")), "reference_without_target", "warning"),
    ]


def document_checks(laws: DataFrame, today: str) -> DataFrame:
    """``(law_id, check_name, severity)``: identity checks of works against their URI and the calendar."""
    from lawlake.functions import uris

    p = laws.select("id", "year", "number", uris.work_parts(F.col("frbr_work_uri")).alias("p"), uris.is_citable(F.col("frbr_work_uri")).alias("citable"))
    limit = F.year(F.lit(today).cast("date"))
    checks = F.array(
        F.struct(F.lit("uncitable_work_uri").alias("check_name"), F.lit("warning").alias("severity"), (~F.col("citable")).alias("hit")),
        F.struct(F.lit("identity_future_year").alias("check_name"), F.lit("error").alias("severity"), (F.col("year") > limit).alias("hit")),
        F.struct(F.lit("identity_unconverted_year").alias("check_name"), F.lit("error").alias("severity"), F.col("year").between(2400, 2700).alias("hit")),
        F.struct(F.lit("identity_implausible_year").alias("check_name"), F.lit("error").alias("severity"), (F.col("year") < 1200).alias("hit")),
        F.struct(F.lit("identity_uri_mismatch").alias("check_name"), F.lit("error").alias("severity"), ((F.col("p.year") != F.col("year")) | (F.col("p.number") != F.col("number"))).alias("hit")),
    )
    rows = p.select(F.col("id").alias("law_id"), F.inline_outer(checks))
    return rows.where("hit").drop("hit")


def anchor_mismatch(all_nodes: DataFrame, anchored: DataFrame) -> DataFrame:
    """``(version_id, kind, nodes, anchors, severity)``: kinds of which a text has other counts of anchors than its tree of nodes (anchored: version_id, anchors)."""
    n = all_nodes.where(~F.col("quoted")).groupBy("version_id", F.col("tag").alias("kind")).agg(F.count("*").alias("nodes"))
    a = anchored.select("version_id", F.explode("anchors.kind").alias("kind")).groupBy("version_id", "kind").agg(F.count("*").alias("anchors"))
    both = a.join(n, ["version_id", "kind"], "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    return both.where("nodes <> anchors").withColumn("severity", F.when(F.col("nodes") < F.col("anchors"), "error").otherwise("warning"))


def grade(findings: DataFrame, versions: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``(version_id, grade)``: ungraded if the checks couldn't run, blocking with an error, warning with one, clean else.

    ``verdicts`` are those of ``parse_verdicts``: only a version whose XML parses there has been checked. Without
    them every version counts as checked, so a version that may lack a tree must come with them.
    """
    per = findings.groupBy("version_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    rows, checked = versions.join(per, "version_id", "left"), F.lit(True)
    if verdicts is not None:
        parsed = verdicts.where("check_name = 'akn_parseable'").groupBy("version_id").agg(F.bool_and(~F.col("failed")).alias("__parsed"))
        rows, checked = rows.join(parsed, "version_id", "left"), F.coalesce("__parsed", F.lit(False))
    worst = F.when(~checked, "ungraded").when(F.col("e") > 0, "blocking").when(F.col("w") > 0, "warning").otherwise("clean")
    return rows.select("version_id", worst.alias("grade"))


def rebuild(rows: DataFrame) -> DataFrame:
    """``(version_id, text)``: the provisions of a version as indented text in their order (rows back to a document)."""
    line = F.concat(F.repeat(F.lit("  "), eids.depth(F.col("akn_eid")) - 1), F.upper("akn_type"), F.lit(" "), F.col("akn_eid"), F.lit(" - "), F.coalesce("text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("position", "id", line.alias("line"))))
    return rows.groupBy("version_id").agg(ordered.alias("l")).select("version_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def structure_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(wid, change)`` of two node tables joined on wId: added, removed, moved or reworded."""
    x = a.select("wid", F.col("tag").alias("tag_a"), F.col("text").alias("text_a"), F.col("eid").alias("eid_a")).where("wid IS NOT NULL")
    y = b.select("wid", F.col("tag").alias("tag_b"), F.col("text").alias("text_b"), F.col("eid").alias("eid_b")).where("wid IS NOT NULL")
    both = x.join(y, "wid", "full_outer")
    change = (
        F.when(F.col("tag_a").isNull(), "added").when(F.col("tag_b").isNull(), "removed").when(F.col("eid_a") != F.col("eid_b"), "moved").when(F.col("text_a") != F.col("text_b"), "reworded")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select("wid", "change")


def resolve_grid(rows: list[list[dict]]) -> list[list[dict | None]]:
    """Cells with spans laid out on a grid: every place holds the cell that covers it."""
    grid: dict[tuple[int, int], dict] = {}
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while (r, c) in grid:
                c += 1
            for i in range(cell.get("rowspan") or 1):
                for k in range(cell.get("colspan") or 1):
                    grid.setdefault((r + i, c + k), cell)
            c += cell.get("colspan") or 1
    width = max((c for r, c in grid if r < len(rows)), default=-1) + 1
    return [[grid.get((r, c)) for c in range(width)] for r in range(len(rows))]


CELL = "row_no int, column_no int, label string, text string"


def table_rows(all_nodes: DataFrame) -> DataFrame:
    """``(version_id, table_pos, row_no, column_no, label, text)``: every place of every table's grid with the headers of its column.

    A cell that spans rows or columns stands at each place it covers; headers above one another are joined, the
    outermost first, each once. A table is laid out in one task.
    """
    rows = all_nodes.where("tag = 'tr'").select("version_id", F.col("pos").alias("row_pos"), F.col("parent_pos").alias("table_pos"))
    cells = all_nodes.where("tag IN ('td', 'th')").select("version_id", F.col("parent_pos").alias("row_pos"), "pos", "tag", "text", "rows", "columns")
    joined = cells.join(rows, ["version_id", "row_pos"])
    tables = joined.groupBy("version_id", "table_pos").agg(F.sort_array(F.collect_list(F.struct("row_pos", "pos", "tag", "text", "rows", "columns"))).alias("cells"))
    fields = [f.split() for f in CELL.split(", ")]

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = []
            for said in batch.column(2).to_pylist():
                lines: dict[int, list[dict]] = {}
                for cell in said:
                    lines.setdefault(cell["row_pos"], []).append({**cell, "rowspan": cell["rows"], "colspan": cell["columns"]})
                places, heads = [], {}
                for r, line in enumerate(resolve_grid(list(lines.values())), 1):
                    for c, cell in enumerate(line, 1):
                        if cell is not None and cell["tag"] == "th":
                            above = heads.setdefault(c, [])
                            if cell["text"] and cell["text"] not in above:
                                above.append(cell["text"])
                        elif cell is not None:
                            places.append({"row_no": r, "column_no": c, "label": " / ".join(heads[c]) if heads.get(c) else None, "text": cell["text"]})
                out.append(places)
            kind = pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(kind))], ["version_id", "table_pos", "places"])

    placed = tables.mapInArrow(lay_out, f"version_id string, table_pos int, places array<struct<{','.join(f'{n}:{t}' for n, t in fields)}>>")
    return placed.select("version_id", "table_pos", F.inline("places"))


def marked_scope(units: DataFrame, marks: DataFrame) -> DataFrame:
    """Units (version_id, akn_eid, ...) at or under a marked element (version_id, akn_eid), by their chain of ids."""
    chain = units.select("version_id", "akn_eid", F.explode(eids.ancestors(F.col("akn_eid"))).alias("__a"))
    hit = chain.join(marks.select("version_id", F.col("akn_eid").alias("__a")).distinct(), ["version_id", "__a"], "left_semi")
    return units.join(hit.select("version_id", "akn_eid").distinct(), ["version_id", "akn_eid"], "left_semi")


def paths(units: DataFrame) -> DataFrame:
    """``(version_id, akn_eid, path)``: the ids of the stored units that enclose each unit, root first, itself last."""
    chain = units.select("version_id", "akn_eid", F.posexplode(eids.ancestors(F.col("akn_eid"))).alias("d", "a"))
    stored = units.select("version_id", F.col("akn_eid").alias("a")).distinct()
    met = chain.distinct().join(stored, ["version_id", "a"]).groupBy("version_id", "akn_eid").agg(F.sort_array(F.collect_list(F.struct("d", "a"))).alias("p"))
    return met.select("version_id", "akn_eid", F.transform("p", lambda x: x["a"]).alias("path"))
