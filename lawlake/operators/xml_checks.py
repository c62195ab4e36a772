"""Checks of documents on what the node table leaves out: prose of the body, terms, enacting formulas, and the skeleton that translations keep.

Each XML is parsed once into a tree in Arrow batches. Elements and attributes go by local names.

Defined results: what isn't well-formed has no findings and fails; null and blank documents aren't run (null outcome).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake.functions import texts

# Units of law, elements whose content belongs to another text, wrappers without a number, and limits of the body's characters.
PROVISIONS = frozenset(
    "title subtitle book tome part chapter subchapter division subdivision subpart section subsection rule subrule article paragraph alinea subparagraph clause subclause proviso "
    "point indent item hcontainer blockContainer blockList level".split()
)
QUOTES = frozenset({"mod", "quotedStructure", "embeddedStructure"})
BORROWED = QUOTES | {"meta"}
WRAPPERS = frozenset({"hcontainer", "blockContainer", "blockList"})
PRESENTATION = frozenset({"TAB", "FGR", "SFR", "IMG", "group"})
EMPTY_BODY, REFERRING_BODY = 200, 1_000
# As in the reference, a formula in any language but these is expected in Latin letters.
SCRIPTS = {"ara": r"[؀-ۿ]", "heb": r"[֐-׿]"}
FOUND = "version_id string, failed boolean, found array<struct<check_name:string,severity:string,eid:string>>"


def tree(xml: str) -> ET.Element | None:
    """The document under local names; None if it isn't well-formed."""
    made, parser = ET.TreeBuilder(), expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attrs: made.start(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attrs.items()})
    parser.EndElementHandler = lambda name: made.end(name.rpartition(":")[2])
    parser.CharacterDataHandler = made.data
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        return None
    return made.close()


def walk(root: ET.Element) -> Iterator[tuple[ET.Element, str | None, bool, bool]]:
    """Elements in document order with the nearest id above, and whether they stand in borrowed content or an attachment."""
    todo = [(root, None, False, False)]
    while todo:
        el, above, borrowed, annexed = todo.pop()
        yield el, above, borrowed, annexed
        todo += [(c, el.get("eId") or above, borrowed or el.tag in BORROWED, annexed or el.tag == "attachment") for c in reversed(el)]


def generic(tag: str, name: str | None) -> bool:
    return tag in WRAPPERS and (name is None or name == tag or name in PRESENTATION)


def _length(el: ET.Element) -> int:
    """Characters of a unit's text, whitespace collapsed, without footnotes set below it."""
    parts: list[str] = []
    todo: list[ET.Element | str] = [el]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        parts.append(x.text or "")
        for c in reversed(x):
            todo.append(c.tail or "")
            if not (c.tag == "authorialNote" and c.get("placement") == "bottom"):
                todo.append(c)
    return len(" ".join("".join(parts).split()))


def _own(el: ET.Element) -> tuple[int, int]:
    """Provisions of a body and characters of its prose, both without quoted amendments."""
    rows = list(walk(el))
    units = sum(x.tag in PROVISIONS and x.tag not in ("item", "indent") and not borrowed and not generic(x.tag, x.get("name")) for x, _, borrowed, _ in rows)
    return units, _length(el) - sum(_length(x) for x, _, borrowed, _ in rows if x.tag in QUOTES and not borrowed)


def findings(root: ET.Element) -> list[dict]:
    """The defects of one document as (check_name, severity, eid)."""
    out: list[dict] = []
    say = lambda check, severity, eid=None: out.append({"check_name": check, "severity": severity, "eid": eid or None})
    rows = list(walk(root))
    body = next((el for tag in ("body", "mainBody", "judgmentBody") for el, _, _, annexed in rows if el.tag == tag and not annexed), None)
    units, chars = _own(body) if body is not None else (0, 0)
    if not units and chars <= EMPTY_BODY and not any(n or c > EMPTY_BODY for n, c in (_own(el) for el, *_ in rows if el.tag == "attachment")):
        say("empty_body", "error")
    terms = {f"#{el.get('eId')}" for el, *_ in rows if el.tag == "TLCTerm" and el.get("eId")}
    language = next((el.get("language") or "" for el, *_ in rows if el.tag == "FRBRlanguage"), "")
    for el, above, _, _ in rows:
        if el.tag == "term" and el.get("refersTo", "") not in terms:
            say("definition_completeness", "warning")
        elif el.tag == "formula" and el.get("name") == "enactingFormula" and language:
            said = " ".join("".join(el.itertext()).split())
            total = sum(len(re.findall(x, said)) for x in (*SCRIPTS.values(), "[A-Za-z]"))
            if total > 10 and len(re.findall(SCRIPTS.get(language, "[A-Za-z]"), said)) < total / 2:
                say("formula_script_mismatch", "error", el.get("eId"))
        elif el.tag == "p" and "(" in (said := "".join(el.itertext())):
            for _ in texts.money_mismatches(said):
                say("money_words_mismatch", "warning", el.get("eId") or above)
    return out


def checked(versions: DataFrame, id_col: str = "id", xml_col: str = "akn_xml") -> DataFrame:
    """``(version_id, failed, found)``: per version whether its XML fails to parse (null: there is none), and the defects found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("check_name", pa.string()), ("severity", pa.string()), ("eid", pa.string())]))
        for batch in batches:
            made = [(None, False) if x is None or not x.strip() else (tree(x), True) for x in batch.column(1).to_pylist()]
            failed = [root is None if there else None for root, there in made]
            found = [findings(root) if root is not None else [] for root, _ in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed, pa.bool_()), pa.array(found, kind)], ["version_id", "failed", "found"])

    return versions.select(F.col(id_col).alias("version_id"), xml_col).mapInArrow(run, FOUND)


def found(checked_versions: DataFrame) -> DataFrame:
    """``(version_id, check_name, severity, eid)``: one row per defect."""
    return checked_versions.select("version_id", F.inline("found"))


def verdicts(checked_versions: DataFrame) -> DataFrame:
    """``(version_id, check_name, failed)``: whether the XML parses, as ``documents.parse_verdicts``."""
    return checked_versions.select("version_id", F.lit("akn_parseable").alias("check_name"), "failed")


def skeleton(root: ET.Element) -> tuple[list[str], list[str]]:
    """The units of a document in order, each with its nearest enclosing one that isn't a wrapper, and the ids of its sections and articles."""
    rows = [(el, above) for el, above, borrowed, _ in walk(root) if el.get("eId") and el.tag not in ("p", "content", "listIntroduction") and not borrowed]
    at = {el.get("eId"): (el.get("name") or el.tag, generic(el.tag, el.get("name")), above) for el, above in rows}

    def parent(eid: str | None) -> str:
        seen: set[str] = set()
        while eid in at and eid not in seen:
            seen.add(eid)
            name, wrapper, eid = at[eid]
            if not wrapper:
                return name
        return ""

    units = [f"{parent(above)}/{el.get('name') or el.tag}" for el, above in rows if el.tag in PROVISIONS and not generic(el.tag, el.get("name"))]
    folded = ("".join(str(unicodedata.decimal(c, c)) for c in el.get("eId")) for el, _ in rows if el.tag in ("section", "article"))
    return units, sorted(set(folded))


def lost(units: list[str] | None, ids: list[str] | None, their_units: list[str] | None, their_ids: list[str] | None) -> bool | None:
    """Whether a translation lacks units of its source (it may divide them); null if the source has none or either isn't readable."""
    if not units or their_units is None:
        return None
    if set(ids or ()) - set(their_ids or ()):
        return True
    return units != their_units and any(op in ("delete", "replace") for op, *_ in SequenceMatcher(a=units, b=their_units, autojunk=False).get_opcodes())


def translations_preserved(versions: DataFrame) -> DataFrame:
    """``(version_id, check_name, failed)``: whether a version's translations (derived from it, in another language) keep its units.

    Null where there is no translation, or none fails and one isn't readable.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = pa.list_(pa.string()), ["version_id", "units", "ids"]
        for batch in batches:
            roots = [tree(x) if x is not None else None for x in batch.column(1).to_pylist()]
            made = [skeleton(r) if r is not None else (None, None) for r in roots]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], names), pa.array([m[1] for m in made], names)], kind)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [lost(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.bool_())], ["version_id", "gone"])

    v = versions.select(F.col("id").alias("version_id"), "parent_version_id", "language")
    source = v.select(F.col("version_id").alias("parent_version_id"), F.col("language").alias("of"))
    pairs = v.join(source, "parent_version_id").where("language <> of").select("version_id", "parent_version_id")
    made = versions.select(F.col("id").alias("version_id"), "akn_xml").mapInArrow(shapes, "version_id string, units array<string>, ids array<string>")
    theirs = pairs.join(made, "version_id").select(F.col("parent_version_id").alias("version_id"), F.col("units").alias("their_units"), F.col("ids").alias("their_ids"))
    both = made.join(theirs, "version_id").select("version_id", "units", "ids", "their_units", "their_ids").mapInArrow(compare, "version_id string, gone boolean")
    per = both.groupBy("version_id").agg(F.when(F.bool_or("gone"), True).when(F.count_if(F.col("gone").isNull()) == 0, False).alias("failed"))
    return v.select("version_id").join(per, "version_id", "left").select("version_id", F.lit("translation_structure_preserved").alias("check_name"), "failed")
