"""Structure of plain texts: anchors, coverage, windows, verbatim structuring, segmentation.

Anchors are found by one scan per text in Arrow batches: keyword headings (Section 7 - Title), bare
numbers on their own line, bracketed enumerators, with references and contents lines filtered, a stack giving depth and
ids, and numbering gaps declared, never repaired.

Defined results: null and blank texts have no anchors and no coverage; a marker that breaks the order
is kept and declared; windows cover the text without gaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Heading keywords by kind, in the languages of the tables.
KEYWORDS = {
    "part": "Part|Teil|Partie|Parte", "chapter": "Chapter|Kapitel|Chapitre|Capítulo", "section": "Section|Abschnitt|Sección|§", "article": "Article|Artikel|Artículo|Art\\.",
    "attachment": "Schedule|Annex|Anhang|Annexe|Anexo",
}
RANK = {"part": 1, "chapter": 2, "section": 3, "article": 3, "numbered": 3, "attachment": 1, "paragraph": 4, "point": 5}
PREFIX = {"part": "part", "chapter": "chp", "section": "sec", "article": "art", "numbered": "sec", "attachment": "att", "paragraph": "para", "point": "point"}
_HEAD = re.compile("|".join(f"(?P<{k}>^[ \\t]*(?:{v})[ \\t]*(?P<n_{k}>\\d+[a-z]?|[IVXLC]+)\\b)" for k, v in KEYWORDS.items()) + r"|(?P<numbered>^[ \t]*(?P<n_numbered>\d{1,4})\.[ \t]*$)|(?P<paragraph>^[ \t]*\((?P<n_paragraph>\d{1,3})\))|(?P<point>^[ \t]*\((?P<n_point>[a-z])\))", re.M)
ANCHOR = "kind string, num string, pos int, depth int, eid string, parent_eid string, heading string"


def scan(text: str | None) -> list[dict]:
    """The anchors of a text in order."""
    out: list[dict] = []
    stack: list[dict] = []
    for m in _HEAD.finditer(text or ""):
        kind = m.lastgroup if m.lastgroup in RANK else next(k for k in RANK if m.groupdict().get(k))
        num = m[f"n_{kind}"]
        line_end = text.find("\n", m.end())
        rest = text[m.end() : line_end if line_end >= 0 else len(text)].strip()
        if kind in KEYWORDS and rest and not re.match(r"^[-–—:.]", rest):
            continue  # a reference in running text
        if re.search(r"\.{4,}\s*\d+$", rest):
            continue  # a line of a table of contents
        while stack and RANK[stack[-1]["kind"]] >= RANK[kind]:
            stack.pop()
        parent = stack[-1]["eid"] if stack else None
        eid = f"{parent}__{PREFIX[kind]}_{num}" if parent else f"{PREFIX[kind]}_{num}"
        heading = rest.lstrip("-–—:. ") if kind in KEYWORDS else None
        row = {"kind": kind, "num": num, "pos": m.start(), "depth": len(stack) + 1, "eid": eid, "parent_eid": parent, "heading": heading or None}
        out.append(row)
        stack.append(row)
    seen: dict[str, int] = {}
    for row in out:
        n = seen[row["eid"]] = seen.get(row["eid"], 0) + 1
        if n > 1:
            row["eid"] += f"_{n}"
    return out


def anchors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, anchors)`` of every text."""
    names = [c.strip().split()[0] for c in ANCHOR.split(",")]
    kind = pa.list_(pa.struct([(n, pa.int32() if n in ("pos", "depth") else pa.string()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scan(t) for t in batch.column(1).to_pylist()], kind)], [id_col, "anchors"])

    ident = docs.schema[id_col].dataType.simpleString()
    inner = ",".join(c.strip().replace(" ", ":") for c in ANCHOR.split(","))
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {ident}, anchors array<struct<{inner}>>")


def census(anchored: DataFrame) -> DataFrame:
    """``(kind, n, documents)`` over all anchors."""
    flat = anchored.select(F.explode("anchors.kind").alias("kind"), F.monotonically_increasing_id().alias("row"))
    return anchored.select(F.explode(F.array_distinct("anchors.kind")).alias("kind")).groupBy("kind").agg(F.count("*").alias("documents")).join(flat.groupBy("kind").agg(F.count("*").alias("n")), "kind")


def windows(anchored: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int = 6000, overlap: int = 400) -> DataFrame:
    """``(id, window_no, start, stop)``: windows of at most ``size`` characters, begun at the anchor within the overlap before them, if there is one."""
    length, i, at = F.col("__n"), F.col("__i"), "__at"
    joined = anchored.select(id_col, F.transform("anchors", lambda a: a["pos"]).alias(at)).join(docs.select(id_col, F.length(text_col).alias("__n")), id_col).where(length > 0)
    last = F.ceil(F.greatest(length - overlap, F.lit(1)) / (size - overlap)).cast("int") - 1
    w = joined.select(id_col, "__n", at, F.explode(F.sequence(F.lit(0), last)).alias("__i"))
    begin = i * (size - overlap)
    # the next window begins before this one's end even so; the last one isn't moved off the end of the text
    near = F.array_max(F.filter(at, lambda p: (p <= begin) & (p > begin - overlap)))
    start = F.when((i < last) | (near + size >= length), near)
    placed = w.withColumn("__start", F.coalesce(start, begin).cast("int"))
    return placed.select(id_col, (i + 1).alias("window_no"), F.col("__start").alias("start"), F.least(F.col("__start") + size, length).cast("int").alias("stop"))


def verbatim(text: str | None) -> str:
    """The no-model structuring of a text: each anchor's own words under its heading, indented by depth."""
    found = scan(text)
    if not found:
        return (text or "").strip()
    out = [text[: found[0]["pos"]].strip()] if text[: found[0]["pos"]].strip() else []
    for a, b in zip(found, [*found[1:], {"pos": len(text)}]):
        body = text[a["pos"] : b["pos"]].strip().split("\n", 1)
        label = f"{a['kind'].upper()} {a['num']}" + (f" - {a['heading']}" if a["heading"] else "")
        said = body[1].strip() if len(body) > 1 else re.sub(r"^\s*(\(\w+\)|\d+\.)\s*", "", body[0]) if a["kind"] in ("paragraph", "point") else ""
        out.append("  " * (a["depth"] - 1) + label + (f"\n{'  ' * a['depth']}{' '.join(said.split())}" if said else ""))
    return "\n".join(out)


_ACT = re.compile(r"^[^\n]*\b(?:Act|Order|Regulations|Decree|Gesetz|Verordnung|Loi|Arrêté|Ley|Orden)\b[^\n]{0,80}$", re.M)


def segment(text: str | None) -> list[tuple[int, int, str]]:
    """(start, stop, title) of the acts in a volume: a title line followed by a first unit begins one."""
    starts = [m for m in _ACT.finditer(text or "") if re.match(r"\s*\n(?:.*\n){0,3}?\s*(?:Section|Article|Artikel|Abschnitt|§)?\s*1\b", text[m.end() :])]
    return [(m.start(), n, m[0].strip()) for m, n in zip(starts, [*[x.start() for x in starts[1:]], len(text or "")])]


def segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, segment_no, start, stop, title)`` of every volume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, s in enumerate(segment(t), 1)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string())], [id_col, "segment_no", "start", "stop", "title"])

    ident = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {ident}, segment_no int, start int, stop int, title string")


def goods_codes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, code, partial)``: tariff codes named in texts, digits only: two groups or more after the heading, or a heading so named (partial)."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?<![0-9.,/])((?:\d{4})(?:[. ]\d{2}){2,3}|(?<=[Hh]eading |[Tt]ariff |[Cc]ode )\d{4}(?:\.\d{2})?)(?![0-9]|[.,][0-9])"), F.lit(1))
    codes = docs.select(id_col, F.explode(F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"[. ]", "")))).alias("code"))
    return codes.withColumn("partial", F.length("code") < 8)
