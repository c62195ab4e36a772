"""Classification by declared rules: document classes, eras, chapters, page regions.

Rules are small declared tables turned into one ordered CASE expression, so a scan classifies in passing.

Defined results: what no rule matches is null (unclassified, not misclassified); a rule whose signal or date
the row lacks is skipped; of equal priorities the rule declared first holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``target`` where ``pattern`` is found in the column ``signal`` (none: dates alone) within the dates."""

    target: str
    signal: str | None = None
    pattern: str | None = None
    since: str | None = None
    until: str | None = None
    priority: int = 0


def document_class(rules: list[Rule], on: str | None = None) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: r.priority):
        hit = F.lit(True)
        if rule.since or rule.until:
            if on is None:
                continue
            day = F.col(on)
            hit = hit & F.coalesce((day >= F.lit(rule.since or "0001-01-01").cast("date")) & (day <= F.lit(rule.until or "9999-12-31").cast("date")), F.lit(False))
        if rule.signal:
            hit = hit & F.coalesce(F.col(rule.signal).rlike(rule.pattern or "(?!)"), F.lit(False))
        elif not (rule.since or rule.until):
            continue
        out = F.when(hit, rule.target).otherwise(out)
    return out


def era(year: Column, eras: list[tuple[str, int | None, int | None]]) -> Column:
    """The declared era that holds a year; a transition year belongs to the earlier one."""
    if not eras:
        return F.when(year.isNull(), "unknown").otherwise("no_eras_declared")
    out = F.lit("outside_declared_eras")
    for name, first, last in reversed(eras):
        out = F.when((year >= (first if first is not None else -9999)) & (year <= (last if last is not None else 9999)), name).otherwise(out)
    return F.when(year.isNull(), "unknown").otherwise(out)


def chapter(labels: Column, priority: list[tuple[int, list[str]]]) -> Column:
    """The first chapter in priority order of which a needle is in any label."""
    lowered = F.transform(labels, F.lower)
    out = F.lit(None).cast("int")
    for number, needles in reversed(priority):
        out = F.when(_any_contains(lowered, needles), number).otherwise(out)
    return out


def _any_contains(labels: Column, needles: list[str]) -> Column:
    def found(label: Column) -> Column:
        hit = F.lit(False)
        for n in needles:
            hit = hit | label.contains(n)
        return hit

    return F.coalesce(F.exists(labels, found), F.lit(False))


def regions(blocks: DataFrame, head: float = 0.08, foot: float = 0.92) -> DataFrame:
    """Adds ``region`` to page blocks (doc_id, page_no, block_no, text, top, height): header, footer, number, footnote, body.

    A line in the head or foot band that stands on three pages or more of a document is furniture, digits aside.
    """
    plain = F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")
    b = blocks.withColumn("__p", plain).withColumn("__band", F.try_divide(F.col("top"), F.col("height")))
    edge = (F.col("__band") < head) | (F.col("__band") > foot)
    seen = b.where(edge).groupBy("doc_id", "__p").agg(F.count_distinct("page_no").alias("__pages"))
    j = b.join(seen, ["doc_id", "__p"], "left")
    repeated = edge & (F.coalesce("__pages", F.lit(0)) >= 3)
    kind = (
        F.when(F.trim("text").rlike(r"^[-–—(]?\s*\d{1,4}\s*[-–—)]?$") & edge, "number")
        .when(repeated & (F.col("__band") < head), "header")
        .when(repeated, "footer")
        .when((F.col("__band") > 0.75) & F.col("text").rlike(r"^\s*(\d{1,2}\)|\*|†|\[\d{1,2}\])\s"), "footnote")
        .otherwise("body")
    )
    return j.withColumn("region", kind).drop("__p", "__band", "__pages")


def furniture_leaks(regioned: DataFrame, body: DataFrame) -> DataFrame:
    """``(doc_id, leaks)``: furniture lines of a document that its body text (doc_id, body) still has."""
    f = regioned.where(F.col("region").isin("header", "footer")).select("doc_id", F.trim("text").alias("line")).distinct()
    j = body.join(f, "doc_id", "left")
    return j.groupBy("doc_id").agg(F.count_if(F.coalesce(F.col("body").contains(F.col("line")), F.lit(False))).alias("leaks"))


def structure_text(regioned: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the body blocks of a document in reading order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "block_no", "text")))
    return regioned.where("region = 'body'").groupBy("doc_id").agg(ordered.alias("b")).select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))

