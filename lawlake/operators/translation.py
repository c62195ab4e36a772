"""Parity of translations: numeric slots, audits of paired units, seeded judging.

Numbers become sentinels before a text goes to an injected translator and come back after it, so a lost
number names itself. Audits join source and target units on their ids.

Defined results: a text without numbers is unchanged; sentinels that a translation lost are reported, never
invented; a unit that one side lacks is ``missing`` or ``added``; measures of empty texts are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake.functions import texts

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_SLOT = re.compile(r"⟨N(\d{3,})⟩")


def encode_numbers(text: str) -> tuple[str, list[str]]:
    """The text with ⟨N001⟩ in place of its numbers, and these."""
    found: list[str] = []

    def slot(m: re.Match) -> str:
        found.append(m[0])
        return f"⟨N{len(found):03d}⟩"

    return _NUMBER.sub(slot, text), found


def decode_numbers(text: str, numbers: list[str]) -> tuple[str, list[str]]:
    """The text with its sentinels replaced, and the numbers whose sentinel it lost."""
    used: set[int] = set()

    def put(m: re.Match) -> str:
        k = int(m[1])
        if not 1 <= k <= len(numbers):
            return m[0]
        used.add(k)
        return numbers[k - 1]

    return _SLOT.sub(put, text), [n for k, n in enumerate(numbers, 1) if k not in used]


def translate(units: DataFrame, id_col: str, text_col: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``(id, translated, lost)``: an injected translator over encoded texts, decoded again."""

    def run(frames):
        for f in frames:
            coded = [encode_numbers(t or "") for t in f[text_col]]
            said = model(pd.Series([c for c, _ in coded]))
            back = [decode_numbers(t, n) for t, (_, n) in zip(said, coded)]
            yield pd.DataFrame({id_col: f[id_col], "translated": [t for t, _ in back], "lost": [n for _, n in back]})

    kind = units.schema[id_col].dataType.simpleString()
    return units.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, translated string, lost array<string>")


def audit(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, check_name, severity)`` of paired units (keys, text): what a translation lost or added."""
    s = source.select(*keys, F.col("text").alias("s"), F.lit(True).alias("in_s"))
    t = target.select(*keys, F.col("text").alias("t"), F.lit(True).alias("in_t"))
    j = s.join(t, keys, "full_outer")
    both = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    full_s, full_t = F.length(F.trim(F.coalesce("s", F.lit("")))) > 0, F.length(F.trim(F.coalesce("t", F.lit("")))) > 0
    a, b = F.sort_array(texts.numeric_tokens(F.col("s"))), F.sort_array(texts.numeric_tokens(F.col("t")))
    ratio = F.length("t") / F.nullif(F.length("s"), F.lit(0))
    checks = F.array(
        F.struct(F.lit("unit_missing").alias("check_name"), F.lit("error").alias("severity"), F.col("in_t").isNull().alias("hit")),
        F.struct(F.lit("unit_added").alias("check_name"), F.lit("warning").alias("severity"), F.col("in_s").isNull().alias("hit")),
        F.struct(F.lit("text_lost").alias("check_name"), F.lit("error").alias("severity"), (both & full_s & ~full_t).alias("hit")),
        F.struct(F.lit("numbers_differ").alias("check_name"), F.lit("warning").alias("severity"), (both & full_s & full_t & (a != b)).alias("hit")),
        F.struct(F.lit("length_off").alias("check_name"), F.lit("info").alias("severity"), (both & full_s & full_t & ((ratio < 0.4) | (ratio > 2.5))).alias("hit")),
        F.struct(F.lit("not_translated").alias("check_name"), F.lit("warning").alias("severity"), (both & full_s & (F.length("s") > 40) & (F.col("s") == F.col("t"))).alias("hit")),
    )
    rows = j.select(*keys, F.inline_outer(checks))
    return rows.where("hit").drop("hit")
