"""Extension points: parsers, adapters, lenses and models are plain callables kept by name.

A lens is a function from a DataFrame of units to findings ``(unit_id, severity, payload...)``; a model is a
function from an iterator of pandas frames to frames, run by ``mapInPandas``. Nothing here calls a service.

Defined results: an unknown name raises KeyError; registering a name again replaces it; findings that were
decided before carry their decision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from lawlake.operators.versioned import carry_forward

PARSERS: dict[str, Callable[[str], Iterable[dict]]] = {}
ADAPTERS: dict[str, Callable] = {}
LENSES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(kind: dict[str, Callable], name: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        kind[name] = f
        return f

    return add


def run_lens(name: str, units: DataFrame, decided: DataFrame | None = None, keys: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """The findings of a lens, with the last decision (columns *keys, at, decision) on the same keys."""
    found = LENSES[name](units)
    return carry_forward(decided, found, list(keys), "at", "decision") if decided is not None else found


def parse_all(docs: DataFrame, parser: str, id_col: str, text_col: str, schema: str) -> DataFrame:
    """Rows of a registered parser over every document; ``schema`` is that of its rows without the id."""
    f = PARSERS[parser]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = [{id_col: key, **row} for key, text in zip(frame[id_col], frame[text_col]) if text is not None for row in f(text)]
            if rows:
                yield pd.DataFrame(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {schema}")


def run_model(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An injected model over Arrow batches."""
    return rows.mapInPandas(lambda frames: (model(f) for f in frames), schema)
