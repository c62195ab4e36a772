"""Filling containers of fixed capacity with items, none divided unless it exceeds the capacity.

Items are spread by a hash of their id over windows of about ``WINDOW`` items each, so no window depends on
a hot source, language or length, and a window holds sizes only, never texts. In a window every container
takes the largest remaining item and then the multiset of remaining lengths that fills the rest closest:
a bitset of reachable sums (one shift-or per power of two of a length's count) finds the sum, walking the
bitsets backwards gives the counts. A pattern is repeated for as many containers as the remaining counts
allow. The search first takes a spread of the remaining lengths; if that leaves a gap, all of them.

Unused space is at most that of the last container of each window plus the sums that no subset reaches.

Defined results: a null text is no item; an empty text is an item of size 0 and goes into the first
container of its window; an item above the capacity is cut into pieces of the capacity and a rest, which
is packed like an item; equal sizes are taken by id, then piece.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake import session
from lawlake.llm import bpe

CAPACITY = 4096
WINDOW = 20_000
SPREAD = 48


def closest_fill(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each length sum up closest to ``room`` from below (bounded subset sum, backtracked)."""
    mask = (1 << room + 1) - 1
    reach, before = 1, []
    for i, (size, count) in enumerate(zip(lengths, counts)):
        left, step = min(count, room // size), 1
        while left:
            take = min(step, left)
            before.append((i, take, reach))
            reach |= reach << size * take & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, [0] * len(lengths)
    for i, take, had in reversed(before):
        if not had >> total & 1:
            used[i] += take
            total -= lengths[i] * take
    return used


def pack_window(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item (sizes from 0 to ``capacity``)."""
    order = np.argsort(sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    lengths, starts, counts = np.unique(sizes[order], return_index=True, return_counts=True)
    stock = {int(n): order[a : a + c].tolist()[::-1] for n, a, c in zip(lengths, starts, counts) if n}
    left = sorted(stock)
    container = 0
    while left:
        largest = left[-1]
        room = capacity - largest
        own = {n: len(stock[n]) - (n == largest) for n in left if n <= room}
        fitting = [n for n in own if own[n]]
        plan: dict[int, int] = {}
        if fitting:
            picks = fitting if len(fitting) <= SPREAD else [fitting[i] for i in np.linspace(0, len(fitting) - 1, SPREAD).astype(int)]
            for lens in (picks, fitting):
                used = closest_fill(lens[::-1], [own[n] for n in lens[::-1]], room)
                plan = {n: u for n, u in zip(lens[::-1], used) if u}
                if len(lens) == len(fitting) or sum(n * u for n, u in plan.items()) == room:
                    break
        plan[largest] = plan.get(largest, 0) + 1
        for _ in range(min(len(stock[n]) // u for n, u in plan.items())):
            for n, u in plan.items():
                for _ in range(u):
                    out[stock[n].pop()] = container
            container += 1
        left = [n for n in left if stock[n]]
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """``(container, doc_id, piece_no, start, n_tokens)`` from items ``(doc_id, n_tokens)``.

    ``container`` is ``window-number``; ``start`` the token at which a piece begins in its text.
    """
    spark = items.sparkSession
    sizes = session.shared_dir(spark, "sizes")
    items.where("n_tokens IS NOT NULL").write.parquet(sizes)  # tokenized once, counted and packed from here
    items = spark.read.parquet(sizes)
    windows = max(1, -(-items.count() // window))
    pieces = F.when(
        F.col("n_tokens") > capacity,
        F.transform(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")), lambda i: F.struct((i + 1).alias("piece_no"), (i * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - i * capacity).alias("n"))),
    ).otherwise(F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start"), F.col("n_tokens").alias("n"))))
    cut = items.select(F.pmod(F.xxhash64("doc_id"), F.lit(windows)).alias("w"), "doc_id", F.explode(pieces).alias("p")).select("w", "doc_id", "p.piece_no", "p.start", F.col("p.n").alias("n_tokens"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], kind="stable")
        numbers = pack_window(frame["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"container": [f"{w}-{c}" for w, c in zip(frame["w"], numbers)], "doc_id": frame["doc_id"], "piece_no": frame["piece_no"], "start": frame["start"], "n_tokens": frame["n_tokens"]})

    kind = items.schema["doc_id"].dataType.simpleString()
    # a window takes seconds and few bytes, so their number, not their size, says how many tasks there are
    return cut.repartition(windows, "w").groupBy("w").applyInPandas(fill, f"container string, doc_id {kind}, piece_no int, start int, n_tokens int")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of space left unused."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    total = per.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return total.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * capacity))


def document_items(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return bpe.token_counts(docs, vocabulary=vocabulary)

