from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lawlake.llm import packing as p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 15), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_closest_fill_against_all_subsets(stock, room):
    lengths, counts = [n for n, _ in stock], [c for _, c in stock]
    used = p.closest_fill(lengths, counts, room)
    assert all(0 <= u <= c for u, c in zip(used, counts))
    items = [n for n, c in stock for _ in range(c)]
    best = max(sum(s) for k in range(len(items) + 1) for s in combinations(items, k) if sum(s) <= room)
    assert sum(u * n for u, n in zip(used, lengths)) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200))
def test_window_is_valid_and_tight(sizes):
    sizes = np.array(sizes, np.int64)
    where = p.pack_window(sizes, 100)
    used = np.bincount(where, sizes) if len(sizes) else np.array([])
    assert (used <= 100).all()
    if sizes.sum():
        assert len(used) <= 2 * -(-sizes.sum() // 100)


def check(rows, items, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.n_tokens))
    assert max(used.values()) <= capacity
    for doc, n in items.items():
        got = sorted(pieces[doc])
        assert sum(x[2] for x in got) == n and [x[0] for x in got] == list(range(1, len(got) + 1))
        assert len(got) == max(1, -(-n // capacity))  # divided only above the capacity
        assert [x[1] for x in got] == [capacity * i for i in range(len(got))]
    return used


def test_rows_hot_lengths_and_oversize(spark):
    items = {i: [7, 33, 50, 50, 50, 120, 305, 0][i % 8] for i in range(3000)}
    df = spark.createDataFrame([(k, v, "x") for k, v in items.items()] + [(99_999, None, "x")], "doc_id bigint, n_tokens int, w string")
    rows = p.pack(df, 100, window=500).collect()
    used = check(rows, items, 100)
    assert 99_999 not in {r.doc_id for r in rows}
    assert 1 - sum(used.values()) / (100 * len(used)) < 0.06
    report = p.fill_report(p.pack(df, 100, 500), 100).head()
    assert report.n_tokens == sum(items.values()) and report.fullest <= 100


def test_empty(spark):
    assert p.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0
    assert p.pack(spark.createDataFrame([(1, None)], "doc_id bigint, n_tokens int")).count() == 0
