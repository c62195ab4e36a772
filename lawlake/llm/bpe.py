"""Encoding of a corpus with a public byte-level BPE: speculate and verify.

A word's tokens are proposed by greedy longest match. A sequence of tokens is the one BPE gives exactly if
every two neighbours are compatible, that is, if no merge across their border comes before the merges that
made them. All neighbouring pairs of all new words of a batch are tested together in arrays; only words
with a failing pair are merged exactly. Words are kept with their ids for the life of the worker.

The vocabulary is read from a file whose path is a parameter (by default that of the installed package of
public tokenizers); every worker loads it once.

Defined results: null and empty texts have no ids (an empty list); strings of special tokens in a text are
ordinary text; lone surrogates cannot occur in UTF-8 columns; a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the word pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEEP_WORDS, KEEP_CHARS = 400_000, 48
_INF = np.int64(1) << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Encoder:
    """One vocabulary with its merges, the pair test and the memory of words."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        to_byte = _byte_alphabet()
        spelt = {t: bytes(to_byte[c] for c in t) for t in model["vocab"] if all(c in to_byte for c in t)}
        self.ids = {spelt[t]: i for t, i in model["vocab"].items() if t in spelt}
        n = max(model["vocab"].values()) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)  # when a merge makes the token; -1: a single byte
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merges[x, y] = rank, z
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, rank
        keys = np.array([x * n + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.n, self.keys = n, keys[order]
        self.ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        lengths: dict[int, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[0], set()).add(len(t))
        self.lengths = {b: sorted(v, reverse=True) for b, v in lengths.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.exact_merges = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        out, i, n, ids = [], 0, len(word), self.ids
        while i < n:
            for size in self.lengths[word[i]]:
                if (t := ids.get(word[i : i + size])) is not None and i + size <= n:
                    out.append(t)
                    i += size
                    break
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _INF)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each two tokens can stand side by side in an encoding.

        Both are unmade step by step, the later merge first; a merge across the border that comes before
        the step last unmade would have prevented it (of equal merges the one further left comes first).
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), _INF)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossing = self._rank(x, y) < limit[live]
            good[live[crossing]] = False
            mx, my = self.made[x], self.made[y]
            stuck = (mx < 0) & (my < 0)
            unmake_left = mx > my
            go = ~crossing & ~stuck
            l, r = live[go & unmake_left], live[go & ~unmake_left]
            limit[l], limit[r] = self.made[a[l]], self.made[b[r]] + 1
            a[l], b[r] = self.right[a[l]], self.left[b[r]]
            live = live[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost of equals; n log n."""
        self.exact_merges += 1
        part = [self.single[b] for b in word]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := self.merges.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j] = self.merges[x, y][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((part[i], part[after[i]])):
                    heapq.heappush(heap, (m[0], i, part[i], part[after[i]]))
            if before[i] >= 0 and (m := self.merges.get((part[before[i]], part[i]))):
                heapq.heappush(heap, (m[0], before[i], part[before[i]], part[i]))
        return [t for t in part if t >= 0]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: proposals of all words, one test of all their pairs, exact merging of the rest."""
        raw = [w.encode() for w in words]
        said = [self.propose(r) for r in raw]
        sizes = np.array([len(s) for s in said])
        flat = np.fromiter(chain.from_iterable(said), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1][ends[:-1] < len(flat)] - 1] = False  # borders between words
        at = np.flatnonzero(inner)
        if len(at):
            pair = flat[at] * self.n + flat[at + 1]
            distinct, where = np.unique(pair, return_inverse=True)
            good = self.compatible(distinct // self.n, distinct % self.n)[where]
            for k in np.unique(np.searchsorted(ends, at[~good], side="right")):
                said[k] = self.merge(raw[k])
        return [tuple(s) for s in said]

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The memory, with all of ``words`` in it."""
        memory = self.words
        if new := [w for w in set(words) if w not in memory]:
            if len(memory) > KEEP_WORDS:
                memory = self.words = {}
                new = list(set(words))
            memory.update(zip(new, self.encode_words(new)))
        return memory


_SPLIT = regex.compile(PATTERN)
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Words of the texts, a few million characters at a time."""
    block, size = [], 0
    for t in texts:
        block.append(_SPLIT.findall(t) if t else [])
        size += len(t or "")
        if size > 2_000_000:
            yield block
            block, size = [], 0
    if block:
        yield block


def _forget_long(enc: Encoder, seen: set[str]) -> None:
    for w in seen:
        if len(w) > KEEP_CHARS:
            enc.words.pop(w, None)


def encode_batch(enc: Encoder, texts: list[str | None]) -> pa.ListArray:
    """The ids of each text, as an Arrow list."""
    flats, sizes = [], []
    for block in _blocks(texts):
        seen = set(chain.from_iterable(block))
        memory = enc.learn(seen)
        for words in block:
            ids = list(chain.from_iterable(map(memory.__getitem__, words)))
            flats.append(np.array(ids, np.int32))
            sizes.append(len(ids))
        _forget_long(enc, seen)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats) if flats else np.array([], np.int32)))


def count_batch(enc: Encoder, texts: list[str | None]) -> list[int]:
    """The number of ids of each text."""
    out = []
    for block in _blocks(texts):
        seen = set(chain.from_iterable(block))
        memory = enc.learn(seen)
        out += [sum(map(len, map(memory.__getitem__, words))) for words in block]
        _forget_long(enc, seen)
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_batch(enc, batch.column(1).to_pylist())], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; null for null text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [None if t is None else n for t, n in zip(texts, count_batch(enc, texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens int")
