"""Cutting texts above a size limit at natural boundaries, with overlap.

The size is counted in tokens of a public tokenizer. Each token of an oversized text becomes one letter for
the boundary that its end makes: p(aragraph), l(ine), s(entence), c(lause), w(ord), x (between characters
of a word) or n (inside a character, never a cut). A bounded-quantifier pattern then consumes up to the
limit, its alternatives ordered by strength, with the character as fallback:

    .{m,L-1}p | .{m,L-1}l | .{m,L-1}s | .{m,L-1}c | .{m,L-1}w | .{1,L-1}[^n] | .{1,L}

A boundary counts as natural if it leaves a piece at least a quarter full. Letters are tokens, so the bound
is exact. The first piece may take the whole limit, later ones the limit less the overlap, which is taken
back by a lookback of that many letters (moved on to the next character start where it would divide one).
Matching and slicing are SQL functions on arrays; only tokenizing runs in Python.

Defined results: null texts and texts within the limit yield no row; pieces cover the text without gaps; the
first piece has overlap 0; the text of a piece, encoded anew, has no more tokens than the limit except where
a cut inside a word or run of blanks makes the tokenizer group it otherwise, which ``n_tokens`` (counted in
the whole text) doesn't show.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawlake.llm import bpe

LIMIT, OVERLAP = 512, 32
# Characters that end sentences and clauses.
SENTENCE_ENDS = ".!?…。！？।"
CLAUSE_ENDS = ",;:、，；："
CLOSERS = "\"'”’»)]"


class Letters:
    """Letters and byte lengths of words' tokens, kept per word; only a last letter depends on what follows."""

    def __init__(self, enc: bpe.Encoder):
        self.enc, self.bytes = enc, {i: len(b) for b, i in enc.ids.items()}
        self.words: dict[str, tuple[str, str, tuple[int, ...], int]] = {}

    def of(self, word: str, ids: tuple[int, ...]) -> tuple[str, str, tuple[int, ...], int]:
        """(letters before white space or the end, letters before other text, bytes of each token, 1 unless it begins with white space)."""
        raw, sizes = word.encode(), tuple(self.bytes[t] for t in ids)
        if len(raw) == len(word):
            inner = "x" * (len(ids) - 1)
        else:
            inner = "".join("n" if raw[e] & 0xC0 == 0x80 else "x" for e in np.cumsum(sizes)[:-1])
        if word.isspace():
            # b: a line break with more white space to come, so the break may be a blank line
            lines = word.count("\n")
            spaced, tight = "b" if lines else "w", "p" if lines > 1 else "l" if lines else "w"
        else:
            body = word.rstrip(CLOSERS) or word
            spaced = "s" if body[-1] in SENTENCE_ENDS else "c" if body[-1] in CLAUSE_ENDS else "w"
            tight = "s" if word[-1] in "。！？" else "c" if word[-1] in "、，；：" else "w"
        return inner + spaced, inner + tight, sizes, 0 if word[0].isspace() else 1

    def of_words(self, words: list[str]) -> list[tuple[str, str, tuple[int, ...], int]]:
        """``of`` each word; words not met before are tokenized together."""
        got = list(map(self.words.get, words))
        if None in got:
            new = {w for w, g in zip(words, got) if g is None}
            memory = self.enc.learn(new)
            made = {w: self.of(w, memory[w]) for w in new}
            got = [g or made[w] for w, g in zip(words, got)]
            if len(self.words) > bpe.KEEP_WORDS:
                self.words = {}
            self.words.update((w, g) for w, g in made.items() if len(w) <= bpe.KEEP_CHARS)
            bpe._forget_long(self.enc, new)
        return got

    def of_text(self, words: list[str]) -> tuple[str, np.ndarray]:
        """One letter per token of a text and the byte at which each token begins (the end of the text last)."""
        got = self.of_words(words)
        parts = [g[after[3]] for g, after in zip(got, got[1:])]
        parts.append(got[-1][0])
        letters = "".join(parts).replace("bl", "wp").replace("b", "w")
        starts = np.zeros(len(letters) + 1, np.int32)
        np.cumsum(np.fromiter(chain.from_iterable(map(itemgetter(2), got)), np.int32, len(letters)), out=starts[1:])
        return letters, starts


def letters_of(docs: DataFrame, limit: int, id_col: str, text_col: str, vocabulary: str | None) -> DataFrame:
    """``(doc_id, raw, letters, starts)`` of the texts above the limit; ``raw`` is the text in UTF-8, in chunks."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Letters(bpe.encoder(path))
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or len(raw := text.encode()) <= limit:  # a token has a byte at least
                    continue
                letters, starts = spell.of_text(bpe._SPLIT.findall(text))
                if len(letters) > limit:
                    rows.append((key, raw, letters, starts))
            cols = list(zip(*rows)) or [(), (), (), ()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in cols[3]])]).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[3]) if cols[3] else np.array([], np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array([[raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)] for raw in cols[1]], pa.list_(pa.binary())), pa.array(cols[2], pa.string()), starts], ["doc_id", "raw", "letters", "starts"])

    doc = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {doc}, raw array<binary>, letters string, starts array<int>")


ENDS_AT_ONCE, CHUNK = 256, 16_384  # pieces of a text whose ends are summed in one go; bytes of a chunk of a text


def piece_pattern(limit: int, overlap: int) -> str:
    """The extraction pattern: the first piece up to the limit, later ones up to the limit less the overlap."""

    def pieces(most: int) -> str:
        least = most // 4
        natural = "|".join(f".{{{least},{most - 1}}}{kind}" for kind in "plscw")
        return f"{natural}|.{{0,{most - 1}}}[^n]|.{{1,{most}}}"

    # what is left whole comes first: it needs no boundary
    return f"^(?:.{{1,{limit}}}$|{pieces(limit)})|.{{1,{limit - overlap}}}$|{pieces(limit - overlap)}"


def split(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, piece_no, byte_start, byte_end, n_tokens, overlap_tokens, boundary, piece)`` of the oversized texts."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    lettered = letters_of(docs, limit, id_col, text_col, vocabulary)
    runs = lettered.withColumn("runs", F.regexp_extract_all("letters", F.lit(piece_pattern(limit, overlap)), F.lit(0)))
    # running sums in blocks, then of the blocks: appending to one array would copy it for every piece
    adding = lambda values, size: F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + size(x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("runs") - 1) / ENDS_AT_ONCE).cast("int")), lambda b: adding(F.slice("runs", b * ENDS_AT_ONCE + 1, ENDS_AT_ONCE), F.length))
    bases = adding(F.col("blocks"), lambda x: F.element_at(x, -1))
    moved = F.zip_with("blocks", F.slice("bases", F.lit(1), F.size("blocks")), lambda x, base: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda v: v + base))
    ends = F.concat(F.array(F.lit(0)), F.flatten(moved))

    def byte_at(token: Column) -> Column:
        return F.element_at("starts", token + 1)

    def bytes_of(start: Column, end: Column) -> Column:
        # of the chunks they are in: reading the whole text for each piece would copy it
        first = F.floor(start / CHUNK).cast("int")
        chunks = F.slice("raw", first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
        joined = F.when(F.size(chunks) == 1, F.element_at(chunks, 1)).otherwise(F.aggregate(chunks, F.lit(b""), lambda a, c: F.concat(a, c)))
        return F.substring(joined, start - first * CHUNK + 1, end - start)

    def first_token(run: Column, i: Column) -> Column:
        # the overlap begins at a character: past tokens that begin inside one
        begin, before = F.element_at("ends", i + 1), F.element_at("runs", i)
        window = F.when(F.length(before) > overlap, F.right(before, F.lit(overlap + 1))).otherwise(F.substring(F.col("letters"), F.greatest(begin - overlap, F.lit(1)), F.lit(overlap + 1)))
        back = F.greatest(begin - overlap, F.lit(0))
        return F.when(i == 0, 0).otherwise(F.least(back + F.length(F.regexp_extract(window, "^n+", 0)), begin))

    def piece(run: Column, i: Column) -> Column:
        begin, end, start = F.element_at("ends", i + 1), F.element_at("ends", i + 2), F.element_at("firsts", i + 1)
        return F.struct(
            (i + 1).alias("piece_no"), byte_at(start).alias("byte_start"), byte_at(end).alias("byte_end"),
            (end - start).alias("n_tokens"), (begin - start).alias("overlap_tokens"), F.right(run, F.lit(1)).alias("boundary"),
            bytes_of(byte_at(start), byte_at(end)).cast("string").alias("piece"),
        )

    # pieces are made inside the row, so the text isn't copied for each of them; the outer form, as for the
    # inner one the optimizer would evaluate all of it once more in a filter (no row is without pieces)
    cut = runs.withColumn("blocks", blocks).withColumn("bases", bases).withColumn("ends", ends).withColumn("firsts", F.transform("runs", first_token)).select("doc_id", F.transform("runs", piece).alias("pieces"))
    return cut.select("doc_id", F.inline_outer("pieces"))
