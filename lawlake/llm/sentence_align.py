"""Pairing the sentences of documents that exist in two languages.

1. Word vectors. Skip-gram with negative sampling, trained per language on all texts. Its loss depends on
   the counts of (word, context) only, so these are summed on the executors and the model is fitted to the
   matrix of counts: no sampling, no order, the same result at any number of partitions. Contexts of a word
   are the words of its sentence and the neighbourhood of that sentence in its document (hashed into
   ``NEIGHBOURHOODS``); the latter tell words apart that fill the same place in formulaic sentences.
2. Seeds. Words of two languages that predict each other at the same relative place of paired documents.
   Each language is turned into the space of the pivot language (the one with most sentences) by the
   orthogonal Procrustes solution over its seeds.
3. Alignment of each pair of documents: sentence vectors are sums of their words' vectors, weighted by rarity
   and by how well a word is ever rendered (a translator's own remarks weigh nothing). Time warping runs on
   the vectors of merged neighbours first, then on those of ever shorter blocks within a corridor about the
   coarser path; only inside the last corridor are sentences compared word by word, and warped once more.
   A pair counts if one side's weight is rendered by the other side's words.
4. Rematching: the sentences that the path leaves unaligned, or only partly rendered, on both sides are
   compared with one another, best pairs first, which recovers what was moved.

Every word takes part: the ``VOCABULARY`` most frequent of a language have a vector of their own, the others
share ``BUCKETS`` vectors by hash and, spelt alike in both texts, count as the same name. That bounds the model,
which is broadcast, to 4 bytes x (VOCABULARY + BUCKETS) x DIMENSIONS a language, whatever the corpus. Numbers
are matched as numbers. Sentences of a pair of documents are aligned in one task, in memory linear in their
number but for what they don't share in order.

Languages are those of the bodies' codes, of any standard; a body without a code gets the language whose
words its text is likeliest made of, told from the labelled bodies.

Defined results: fetches without sentences of a primary and of a translation yield nothing; a role delivered
twice keeps its smallest body; sentences without a word are in no pair; where both bodies carry the code of one
language their texts decide, and without any labelled body the two roles count as two languages; empty
tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake import session
from lawlake.functions import texts

VOCABULARY, BUCKETS, DIMENSIONS, NEIGHBOURHOODS = 2000, 2048, 128, 1024
PAIRS_PER_FILE = 1000  # alignment costs far more than reading, so small files spread it over the cores
BAND = 0.2
BLOCK, DOCUMENTS_AT_ONCE = 32, 200  # sentences of one side compared, and documents counted, at once
ACCEPT, LEAST = 0.54, 3.0  # least share rendered; least weight of a sentence that proves anything
SHIFT = 1 << 20  # of codes (combination, i, j)
_WORD = re.compile(r"[^\W\d_]+|\d+")
# Number words by language, from one.
NUMBER_WORDS = {
    "eng": "one two three four five six seven eight nine ten eleven twelve".split(),
    "deu": "eins zwei drei vier funf sechs sieben acht neun zehn elf zwolf".split(),
    "fra": "un deux trois quatre cinq six sept huit neuf dix onze douze".split(),
    "spa": "uno dos tres cuatro cinco seis siete ocho nueve diez once doce".split(),
}
_NUMBERS = {lang: {w: str(i) for i, w in enumerate(words, 1) if i > 1} for lang, words in NUMBER_WORDS.items()}


def fold(text: str) -> str:
    """Case and accents aside."""
    text = text.casefold()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def document_pairs(bodies: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(fetch_id, a_id, b_id, a_lang, b_lang, a, b)``: the words of the sentences of primary and translation; languages as coded."""
    parts = bodies.where("role IN ('primary', 'translation') AND content IS NOT NULL").select("body_id", "fetch_id", "role", texts.language(F.col("language")).alias("lang"), "content")
    bounds = sentences.groupBy("body_id").agg(F.sort_array(F.collect_set(F.struct("sent_no", "char_start", "char_end"))).alias("bounds"))
    kind = pa.list_(pa.struct([("n", pa.int32()), ("w", pa.list_(pa.string()))]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for content, spans in zip(batch.column("content").to_pylist(), batch.column("bounds").to_pylist()):
                text = content.decode("utf-8", errors="replace")
                said.append([{"n": s["sent_no"], "w": _WORD.findall(fold(text[s["char_start"] : s["char_end"]]))} for s in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("body_id", "fetch_id", "role", "lang")), pa.array(said, kind)], ["body_id", "fetch_id", "role", "lang", "said"])

    cut_schema = "body_id bigint, fetch_id bigint, role string, lang string, said array<struct<n:int,w:array<string>>>"
    told = parts.join(bounds, "body_id").select("body_id", "fetch_id", "role", "lang", "content", "bounds").mapInArrow(cut, cut_schema)
    side = lambda role: F.min(F.when(F.col("role") == role, F.struct("body_id", "lang", "said")))
    both = told.groupBy("fetch_id").agg(side("primary").alias("p"), side("translation").alias("t")).where("p IS NOT NULL AND t IS NOT NULL")
    return both.select("fetch_id", F.col("p.body_id").alias("a_id"), F.col("t.body_id").alias("b_id"), F.col("p.lang").alias("a_lang"), F.col("t.lang").alias("b_lang"), F.col("p.said").alias("a"), F.col("t.said").alias("b"))


class Vocabulary:
    """Per language the index of every word: frequent ones their own, the others one of ``BUCKETS`` by hash."""

    def __init__(self, core: dict[str, dict[str, int]], seen: dict[str, np.ndarray], sentences: dict[str, int]):
        """``seen`` holds the number of sentences with the words of each index."""
        self.core, self.seen, self.sentences = core, seen, sentences
        self.languages = sorted(core)

    def index(self, lang: str, word: str) -> int:
        """-1 for numbers."""
        if word.isdigit():
            return -1
        known = self.core[lang].get(word)
        return known if known is not None else VOCABULARY + zlib.crc32(word.encode()) % BUCKETS

    def size(self, lang: str) -> int:
        return len(self.seen[lang])

    def tell(self, words: list[str]) -> str | None:
        """The language the words are likeliest of; None without a labelled language."""
        if not self.languages:
            return None
        score = {}
        for lang in self.languages:
            n = self.sentences[lang] + 1
            score[lang] = sum(math.log((self.seen[lang][k] + 0.1) / n if (k := self.core[lang].get(w)) is not None else 0.1 / n) for w in words if not w.isdigit())
        return max(self.languages, key=lambda x: (score[x], x))

    def pair(self, a_lang: str | None, b_lang: str | None, a: list[str], b: list[str]) -> tuple[str, str] | None:
        """Languages of the two sides, from their codes or else their words; None if they are of one."""
        la = a_lang if a_lang in self.core else self.tell(a)
        lb = b_lang if b_lang in self.core else self.tell(b)
        if la == lb:
            la, lb = self.tell(a), self.tell(b)
        return None if la is None or la == lb else (la, lb)


def vocabulary(pairs: DataFrame) -> Vocabulary:
    """The vocabulary of all labelled bodies; at most VOCABULARY + BUCKETS rows a language reach the driver."""
    sides = F.array(F.struct(F.col("a_lang").alias("lang"), F.col("a").alias("s")), F.struct(F.col("b_lang").alias("lang"), F.col("b").alias("s")))
    said = pairs.select(F.inline(sides)).where("lang IS NOT NULL").select("lang", F.explode("s.w").alias("ws"))
    flat = said.select("lang", F.explode(F.array_distinct("ws")).alias("word")).where(~F.col("word").rlike("^[0-9]+$"))
    counts = flat.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.selectExpr("lang", "word", "n", "row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r")
    place = F.when(F.col("r") <= VOCABULARY, F.col("r") - 1).otherwise(VOCABULARY + F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int")
    rows = ranked.groupBy("lang", place.alias("k")).agg(F.min(F.when(F.col("r") <= VOCABULARY, F.col("word"))).alias("word"), F.sum("n").alias("n")).collect()
    core: dict[str, dict[str, int]] = {}
    seen: dict[str, np.ndarray] = {}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        core[lang] = {r.word: r.k for r in sorted(mine, key=lambda r: r.k) if r.word is not None}
        # the buckets are there even if no word was in them: a text whose language is told may have such words
        seen[lang] = np.zeros(VOCABULARY + BUCKETS)
        seen[lang][[r.k for r in mine]] = [r.n for r in mine]
    sentences = {r.lang: r["count"] for r in said.groupBy("lang").count().collect()}
    return Vocabulary(core, seen, sentences)


class Side:
    """The words of one side of a batch of document pairs, in arrays: every word an index of ``spelling``."""

    def __init__(self, column: pa.Array):
        self.first_sentence = _offsets(column)
        flat = column.flatten()
        self.numbers = flat.field("n").to_numpy(zero_copy_only=False)
        words = flat.field("w")
        self.first_word = _offsets(words)
        self.words = words.flatten()

    def said(self, doc: int) -> tuple[int, int]:
        return self.first_word[self.first_sentence[doc]], self.first_word[self.first_sentence[doc + 1]]


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


class Batch:
    """A batch of document pairs: both sides with shared spellings, the languages of each pair, and word indices per language."""

    def __init__(self, batch: pa.RecordBatch, vocab: Vocabulary):
        self.vocab = vocab
        self.sides = [Side(batch.column(c)) for c in ("a", "b")]
        coded = pa.concat_arrays([s.words for s in self.sides]).dictionary_encode()
        self.spelling: list[str] = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = [codes[: len(self.sides[0].words)], codes[len(self.sides[0].words) :]]
        self.languages: list[tuple[str, str] | None] = []
        for doc, (la, lb) in enumerate(zip(batch.column("a_lang").to_pylist(), batch.column("b_lang").to_pylist())):
            if la != lb and la in vocab.core and lb in vocab.core:
                self.languages.append((la, lb))
            else:
                said = [[self.spelling[c] for c in self.codes[k][slice(*self.sides[k].said(doc))]] for k in (0, 1)]
                self.languages.append(vocab.pair(la, lb, *said))
        self._read: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def reading(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """For every spelling its spelling as a number, if it is a number word, and its index in the language."""
        if lang not in self._read:
            said, place = _NUMBERS.get(lang, {}), {w: k for k, w in enumerate(self.spelling)}
            as_number = []
            for k, w in enumerate(self.spelling):
                if w in said:
                    if said[w] not in place:
                        place[said[w]] = len(place)
                    k = place[said[w]]
                as_number.append(k)
            self.spelling += list(place)[len(self.spelling) :]
            as_number += range(len(as_number), len(self.spelling))
            self._read[lang] = np.array(as_number), np.array([self.vocab.index(lang, w) for w in self.spelling])
        return self._read[lang]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


class Tally:
    """Counts of codes in sorted arrays; new ones are merged a few million at a time."""

    def __init__(self, at_once: int = 3_000_000):
        self.at_once, self.waiting, self.size = at_once, [], 0
        self.keys, self.numbers = np.array([], np.int64), np.array([], np.int64)

    def add(self, combination: int, i: np.ndarray, j: np.ndarray, at_i: np.ndarray, at_j: np.ndarray) -> None:
        """Count each (at_i[i], at_j[j]) once; ``at_i`` and ``at_j`` are ascending."""
        if len(at_i) * len(at_j) <= 4 * len(i) + 1_000_000:
            counts = np.bincount(i * len(at_j) + j, minlength=len(at_i) * len(at_j))
            hit = np.flatnonzero(counts)
            n = counts[hit]
        else:
            hit, n = np.unique(i * len(at_j) + j, return_counts=True)
        if len(hit):
            keys = at_i[hit // len(at_j)] * SHIFT + at_j[hit % len(at_j)]
            self.waiting.append((combination * SHIFT * SHIFT + keys, n))
            self.size += len(keys)
        if self.size >= self.at_once:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            order = np.argsort(keys, kind="stable")
            keys, numbers = keys[order], np.concatenate([self.numbers, *(n for _, n in self.waiting)])[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.keys, self.numbers = keys[first], np.add.reduceat(numbers, first)
            self.waiting, self.size = [], 0

    def batches(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.keys), rows):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at : at + rows]), pa.array(self.numbers[at : at + rows])], ["k", "n"])


def combinations(languages: list[str]) -> list[tuple[str, str, str]]:
    """What is counted, (kind, language, other language), in the order of their codes.

    Kinds: c, word i met context j; p, word i met word j of the other language at its place; o, word i
    occurred; b, word i was at a place looked at; n, places looked at.
    """
    return [("c", x, "") for x in languages] + [(k, x, y) for k in "pobn" for x in languages for y in languages if x != y]


def counts(pairs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(k, n)``: the counts of ``combinations``, k being (combination, i, j) in one number."""
    code = {c: k for k, c in enumerate(combinations(vocab.languages))}

    def sentences(batch: Batch, k: int, lang: str, docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents' sentences: the first of each document, the first word of each, and the distinct words."""
        side, (as_number, index) = batch.sides[k], batch.reading(lang)
        docs = np.array(docs)
        n_sent = side.first_sentence[docs + 1] - side.first_sentence[docs]
        sent = _ragged(side.first_sentence[docs], n_sent)
        n_words = side.first_word[sent + 1] - side.first_word[sent]
        word = index[as_number[batch.codes[k][_ragged(side.first_word[sent], n_words)]]]
        at = np.repeat(np.arange(len(sent)), n_words)
        distinct = np.unique(at[word >= 0] * SHIFT + word[word >= 0])
        first = np.searchsorted(distinct, np.arange(len(sent) + 1) * SHIFT)
        return np.concatenate([[0], np.cumsum(n_sent)]), first, distinct % SHIFT, distinct // SHIFT

    none, places = np.zeros(1, np.int64), np.arange(NEIGHBOURHOODS)

    def add_documents(tally: Tally, batch: Batch, la: str, lb: str, docs: list[int], fetches: np.ndarray) -> None:
        parts = []
        for k, lang in ((0, la), (1, lb)):
            doc_first, first, word, at = sentences(batch, k, lang, docs)
            known, word = np.unique(word, return_inverse=True)  # dense from here on
            parts.append((doc_first, first, word, at, known))
            size = np.diff(first)
            tally.add(code["c", lang, ""], np.repeat(word, size[at]), word[_ragged(first[at], size[at])], known, NEIGHBOURHOODS + known)
            per_doc = np.diff(doc_first)
            place = (np.arange(len(first) - 1) - np.repeat(doc_first[:-1], per_doc)) * 6 // np.repeat(per_doc, per_doc)
            where = (np.repeat(fetches[docs], per_doc).astype(np.uint64) * np.uint64(6) + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            tally.add(code["c", lang, ""], word, (where[at] % np.uint64(NEIGHBOURHOODS)).astype(np.int64), known, places)
        for (lang, mine), (other, theirs) in (((la, parts[0]), (lb, parts[1])), ((lb, parts[1]), (la, parts[0]))):
            (doc_a, first_a, word_a, at_a, known_a), (doc_b, first_b, word_b, _, known_b) = mine, theirs
            n_a, n_b = np.diff(doc_a), np.diff(doc_b)
            doc = np.repeat(np.arange(len(docs)), n_a)
            middle = (np.arange(len(doc)) - doc_a[doc] + 0.5) / n_a[doc]
            lo = np.clip(np.ceil((middle - BAND) * n_b[doc] - 0.5), 0, n_b[doc]).astype(np.int64) + doc_b[doc]
            hi = np.clip(np.floor((middle + BAND) * n_b[doc] - 0.5) + 1, 0, n_b[doc]).astype(np.int64) + doc_b[doc]
            hi = np.maximum(lo, hi)
            length = np.where(np.diff(first_a) > 0, first_b[hi] - first_b[lo], 0)
            near = np.unique(np.repeat(np.arange(len(doc)), length) * SHIFT + word_b[_ragged(first_b[lo], length)])
            first_near = np.searchsorted(near, np.arange(len(doc) + 1) * SHIFT)
            there, size = near % SHIFT, np.diff(first_near)
            tally.add(code["p", lang, other], np.repeat(word_a, size[at_a]), there[_ragged(first_near[at_a], size[at_a])], known_a, known_b)
            seen, looked = word_a[size[at_a] > 0], int((size > 0).sum())
            tally.add(code["o", lang, other], seen, np.zeros_like(seen), known_a, none)
            tally.add(code["b", lang, other], there, np.zeros_like(there), known_b, none)
            tally.add(code["n", lang, other], np.zeros(looked, np.int64), np.zeros(looked, np.int64), none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for record_batch in batches:
            batch = Batch(record_batch, vocab)
            fetches = record_batch.column("fetch_id").to_numpy(zero_copy_only=False)
            groups: dict[tuple[str, str], list[int]] = {}
            for doc, pair in enumerate(batch.languages):
                if pair is not None:
                    groups.setdefault(pair, []).append(doc)
            for (la, lb), all_docs in groups.items():
                for start in range(0, len(all_docs), DOCUMENTS_AT_ONCE):
                    add_documents(tally, batch, la, lb, all_docs[start : start + DOCUMENTS_AT_ONCE], fetches)
        yield from tally.batches()

    made = pairs.select("fetch_id", "a_lang", "b_lang", "a", "b").mapInArrow(run, "k bigint, n bigint")
    return made.groupBy("k").agg(F.sum("n").alias("n"))


def skip_gram(frame: pd.DataFrame, size: int, dimensions: int = DIMENSIONS, rounds: int = 80, negatives: float = 2.0) -> np.ndarray:
    """Word vectors of the skip-gram model with negative sampling, fitted to counts (i, j, n) by Adam over the whole matrix; zero for words without a count."""
    rows, i = np.unique(frame["i"].to_numpy(), return_inverse=True)
    used, j = np.unique(frame["j"].to_numpy(), return_inverse=True)
    c = np.zeros((len(rows), len(used)), np.float32)
    np.add.at(c, (i, j), frame["n"].to_numpy(np.float32))
    c /= np.maximum(c.sum(1, keepdims=True), 1)  # every word counts alike
    share = c.sum(0, keepdims=True) / max(c.sum(), 1e-9)
    noise = negatives * share
    draw = np.random.default_rng(7)
    w, v = (draw.normal(0, 0.3 / math.sqrt(dimensions), (n, dimensions)).astype(np.float32) for n in (len(rows), len(used)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)]
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w @ v.T, -15, 15)))
        g = (p - 1) * c + p * noise
        g *= len(used) / 50
        for x, grad, (m, s) in ((w, g @ v, state[0]), (v, g.T @ w, state[1])):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    out = np.zeros((size, dimensions), np.float32)
    out[rows] = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    return out


def _decoded(frame: pd.DataFrame) -> pd.DataFrame:
    """``c, i, j, n`` of counts ``k, n``."""
    k = frame["k"].to_numpy()
    return pd.DataFrame({"c": k // (SHIFT * SHIFT), "i": k // SHIFT % SHIFT, "j": k % SHIFT, "n": frame["n"].to_numpy()})


def train(table: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """The vectors of each language; one task a language, of a bounded matrix."""
    languages, sizes = vocab.languages, {x: vocab.size(x) for x in vocab.languages}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _decoded(frame)
        lang = languages[int(frame["c"].iloc[0])]
        vectors = skip_gram(frame, sizes[lang])
        used = np.flatnonzero(vectors.any(1))
        return pd.DataFrame({"lang": lang, "i": used.astype(np.int32), "vector": [v.tobytes() for v in vectors[used]]})

    counted = table.where(F.col("k") < len(languages) * SHIFT * SHIFT)
    made = counted.groupBy(F.expr(f"k div {SHIFT * SHIFT}").alias("c")).applyInPandas(lambda key, frame: fit(frame), "lang string, i int, vector binary")
    out = {lang: np.zeros((sizes[lang], DIMENSIONS), np.float32) for lang in languages}
    for r in made.collect():  # bounded: VOCABULARY + BUCKETS vectors a language
        out[r.lang][r.i] = np.frombuffer(r.vector, np.float32)
    return out


def lexicon(table: DataFrame, vocab: Vocabulary) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """Per ordered pair of languages, each word's best counterpart and the gain in its probability where the word occurs."""
    said = combinations(vocab.languages)

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _decoded(frame)
        part = {said[c][0]: f for c, f in frame.groupby("c")}
        _, lang, other = said[int(frame["c"].iloc[0])]
        if "p" not in part:
            return pd.DataFrame(columns=["lang", "other", "i", "j", "gain", "score"])
        seen = np.zeros(max(part["p"]["i"].max(), part["o"]["i"].max()) + 1)
        seen[part["o"]["i"].to_numpy()] = part["o"]["n"].to_numpy()
        base = np.zeros(max(part["p"]["j"].max(), part["b"]["i"].max()) + 1)
        base[part["b"]["i"].to_numpy()] = part["b"]["n"].to_numpy() / part["n"]["n"].sum()
        p = part["p"]
        i, j, n = p["i"].to_numpy(), p["j"].to_numpy(), p["n"].to_numpy()
        gain = n / np.maximum(seen[i], 1) - base[j]
        gain -= 1.0 / np.sqrt(np.maximum(seen[i], 1)) / 2  # rare words prove less
        # the counterpart: predicted by the word and not common anyway
        score = gain * np.minimum(1, n / np.maximum(base[j] * part["n"]["n"].sum(), 1) * 4)
        top = pd.DataFrame({"lang": lang, "other": other, "i": i, "j": j, "gain": gain, "score": score}).sort_values(["i", "score", "j"], ascending=[True, False, True]).drop_duplicates("i")
        return top[["lang", "other", "i", "j", "gain", "score"]]

    n_langs = len(vocab.languages)
    pair = F.expr(f"(k div {SHIFT * SHIFT} - {n_langs}) % {max(1, n_langs * (n_langs - 1))}")
    counted = table.where(F.col("k") >= n_langs * SHIFT * SHIFT)
    made = counted.groupBy(pair.alias("pair")).applyInPandas(lambda key, frame: best(frame), "lang string, other string, i int, j int, gain double, score double")
    out: dict = {}
    for r in made.collect():  # bounded: VOCABULARY + BUCKETS a pair of languages
        to, gain = out.setdefault((r.lang, r.other), (np.full(vocab.size(r.lang), -1), np.zeros(vocab.size(r.lang))))
        to[r.i], gain[r.i] = r.j, r.gain
    return out


def procrustes(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The orthogonal matrix that turns the rows of x closest to those of y."""
    u, _, vt = np.linalg.svd((x * weight[:, None]).T @ y)
    return u @ vt


SEED_GAIN = 0.35


def align_spaces(vectors: dict[str, np.ndarray], words: dict, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """All vectors in the space of the pivot language; a language without seeds to it goes by way of one that has."""
    if not vectors:
        return {}
    pivot = max(vectors, key=lambda x: (vocab.sentences[x], x))
    done = {pivot: vectors[pivot]}
    while len(done) < len(vectors):
        options = [(sum((words[k][1] > SEED_GAIN).sum() for k in ((lang, known), (known, lang)) if k in words), lang, known) for lang in vectors if lang not in done for known in done]
        _, lang, known = max(options)
        seeds: list[tuple[int, int, float]] = []
        for a, b, flip in ((lang, known, False), (known, lang, True)):
            if (a, b) in words:
                to, gain = words[a, b]
                seeds += [((j, i) if flip else (i, j)) + (g,) for i, (j, g) in enumerate(zip(to.tolist(), gain.tolist())) if g > SEED_GAIN]
        if seeds:
            x, y = vectors[lang][[s[0] for s in seeds]], done[known][[s[1] for s in seeds]]
            done[lang] = vectors[lang] @ procrustes(x, y, np.array([s[2] for s in seeds]))
        else:
            done[lang] = np.zeros_like(vectors[lang])
    return done


class Model:
    """What the alignment of a pair of documents needs: words, vectors in one space, weights."""

    def __init__(self, vocab: Vocabulary, vectors: dict[str, np.ndarray], words: dict):
        self.vocab, self.vectors = vocab, {k: v.astype(np.float32) for k, v in vectors.items()}
        self.weights: dict[tuple[str, str], np.ndarray] = {}
        for (lang, other), (_, gain) in words.items():
            n = vocab.seen[lang]
            rarity = np.log1p(n.sum() / 12 / np.maximum(n, 1))
            self.weights[lang, other] = np.maximum(rarity * np.clip((gain - 0.1) / 0.5, 0, 1), 0)


class Text:
    """One side of a document pair: its sentences with words, as keys of the pair with weights, one after the other."""

    def __init__(self, sentence: np.ndarray, key: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        """``sentence`` (ascending) and ``key`` of each distinct word of each sentence; ``vectors`` by key."""
        self.key, self.weight = key, weight
        self.place, self.first = np.unique(sentence, return_index=True)  # number of each sentence that has words, its first word
        self.end = np.append(self.first[1:], len(key))
        self.total = np.add.reduceat(weight, self.first) if len(key) else np.array([])
        self.vectors = np.add.reduceat(vectors[key] * weight[:, None].astype(np.float32), self.first, axis=0) if len(key) else np.zeros((0, vectors.shape[1]), np.float32)

    def __len__(self) -> int:
        return len(self.place)


def rendered(soft: np.ndarray, a: Text, i: np.ndarray, b: Text, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sentences ``i`` and ``j``, each to each, the share of a's weight found in b and the share of b's found in a."""
    sizes = [t.end[at] - t.first[at] for t, at in ((a, i), (b, j))]
    words = [_ragged(t.first[at], n) for t, at, n in zip((a, b), (i, j), sizes)]
    starts = [np.cumsum(n) - n for n in sizes]
    near = soft[a.key[words[0]]][:, b.key[words[1]]]
    in_b = np.add.reduceat(np.maximum.reduceat(near, starts[1], axis=1) * a.weight[words[0]][:, None], starts[0], axis=0) / a.total[i][:, None]
    in_a = np.add.reduceat(np.maximum.reduceat(near, starts[0], axis=0) * b.weight[words[1]], starts[1], axis=1) / b.total[j]
    return in_b, in_a


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def warp(rows: list[list[float]], lo: list[int]) -> list[tuple[int, int]]:
    """The cheapest monotone path through a corridor (time warping).

    ``rows`` holds the costs of each row of it, which begins at column ``lo``; the first begins at 0, the
    last ends at the last column, and neighbours overlap or touch.
    """
    far = math.inf
    totals: list[list[float]] = []
    above, start = [0.0], -1  # what comes before the first cell
    for cost, at in zip(rows, lo):
        shift, size, line, left = at - start, len(above), [], far
        for k, c in enumerate(cost, shift):
            best = left
            if k < size and above[k] < best:
                best = above[k]
            if 0 < k <= size and above[k - 1] < best:
                best = above[k - 1]
            left = c + best
            line.append(left)
        totals.append(line)
        above, start = line, at
    get = lambda i, j: totals[i][j - lo[i]] if i >= 0 and lo[i] <= j < lo[i] + len(totals[i]) else far
    i, j = len(rows) - 1, lo[-1] + len(rows[-1]) - 1
    path = [(i, j)]
    while i or j:
        moves = (get(i - 1, j - 1), get(i - 1, j), get(i, j - 1))
        k = moves.index(min(moves))
        i, j = i - (k != 2), j - (k != 1)
        path.append((i, j))
    return path[::-1]


def corridor(path: list[tuple[int, int]], n: int, m: int, radius: int) -> tuple[list[int], list[int]]:
    """The columns [lo, hi) of each of n rows within ``radius`` of a path through the halved sequences."""
    lo, hi = [m] * n, [0] * n
    for i, j in path:
        for row in (2 * i, 2 * i + 1):
            if row < n:
                lo[row] = min(lo[row], max(0, 2 * j - radius))
                hi[row] = max(hi[row], min(m, 2 * j + 2 + radius))
    return lo, hi


def _rows(cells, lo: list[int], hi: list[int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each row of a corridor its values from column lo on, with lo and hi; ``cells(rows, from, to)`` is asked for ``BLOCK`` rows at a time."""
    for at in range(0, len(lo), BLOCK):
        x, y = min(lo[at : at + BLOCK]), max(hi[at : at + BLOCK])
        values = cells(np.arange(at, min(at + BLOCK, len(lo))), x, y)
        for k, line in enumerate(values, at):
            yield line[lo[k] - x :], lo[k], hi[k]


def coarse_corridor(a: np.ndarray, b: np.ndarray, radius: int = 3, least: int = 8) -> tuple[list[int], list[int]]:
    """Where the path of two sequences of vectors must be looked for, from the paths of their merged neighbours; linear in their lengths."""
    n, m = len(a), len(b)
    if min(n, m) <= least:
        return [0] * n, [m] * n
    merged = [np.add.reduceat(x, np.arange(0, len(x), 2), axis=0) for x in (a, b)]
    lo, hi = coarse_corridor(*merged, radius, least)
    ua, ub = _unit(merged[0]), _unit(merged[1])
    path = warp([line[: y - x].tolist() for line, x, y in _rows(lambda i, x, y: 1 - ua[i] @ ub[x:y].T, lo, hi)], lo)
    return corridor(path, n, m, radius)


def align_texts(soft: np.ndarray, a: Text, b: Text) -> list[tuple[int, int]]:
    """Pairs (numbers as in ``place``) of the sentences of which one renders all or part of the other."""
    if not len(a) or not len(b):
        return []
    ua, ub = _unit(a.vectors), _unit(b.vectors)
    cells: dict[tuple[int, int], tuple[float, float, float]] = {}  # share in b, share in a, strength
    rivals_a, rivals_b = np.zeros(len(a)), np.zeros(len(b))

    def compare(i: np.ndarray, j: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """Strength of the cells, those inside the mask; what is rendered well is noted."""
        in_b, in_a = rendered(soft, a, i, b, j)
        one = np.maximum(in_b, in_a)
        strength = 0.75 * one + 0.25 * np.clip(ua[i] @ ub[j].T, 0, 1)
        proves = (a.total[i] >= LEAST)[:, None] & (b.total[j] >= LEAST)
        if within is not None:
            proves &= within
        strength[~proves] = 0
        rivals_a[i] = np.maximum(rivals_a[i], strength.max(1))
        rivals_b[j] = np.maximum(rivals_b[j], strength.max(0))
        for k, m in np.argwhere(proves & (one >= ACCEPT)).tolist():
            cells[int(i[k]), int(j[m])] = (float(in_b[k, m]), float(in_a[k, m]), float(strength[k, m]))
        return strength

    lo, hi = coarse_corridor(a.vectors, b.vectors)
    low, high = np.array(lo), np.array(hi)

    def inside(i: np.ndarray, x: int, y: int) -> np.ndarray:
        at = np.arange(x, y)
        return 1 - compare(i, at, (at >= low[i][:, None]) & (at < high[i][:, None]))

    path = warp([line[: y - x].tolist() for line, x, y in _rows(inside, lo, hi)], lo)
    chosen: set[tuple[int, int]] = set()
    covered_a, covered_b = np.zeros(len(a)), np.zeros(len(b))

    def take(i: int, j: int) -> None:
        chosen.add((i, j))
        covered_a[i] += cells[i, j][0]
        covered_b[j] += cells[i, j][1]

    def best_first(of: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those rendered well, and without a far better partner for both, best first."""
        fit = [c for c in of if cells[c][2] >= min(rivals_a[c[0]], rivals_b[c[1]]) - 0.08]
        return sorted(fit, key=lambda c: (-cells[c][2], c))

    for i, j in best_first([c for c in path if c in cells]):
        if min(covered_a[i] + cells[i, j][0], covered_b[j] + cells[i, j][1]) < 1.45:
            take(i, j)
    # the spans that aren't rendered whole yet are compared with one another, across the document
    open_a, open_b = np.flatnonzero((covered_a < 0.8) & (a.total >= LEAST)), np.flatnonzero((covered_b < 0.8) & (b.total >= LEAST))
    for at in range(0, len(open_a) if len(open_b) else 0, BLOCK):
        compare(open_a[at : at + BLOCK], open_b)
    for i, j in best_first([c for c in cells if c not in chosen]):
        if covered_a[i] < 0.8 and covered_b[j] < 0.8:
            take(i, j)
    # a sentence that was merged or divided has room for a partner that nothing else renders yet
    for i, j in best_first([c for c in cells if c not in chosen]):
        in_b, in_a, _ = cells[i, j]
        room_a = covered_a[i] < 0.8 and covered_a[i] + in_b < 1.25 and covered_b[j] < 0.35
        room_b = covered_b[j] < 0.8 and covered_b[j] + in_a < 1.25 and covered_a[i] < 0.35
        if room_a or room_b:
            take(i, j)
    return sorted((int(a.place[i]), int(b.place[j])) for i, j in chosen)


def align_batch(model: Model, record_batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """``(document, sentence of a, sentence of b)`` rows of a batch of document pairs, by number."""
    batch, long = Batch(record_batch, model.vocab), np.array([], bool)
    for doc, pair in enumerate(batch.languages):
        if pair is None or pair not in model.weights or pair[::-1] not in model.weights:
            continue
        said = []
        for k, lang in enumerate(pair):
            side, (as_number, index) = batch.sides[k], batch.reading(lang)
            first, last = side.first_sentence[doc], side.first_sentence[doc + 1]
            lengths = np.diff(side.first_word[first : last + 1])
            spelt = as_number[batch.codes[k][slice(*side.said(doc))]]
            distinct = np.unique(np.repeat(np.arange(last - first), lengths) * SHIFT + spelt)
            said.append((distinct // SHIFT, distinct % SHIFT))
        keys = [np.unique(spelt) for _, spelt in said]
        if len(long) < len(batch.spelling):
            long = np.array([len(w) > 3 for w in batch.spelling], bool)
        index = [batch.reading(lang)[1][key] for lang, key in zip(pair, keys)]
        # numbers, and rare words that both texts spell alike, are the same or not; other words are as near as their vectors
        _, at_a, at_b = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        name = (index[0][at_a] >= VOCABULARY) & (index[1][at_b] >= VOCABULARY) & long[keys[0][at_a]]
        exact = [x < 0 for x in index]
        exact[0][at_a[name]] = True
        exact[1][at_b[name]] = True
        vectors, weights = [], []
        for k, lang in enumerate(pair):
            safe = np.maximum(index[k], 0)
            v = model.vectors[lang][safe]
            for at in np.flatnonzero(exact[k]):
                v[at] = _spelt(batch.spelling[keys[k][at]])
            vectors.append(v)
            weights.append(np.where(exact[k], 4.0, model.weights[pair[k], pair[1 - k]][safe]))
        near = vectors[0] @ vectors[1].T
        near[exact[0]] = 0
        near[:, exact[1]] = 0
        soft = np.clip((near - 0.35) / 0.3, 0, 1)
        same = exact[0][at_a] & exact[1][at_b]
        soft[at_a[same], at_b[same]] = 1
        sides = []
        for k in (0, 1):
            key = np.searchsorted(keys[k], said[k][1])
            weight = weights[k][key]
            keep = weight > 0  # what is never rendered says nothing
            sides.append(Text(said[k][0][keep], key[keep], weight[keep], vectors[k]))
        numbers = [batch.sides[k].numbers[batch.sides[k].first_sentence[doc] :] for k in (0, 1)]
        for i, j in align_texts(soft, *sides):
            yield doc, int(numbers[0][i]), int(numbers[1][j])


_SPELT: dict[str, np.ndarray] = {}


def _spelt(word: str) -> np.ndarray:
    """A direction of its own for a number or name."""
    if word not in _SPELT:
        if len(_SPELT) > 10_000:
            _SPELT.clear()
        _SPELT[word] = np.random.default_rng(zlib.crc32(word.encode())).normal(0, 1 / math.sqrt(DIMENSIONS), DIMENSIONS).astype(np.float32)
    return _SPELT[word]


def fit(pairs: DataFrame) -> Model:
    """The model of all pairs; ``pairs`` is read several times, so it should be a written table."""
    vocab = vocabulary(pairs)
    folder = session.shared_dir(pairs.sparkSession, "align-counts")
    counts(pairs, vocab).write.parquet(folder)
    table = pairs.sparkSession.read.parquet(folder)
    words = lexicon(table, vocab)
    return Model(vocab, align_spaces(train(table, vocab), words, vocab), words)


def found(spark: SparkSession, bodies: DataFrame, sentences: DataFrame) -> DataFrame:
    """p3_found: pairs of sentences of the two bodies of a fetch, the smaller body first."""
    folder = session.shared_dir(spark, "align")
    document_pairs(bodies, sentences).write.option("maxRecordsPerFile", PAIRS_PER_FILE).parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    if not pairs.where("a_lang IS NOT NULL OR b_lang IS NOT NULL").head(1):
        pairs = pairs.withColumns({"a_lang": F.lit("primary"), "b_lang": F.lit("translation")})
    shared = spark.sparkContext.broadcast(fit(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_id, b_id = batch.column("a_id").to_pylist(), batch.column("b_id").to_pylist()
            rows = [(*min(x, y), *max(x, y)) for doc, i, j in align_batch(shared.value, batch) for x, y in [((a_id[doc], i), (b_id[doc], j))]]
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["body_lo", "sent_lo", "body_hi", "sent_hi"])

    return pairs.select("a_id", "b_id", "a_lang", "b_lang", "a", "b").mapInArrow(run, "body_lo bigint, sent_lo int, body_hi bigint, sent_hi int")
