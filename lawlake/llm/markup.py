"""Structure of marked-up documents by union-free regular-expression wrappers per host.

Bodies become streams of raw tokens (``lexers``): tags with their classes or markers of lines, and contents. For
every host and kind of markup a wrapper is inferred from all its streams. The contents of an element path are
aligned one after the other with the expression so far: a token without partner becomes optional; where a
token comes again, the stretch from its first place is tested for a square, and becomes a repeated group of the
tokens in their order, those missing from a repetition optional; texts become slots. There is no union:
tokens of no fixed order are one group of optionals. An expression names each token once, so it stays as
small as the alphabet however many documents it has seen, and merging two expressions is the same alignment:
every task infers its own wrappers and only these, not documents, are shuffled and merged.

The wrapper says what its slots are. Where the language has a tag for headings, lists or items that
holds; what a host's template marks up with blocks of its own classes is read from the expression
(``parts``): a block that holds nothing but one repeated block of texts is a list, a text that opens every round
of a repeated group is its heading. Applied to a stream, the wrapper is one regular expression whose named
slots are the elements, and the plain text between them.

Bodies without markup are dropped when they are tokenized; the token streams of the others are written once
to the shared folder and read for inference and for extraction.

Defined results: null or blank contents and bodies without markup yield nothing; invalid UTF-8 is replaced;
a body of no known fetch belongs to the host ""; elements repeated within a body come once in ``found``;
a stream nested beyond ``DEEPEST``, or seen only after inference and not matched by its host's wrapper, is read
by the language's own tags and the parts the wrapper gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawlake import session
from lawlake.llm import lexers

# a member of a factor: its token, whether it must occur, whether it may repeat at once
Member = tuple[str, bool, bool]
# a factor: members in order, whether it must occur, whether the whole may repeat
Factor = tuple[tuple[Member, ...], bool, bool]
SLOTS = {"T": "text", "C": "code", "F": "formula"}
PARTS = {"H": "heading", "L": "list", "I": "list_item"}
DEEPEST = 100


def contents(stream: list[str]) -> Iterator[tuple[str, list[str]]]:
    """(path, tokens in order) of every element of a balanced stream; the path of the body is empty."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    for token in stream:
        if token == ">":
            yield stack.pop()
        elif token[0] == "<":
            path, inner = stack[-1]
            inner.append(token)
            stack.append((f"{path}{token}", []))
        else:
            stack[-1][1].append(token)
    yield stack[0]


def depth(stream: list[str]) -> int:
    deepest = now = 0
    for token in stream:
        now += 1 if token[0] == "<" else -1 if token == ">" else 0
        deepest = max(deepest, now)
    return deepest


def tokens_of(factor: Factor) -> list[str]:
    return [t for t, _, _ in factor[0]]


def _joined(factors: list[Factor]) -> Factor:
    """The repeated group that holds any sequence of what the factors hold: all their tokens, each optional."""
    order = dict.fromkeys(t for f in factors for t in tokens_of(f))
    if len(order) == 1:
        return ((next(iter(order)), True, False),), any(m for _, m, _ in factors), True
    return tuple((t, False, True) for t in order), any(m for _, m, _ in factors), True


def settle(factors: list[Factor]) -> list[Factor]:
    """Every token in one factor: what comes again makes one repeated group of all from its first to its last place."""
    out: list[Factor] = []
    for f in factors:
        first = next((i for i, o in enumerate(out) if set(tokens_of(o)) & set(tokens_of(f))), None)
        if first is None:
            out.append(f)
        else:
            out[first:] = [_joined([*out[first:], f])]
    return out


def square(members: list[str], said: list[str]) -> Factor:
    """The group of these tokens, in this order, as a sequence of them repeats it: what every round has must occur."""
    place = {t: k for k, t in enumerate(members)}
    rounds: list[list[str]] = []
    for t in said:
        if not rounds or place[t] < place[rounds[-1][-1]]:
            rounds.append([])
        rounds[-1].append(t)
    if len(members) == 1:
        return ((members[0], True, False),), True, len(said) > 1
    return tuple((t, all(t in r for r in rounds), any(r.count(t) > 1 for r in rounds)) for t in members), True, len(rounds) > 1


def fold(said: list[str]) -> list[Factor]:
    """The expression of one sequence."""
    out, at = [], 0
    for f in settle([(((t, True, False),), True, False) for t in said]):
        mine, end = tokens_of(f), at
        while end < len(said) and said[end] in mine:
            end += 1
        out.append(square(mine, said[at:end]))
        at = end
    return out


def _met(x: Factor, y: Factor) -> Factor:
    """The factor that holds what either holds."""
    if tokens_of(x) == tokens_of(y):
        return tuple((t, m and n, p or q) for (t, m, p), (_, n, q) in zip(x[0], y[0])), x[1] and y[1], x[2] or y[2]
    group, _, many = _joined([x, y])
    return group, x[1] and y[1], many


def align(a: list[Factor], b: list[Factor]) -> list[Factor]:
    """The expression that holds what either holds: factors aligned by shared tokens, the rest optional."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    meets = [[bool(set(tokens_of(x)) & set(tokens_of(y))) for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if meets[i][j] else 0)
    out: list[Factor] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and meets[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_met(a[i], b[j]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            out.append((a[i][0], False, a[i][2]))
            i += 1
        else:
            out.append((b[j][0], False, b[j][2]))
            j += 1
    # a group that swallowed an optional part holds, but may be empty only if all its parts could be
    return [(g, all(_needs(x, g) for x in (a, b)), many) for g, _, many in settle(out)]


def _needs(expression: list[Factor], group: tuple[Member, ...]) -> bool:
    mine = {t for t, _, _ in group}
    return any(must and set(tokens_of((g, must, many))) <= mine for g, must, many in expression)


def show(expression: list[Factor]) -> str:
    return json.dumps(expression, ensure_ascii=False, separators=(",", ":"))


def read(text: str) -> list[Factor]:
    return [(tuple((t, must, many) for t, must, many in group), must_all, many_all) for group, must_all, many_all in json.loads(text)]


def infer(observed: Iterable[tuple[str, list[Factor]]]) -> dict[str, list[Factor]]:
    """The wrapper (path -> expression) of (path, expression) pairs."""
    wrapper: dict[str, list[Factor]] = {}
    for path, new in observed:
        wrapper[path] = align(wrapper[path], new) if path in wrapper else new
    return wrapper


def parts(wrapper: dict[str, list[Factor]]) -> dict[str, str]:
    """What the elements are, by path: as the language's tags say, and blocks with a class as their place in the expression says."""
    out = {p: PARTS[p.rpartition("<")[2][0]] for p in wrapper if p and p.rpartition("<")[2][0] in PARTS}

    def text_of_template(path: str) -> bool:
        inner = wrapper.get(path, [])
        return "." in path.rpartition("<")[2] and path.rpartition("<")[2][0] == "B" and len(inner) == 1 and tokens_of(inner[0]) == ["T"]

    for path, expression in wrapper.items():
        if len(expression) == 1 and len(expression[0][0]) == 1 and expression[0][2] and path.rpartition("<")[2][:1] == "B":
            item = path + expression[0][0][0][0]
            if text_of_template(item):
                out[path], out[item] = "list", "list_item"
    for path, expression in wrapper.items():
        for group, _, many in expression:
            token, must, again = group[0]
            if many and len(group) > 1 and must and not again and text_of_template(path + token):
                out.setdefault(path + token, "heading")
    return out


def compile_wrapper(wrapper: dict[str, list[Factor]]) -> tuple[dict[str, str], str]:
    """A character for each token, and the regular expression of whole streams."""
    said = sorted({t for e in wrapper.values() for f in e for t in tokens_of(f)} | set(SLOTS))
    letter = {t: chr(0xF0000 + k) for k, t in enumerate(said)} | {">": ">"}
    what = parts(wrapper)

    def one(path: str, token: str) -> str:
        if token in SLOTS:
            return f"(?P<{SLOTS[token]}>{letter[token]})"
        name, inner = what.get(path + token), f"{letter[token]}{contents_of(path + token)}>"
        return f"(?P<{name}>{inner})" if name else f"(?:{inner})"

    # possessive: a token belongs to one factor, so nothing is to be tried again
    def contents_of(path: str) -> str:
        out = []
        for group, must, many in wrapper.get(path, []):
            inner = "".join(one(path, t) + {(1, 0): "", (1, 1): "++", (0, 0): "?+", (0, 1): "*+"}[int(m), int(a)] for t, m, a in group)
            out.append(f"(?:{inner}){'++' if many else ''}" if must else f"(?:{inner}){'*+' if many else '?+'}")
        return "".join(out)

    return letter, contents_of("")


@lru_cache(4096)
def compiled(key: str) -> tuple[dict[str, str], regex.Pattern | None, dict[str, str]]:
    """Characters, pattern and parts of a wrapper given as JSON of path -> expression."""
    wrapper = {p: read(e) for p, e in json.loads(key)} if key else {}
    letter, pattern = compile_wrapper(wrapper)
    return letter, regex.compile(pattern) if wrapper else None, parts(wrapper)


def _spans(key: str, stream: list[str]) -> list[tuple[int, int, str]]:
    """(begin, end, name) of the slots of a stream, by its wrapper."""
    letter, pattern, what = compiled(key)
    hit = None
    if pattern is not None and depth(stream) <= DEEPEST and all(t in letter for t in stream):
        hit = pattern.fullmatch("".join(letter[t] for t in stream))
    if hit is not None:
        return [(a, b, n) for n in pattern.groupindex for a, b in hit.spans(n)]
    out, open_at = [], []
    for i, token in enumerate(stream):
        if token[0] == "<":
            path = (open_at[-1][1] if len(open_at) <= DEEPEST and open_at else "") + token
            open_at.append((i, path))
        elif token == ">":
            begin, path = open_at.pop()
            if name := PARTS.get(stream[begin][1]) or what.get(path):
                out.append((begin, i + 1, name))
        else:
            out.append((i, i + 1, SLOTS[token]))
    return out


def extract(key: str, stream: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(element, text) of a stream by the slots of its wrapper, in document order."""
    contents_at = iter(texts)
    where = {i: next(contents_at) for i, t in enumerate(stream) if t in SLOTS}
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[int, list[str]]] = []
    for begin, end, name in sorted(_spans(key, stream), key=lambda x: (x[0], -x[1])):
        while stack and stack[-1][0] <= begin:
            stack.pop()
        if name == "list":
            continue
        if name in ("heading", "list_item"):
            said: list[str] = []
            out.append((name, said))
            stack.append((end, said))
            continue
        text = where[begin]
        if name != "text":
            out.append((name, [text]))
        if stack and name != "code":
            stack[-1][1].append(text)
        elif not stack and name == "text":
            out.append(("text", [text]))
    return [(n, t) for n, said in out if (t := lexers.squeeze(" ".join(said)))]


def tokenized(bodies: DataFrame, fetches: DataFrame) -> DataFrame:
    """``(body_id, site, stream, texts)`` of the bodies with markup; ``site`` is host and kind of markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for row in zip(*(batch.column(c).to_pylist() for c in ("body_id", "fetch_id", "media_type", "content"))):
                kind, tokens = lexers.lex(row[3], row[2])
                if any(c != "T" for c, _ in tokens):
                    stream = [f"<{t}" if c == "<" else c for c, t in tokens]
                    for col, x in zip(cols, (row[0], row[1], kind, stream, [t for c, t in tokens if c in SLOTS])):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["body_id", "fetch_id", "kind", "stream", "texts"])

    streams = bodies.select("body_id", "fetch_id", "media_type", "content").mapInArrow(run, "body_id bigint, fetch_id bigint, kind string, stream array<string>, texts array<string>")
    hosts = fetches.groupBy("fetch_id").agg(F.max(F.lower(F.regexp_extract("source_url", r"^[^:/]+://([^/?#]+)", 1))).alias("host"))
    named = streams.join(hosts, "fetch_id", "left")
    return named.select("body_id", F.concat_ws(" ", F.coalesce("host", F.lit("")), "kind").alias("site"), "stream", "texts")


def wrappers(streams: DataFrame) -> DataFrame:
    """``(site, wrapper)``: per site the JSON of (path, expression) pairs; inferred per task, then merged path by path."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list[Factor]] = {}
        folded = lru_cache(1 << 14)(lambda said: fold(list(said)))
        for batch in batches:
            for site, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if depth(stream) > DEEPEST:
                    continue
                for path, said in contents(stream):
                    new, old = folded(tuple(said)), found.get((site, path))
                    if old != new:
                        found[site, path] = align(old, new) if old is not None else new
        sites, paths = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(paths, pa.string()), pa.array([show(e) for e in found.values()], pa.string())], ["site", "path", "expression"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by site and path, so one expression is held at a time."""
        key, held = None, None
        for batch in batches:
            done = []
            for site, path, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (site, path) == key:
                    held = align(held, read(text))
                    continue
                if key is not None:
                    done.append((*key, show(held)))
                key, held = (site, path), read(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["site", "path", "expression"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (*key, show(held))], ["site", "path", "expression"])

    partials = streams.select("site", "stream").mapInArrow(partial, "site string, path string, expression string").distinct()
    sorted_ = partials.repartition("site", "path").sortWithinPartitions("site", "path", "expression")
    merged = sorted_.mapInArrow(merge, "site string, path string, expression string")
    return merged.groupBy("site").agg(F.to_json(F.sort_array(F.collect_list(F.array("path", "expression")))).alias("wrapper"))


def elements(spark: SparkSession, bodies: DataFrame, fetches: DataFrame) -> DataFrame:
    """``(body_id, position, element, element_text)`` in document order, plain text between elements as ``text``."""
    folder = session.shared_dir(spark, "markup")
    tokenized(bodies, fetches).write.parquet(f"{folder}/streams")
    streams = spark.read.parquet(f"{folder}/streams")
    wrappers(streams).write.parquet(f"{folder}/wrappers")
    joined = streams.join(spark.read.parquet(f"{folder}/wrappers"), "site", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for body, stream, texts, wrapper in zip(*(batch.column(c).to_pylist() for c in ("body_id", "stream", "texts", "wrapper"))):
                rows += [(body, i, name, text) for i, (name, text) in enumerate(extract(wrapper or "", stream, texts))]
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["body_id", "position", "element", "element_text"])

    return joined.select("body_id", "stream", "texts", "wrapper").mapInArrow(run, "body_id bigint, position int, element string, element_text string")


def found(spark: SparkSession, bodies: DataFrame, fetches: DataFrame) -> DataFrame:
    """p1_found: the distinct structural elements of each body."""
    return elements(spark, bodies, fetches).where("element <> 'text'").select("body_id", "element", "element_text").distinct()


def clean_texts(spark: SparkSession, bodies: DataFrame, fetches: DataFrame) -> DataFrame:
    """``(body_id, text)``: clean text that keeps its structure: ``# `` headings, ``- `` items, fenced code, ``$`` formulas."""
    mark = F.expr("CASE element WHEN 'heading' THEN '# ' || element_text WHEN 'list_item' THEN '- ' || element_text WHEN 'code' THEN '```\\n' || element_text || '\\n```' WHEN 'formula' THEN '$' || element_text || '$' ELSE element_text END")
    lines = elements(spark, bodies, fetches).groupBy("body_id").agg(F.sort_array(F.collect_list(F.struct("position", mark.alias("line")))).alias("lines"))
    return lines.select("body_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
