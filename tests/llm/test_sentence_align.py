import random
import time

import numpy as np
import pandas as pd

from lawlake.llm import sentence_align as a

BODIES = "body_id bigint, fetch_id bigint, role string, language string, content binary, lang string"
SENTENCES = "body_id bigint, sent_no int, char_start int, char_end int"


def corpus(n, seed=4):
    """Documents of an invented pair of languages, with merged, divided, moved, left out and added sentences, and the true pairs."""
    rnd = random.Random(seed)
    roots = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(120)]
    actors, acts, ends = roots[:25], [roots[25 + 3 * k : 28 + 3 * k] for k in range(20)], [roots[85 + 2 * k : 87 + 2 * k] for k in range(15)]
    en = lambda w: w + "ing"
    de = lambda w: w[::-1] + "ung"

    def clause():
        return [rnd.choice(actors)], rnd.choice(acts), rnd.choice([None, None, rnd.randrange(1, 90)]), rnd.choice(ends)

    def say(c, f, the, shall, number, cond):
        head = f"{the} {' '.join(map(f, c[0]))} {shall} {' '.join(map(f, c[1]))}"
        return head + (f" {number} {c[2]}" if c[2] else "") + (f" {cond} {' '.join(map(f, c[3]))}" if cond else "")

    bodies, sentences, truth = [], [], set()
    for f in range(n):
        clauses = [clause() for _ in range(rnd.randrange(5, 14))]
        left = [say(c, en, "the", "shall", "under", "if") for c in clauses]
        right, links = [], []
        k = 0
        while k < len(clauses):
            c, dice = clauses[k], rnd.random()
            if dice < 0.06:
                pass
            elif dice < 0.14 and k + 1 < len(clauses):
                right.append(say(c, de, "der", "wird", "nach", "wenn") + "; " + say(clauses[k + 1], de, "die", "wird", "nach", "wenn"))
                links += [(k, len(right) - 1), (k + 1, len(right) - 1)]
                k += 1
            elif dice < 0.22:
                right.append(say(c, de, "der", "wird", "nach", None))
                right.append("das gilt nur wenn " + " ".join(map(de, c[3])))
                links += [(k, len(right) - 2), (k, len(right) - 1)]
            else:
                right.append(say(c, de, "der", "wird", "nach", "wenn"))
                links.append((k, len(right) - 1))
            if rnd.random() < 0.05:
                right.append("das ist eine nichtamtliche fassung")
            k += 1
        order = list(range(len(right)))
        if rnd.random() < 0.3 and len(order) > 4:
            x = rnd.randrange(len(order) - 2)
            order = order[:x] + order[x + 2 :] + order[x : x + 2]
        place = {old: new for new, old in enumerate(order)}
        for role, lines, body in (("primary", left, 2 * f), ("translation", [right[k] for k in order], 2 * f + 1)):
            at, text = 0, ""
            for no, line in enumerate(lines, 1):
                sentences.append((body, no, at, at + len(line)))
                text += line + ". "
                at = len(text)
            bodies.append((body, f, role, None, text.encode(), "x"))
        truth |= {(2 * f, i + 1, 2 * f + 1, place[j] + 1) for i, j in links}
    return bodies, sentences, truth


def test_pairs_against_the_truth(spark):
    bodies, sentences, truth = corpus(260)
    got = {tuple(r) for r in a.found(spark, spark.createDataFrame(bodies, BODIES), spark.createDataFrame(sentences + sentences[:50], SENTENCES)).collect()}
    right = len(got & truth)
    assert right / len(got) > 0.93 and right / len(truth) > 0.9, (right / len(got), right / len(truth))


def test_procrustes_finds_a_rotation():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 8))
    turn, _ = np.linalg.qr(draw.normal(size=(8, 8)))
    w = a.procrustes(x, x @ turn, np.ones(60))
    assert np.allclose(w, turn, atol=1e-6) and np.allclose(w @ w.T, np.eye(8), atol=1e-6)


def test_warping_in_a_corridor_equals_full_warping_on_clear_paths():
    draw = np.random.default_rng(2)
    for n, m in ((30, 40), (9, 50), (64, 64)):
        cost = 0.6 + 0.4 * draw.random((n, m))
        for i in range(n):
            cost[i, i * m // n] = 0.01
        full = a.warp(cost.tolist(), [0] * n)
        halves = np.minimum.reduceat(np.minimum.reduceat(cost, np.arange(0, n, 2), 0), np.arange(0, m, 2), 1)
        lo, hi = a.corridor(a.warp(halves.tolist(), [0] * len(halves)), n, m, 3)
        path = a.warp([cost[i, lo[i] : hi[i]].tolist() for i in range(n)], lo)
        assert path[0] == full[0] == (0, 0) and path[-1] == full[-1] == (n - 1, m - 1)
        assert all(p != q and q[0] - p[0] in (0, 1) and q[1] - p[1] in (0, 1) for p, q in zip(path, path[1:]))
        total = lambda p: sum(cost[i, j] for i, j in p)  # noqa: B023, E731
        assert total(path) <= total(full) * 1.05 + 1e-9


def text(sentences, vectors):
    """A side whose sentences are lists of keys of weight 2."""
    keys = np.array([k for s in sentences for k in s])
    return a.Text(np.repeat(np.arange(len(sentences)), [len(s) for s in sentences]), keys, np.full(len(keys), 2.0), vectors)


def test_warping_tells_repeated_sentences_apart(monkeypatch):
    """A sentence stands twice in one text and once in the other: order says which is meant; without the path recall falls."""
    draw = np.random.default_rng(3)
    vectors = a._unit(draw.normal(size=(400, 32))).astype(np.float32)
    repeated, found, truth = [0, 1, 2, 3], {}, set()
    left, right = [], []
    for k in range(40):
        own = list(range(4 + 9 * k, 4 + 9 * k + 9))
        left += [own[:4], own[4:], repeated]
        right += [own[:4], own[4:]] + [repeated] * (k % 2)
        truth |= {(3 * k, len(right) - 2 - k % 2), (3 * k + 1, len(right) - 1 - k % 2)} | ({(3 * k + 2, len(right) - 1)} if k % 2 else set())
    soft = np.eye(400)
    for name in ("with", "without"):
        with monkeypatch.context() as mp:
            if name == "without":
                mp.setattr(a, "warp", lambda rows, lo: [] if len(rows) == len(left) else WARP(rows, lo))
            found[name] = set(a.align_texts(soft, text(left, vectors), text(right, vectors)))
    share = lambda got: len(got & truth) / len(truth)
    assert share(found["with"]) > 0.98 and share(found["without"]) < 0.85, (share(found["with"]), share(found["without"]))


WARP = a.warp


def test_two_thousand_sentences_with_moved_and_left_out_spans():
    draw = np.random.default_rng(4)
    vectors = a._unit(draw.normal(size=(2500, 64))).astype(np.float32)
    left = [sorted(draw.choice(2500, 8, replace=False).tolist()) for _ in range(2000)]
    order = [*range(0, 700), *range(720, 1200), *range(1500, 1600), *range(1200, 1500), *range(1600, 2000)]
    began = time.time()
    got = set(a.align_texts(np.eye(2500, dtype=np.float32), text(left, vectors), text([left[k] for k in order], vectors)))
    truth = {(k, at) for at, k in enumerate(order)}
    assert len(got & truth) / len(truth) > 0.99 and len(got & truth) / len(got) > 0.99
    assert time.time() - began < 60


def test_tally_counts():
    t = a.Tally(at_once=10)
    for k in range(100):
        t.add(0, np.array([k % 3]), np.array([k % 5]), np.arange(3), np.arange(5))
        t.add(1, np.array([1, 1]), np.array([0, 1]), np.array([0, 1]), np.array([2, 70_000]))
    rows = a._decoded(pd.concat([b.to_pandas() for b in t.batches(4)]))
    assert rows["n"].sum() == 300 and rows.set_index(["c", "i", "j"])["n"][1, 1, 2] == 100


def test_languages_are_those_of_the_codes_and_any_language_will_do(spark):
    bodies, sentences, truth = corpus(120)
    coded = [(*b[:3], {"primary": "mi-NZ", "translation": "xx"}[b[2]] if b[1] % 3 else None, *b[4:]) for b in bodies]
    pairs = a.document_pairs(spark.createDataFrame(coded, BODIES), spark.createDataFrame(sentences, SENTENCES)).collect()
    assert {(r.a_lang, r.b_lang) for r in pairs} == {("mi", "xx"), (None, None)}
    got = {tuple(r) for r in a.found(spark, spark.createDataFrame(coded, BODIES), spark.createDataFrame(sentences, SENTENCES)).collect()}
    assert len(got & truth) / len(truth) > 0.85 and any(lo // 2 % 3 == 0 for lo, *_ in got)


def test_rare_words_take_part(monkeypatch, spark):
    """With room for a few words only, the others share buckets, and names that both texts spell alike are matched."""
    monkeypatch.setattr(a, "VOCABULARY", 40)
    bodies, sentences, truth = corpus(200)
    pairs = a.document_pairs(spark.createDataFrame(bodies, BODIES), spark.createDataFrame(sentences, SENTENCES))
    vocab = a.vocabulary(pairs.withColumns({"a_lang": a.F.lit("en"), "b_lang": a.F.lit("de")}))
    assert all(len(w) == 40 for w in vocab.core.values()) and all(vocab.seen[x][40:].sum() > 0 for x in ("en", "de"))
    assert vocab.index("en", "neverseen") >= 40 and vocab.index("en", "12") == -1


def test_dirt_and_empty(spark):
    bodies = [(1, 1, "primary", "en", b"The court shall sit.", ""), (2, 1, "translation", None, b"", ""), (3, 2, "primary", None, None, ""), (4, 3, "translation", "de", b"Der Hof.", "")]
    sentences = [(1, 1, 0, 20), (2, 1, 0, 0), (4, 1, 0, 8), (9, 1, 0, 3)]
    assert a.found(spark, spark.createDataFrame(bodies, BODIES), spark.createDataFrame(sentences, SENTENCES)).count() == 0
    assert a.found(spark, spark.createDataFrame([], BODIES), spark.createDataFrame([], SENTENCES)).count() == 0
