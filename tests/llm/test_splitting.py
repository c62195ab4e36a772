import random
import re

from lawlake.llm import bpe, splitting as s

SCHEMA = "doc_id bigint, text string, pieces string"


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 9)))
    out = [None, "", "short", "word " * 64, "x" * 3000, "中" * 900, "a😀é" * 500, "\n" * 700, " " * 3000, "no stop " * 400, "It holds. Ää " * 4000]
    for _ in range(25):
        out.append("".join(word() + rnd.choice([" ", " ", " ", ", ", ". ", ".\n", "\n\n", "! ", "。", "\n \n"]) for _ in range(rnd.randrange(20, 900))))
    return out


def test_pieces(spark):
    enc = bpe.Encoder(bpe.default_vocabulary())
    limit, overlap = 64, 8
    rows = list(enumerate(texts()))
    got = s.split(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), limit, overlap).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        n = bpe.count_batch(enc, [t])[0]
        assert (i in by) == (n > limit), (i, n)
        if n <= limit:
            continue
        raw, end = t.encode(), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece_no)):
            assert r.piece_no == k + 1 and 1 <= r.n_tokens <= limit
            assert raw[r.byte_start : r.byte_end].decode() == r.piece  # never inside a character
            assert r.byte_start <= end < r.byte_end  # no gap, always new text
            assert r.overlap_tokens == 0 if k == 0 else overlap - 3 <= r.overlap_tokens <= overlap
            end = r.byte_end
        assert end == len(raw)
        last = max(r.piece_no for r in by[i])
        for r in by[i]:
            if r.boundary == "s" and r.piece_no < last:
                assert re.search(r"[.!?…。！？][\"'”’»)\]]*$", r.piece)
            if r.boundary == "p" and r.piece_no < last:
                assert r.piece.rstrip(" ").endswith("\n")


def test_stronger_boundaries_win(spark):
    para = "One two three four five six seven. " * 3
    text = (para.strip() + "\n\n") * 6
    got = s.split(spark.createDataFrame([(1, text, "")], SCHEMA), 64, 0).collect()
    assert {r.boundary for r in got if r.piece_no < len(got)} == {"p"}
    assert "".join(r.piece for r in sorted(got, key=lambda r: r.piece_no)) == text


def test_letters_agree_with_tokens():
    enc = bpe.Encoder(bpe.default_vocabulary())
    spell = s.Letters(enc)
    for t in filter(None, texts()):
        words = bpe._SPLIT.findall(t)
        letters, starts = spell.of_text(words)
        assert len(letters) == bpe.count_batch(enc, [t])[0] and starts[-1] == len(t.encode())
        raw = t.encode()
        for k, c in enumerate(letters):
            inside = starts[k + 1] < len(raw) and raw[starts[k + 1]] & 0xC0 == 0x80
            assert (c == "n") == inside


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert s.split(df).count() == 0
    try:
        s.split(df, 10, 10)
        raise AssertionError
    except ValueError:
        pass
