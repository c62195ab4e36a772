import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lawlake.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_that_of_the_vocabulary():
    assert bpe.PATTERN == P.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(enc, oracle, text):
    assert bpe.encode_batch(enc, [text]).to_pylist() == [oracle.encode_ordinary(text)]


def test_random_words(enc, oracle):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdeinorst  éßü中一ก\n1") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["a" * n for n in range(300)] + ["<|endoftext|>", "ab" * 20_000, "=" * 5000, "  \n\n\n  x"]
    assert bpe.encode_batch(enc, texts).to_pylist() == [oracle.encode_ordinary(t) for t in texts]
    assert bpe.count_batch(enc, texts) == [len(oracle.encode_ordinary(t)) for t in texts]


def test_speculation_is_verified_not_trusted(enc):
    before = enc.exact_merges
    enc.encode_words([" the", " of"])
    assert enc.exact_merges == before  # single tokens need no merging
    assert all(bpe.encoder(bpe.default_vocabulary()).ids[b] == t for b, t in list(enc.ids.items())[:300])


def test_rows_and_dirt(spark, oracle):
    df = spark.createDataFrame([(1, "Act 5", 0), (1, "Act 5", 0), (2, "", 0), (3, None, 0), (None, "x", 0), (4, " \n ", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect()), key=str)
    ids = oracle.encode_ordinary
    assert got == sorted([(1, ids("Act 5")), (1, ids("Act 5")), (2, []), (3, []), (None, ids("x")), (4, ids(" \n "))], key=str)
    counted = {(r.doc_id, r.n_tokens) for r in bpe.token_counts(df).collect()}
    assert (3, None) in counted and (2, 0) in counted
    assert bpe.encode(df.limit(0)).count() == 0
