"""Token counts against the library of the vocabulary file."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import EDGES

from tallyspark.llm import tokens
from tallyspark.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def known():
    return tokens.Tokenizer.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in found.encode_batch(list(texts), add_special_tokens=False)]


def adversarial():
    rng = random.Random(3)
    signs = [
        "'", "s", "t", "re", "ve", "ll", "m", "d", "r", "v", "l", " ", "  ", "\n", "\t", " ", "　", "a", "B", "1",
        "²", "٣", "é", "漢", "\U0001f600", "!", "<|endoftext|>", "<|endof", "́", "\x85", "​", "\x00",
        "\x1c", "ǅ", "-", "'S", " '", "͸", "Ɤ",
    ]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(15_000)]
    out += ["a" * 5000, "ab" * 3000, " " * 999, "\n" * 77 + "x", "!" * 5000, "'" * 300, "é" * 2000]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(1500)]
    return out + [bytes(rng.choice(range(256)) for _ in range(30)).decode("latin1") for _ in range(1500)]


def test_counts_equal_the_library(known, library, spark):
    texts = adversarial() + [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    counter = tokens.Counter(known)
    got = np.concatenate([counter.counts(part) for part in tokens.slices(texts)]).tolist()
    bad = [(t[:60], g, w) for t, g, w in zip(texts, got, library(texts), strict=True) if g != w]
    assert not bad, bad[:5]


def test_stores_start_anew_at_their_size(known, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_STATES", 50)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    texts = adversarial()[:800]
    counter = tokens.Counter(known)
    assert counter.counts(texts).tolist() == library(texts)
    assert len(counter) <= 20


def test_marks_do_not_hang_on_chunks():
    """Composed chunk maps against one character after another."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300, 1000):
        classes = rng.integers(0, tokens.N_CLASSES, n).astype(np.uint8)
        state, want = tokens.START, []
        for c in classes.tolist():
            want.append(int(tokens.MARKS[state * tokens.N_CLASSES + c]))
            state = int(tokens.NEXT[state * tokens.N_CLASSES + c])
        for chunk in (1, 2, 7, 64, 5000):
            assert tokens.marks(classes, chunk).tolist() == want


def test_word_transducer_equals_merging(known):
    words = tokens.WordTransducer(known)
    rng = random.Random(5)
    for _ in range(2000):
        word = bytes(rng.choice(b"etaoin shr\xc3\xa9") for _ in range(rng.randint(1, 12)))
        assert words.count(word) == len(words.merged(word))


def test_agreement_equals_merging_both(known):
    words = tokens.WordTransducer(known)
    rng = random.Random(6)
    some = [t for t in rng.sample(known.tokens, 400) if len(t) < 12] + [b"a", b"aa", b"aaaa", b"--", b"----", b"....", b"oo"]
    some = [t for t in some if words.merged(t) == [t]]  # some tokens, as runs of spaces, no merge can make
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert words.agrees(a, b) == (words.merged(a + b) == [a, b]), (a, b)


def test_frame(spark, frame, known, library):
    docs = frame(EDGES)
    rows = tokens.token_counts(docs, known).collect()
    want = sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(EDGES, library(t or "" for _, t in EDGES), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert tokens.token_counts(docs.where("false"), known).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Tokenizer.load(public_tokenizers.path("word_bpe_49k.json"))
