from __future__ import annotations

import math
from collections import Counter

import pytest
import sentencepiece
from conftest_llm import EDGES

from tallyspark.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.load()


def all_segmentations(text):
    """Every piece sequence of a text with its probability, by enumeration."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    n = sp.vocab_size()
    ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    octets = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
    rank = lambda i: -sp.get_score(i) if sp.get_score(i) > -1e8 else 0
    found = []

    def walk(rest, path, weight):
        if not rest:
            found.append((tuple(path), weight))
            return
        for z in range(1, len(rest) + 1):
            if rest[:z] in ids:
                i = ids[rest[:z]]
                walk(rest[z:], [*path, i], weight - math.log(2 + rank(i)))
        if rest[0] not in ids:
            spelt = [octets[b] for b in rest[0].encode()]
            walk(rest[1:], path + spelt, weight - len(spelt) * math.log(n))

    walk(pieces.marked(text), [], 0.0)
    total = sum(math.exp(w) for _, w in found)
    return {p: math.exp(w) / total for p, w in found}


@pytest.mark.parametrize("text", ["the cat", "ñ 漢\n a", "aa  b"])
def test_samples_follow_the_distribution(vocab, text):
    want = all_segmentations(text)
    store, n = pieces.Store(vocab), 4000
    first, both = Counter(), Counter()
    for samples in pieces._slice_samples(store, list(range(n)), [text] * n, 2):
        paths = [tuple(s[3].tolist()) for s in samples]
        assert len(set(paths)) == len(paths) == min(2, len(want))
        for (log_p, _, _, _), path in zip(samples, paths, strict=True):
            assert math.exp(log_p) == pytest.approx(want[path], rel=1e-3)
        first[paths[0]] += 1
        both[tuple(paths)] += 1
    for p, q in want.items():
        assert abs(first[p] / n - q) < 4 * math.sqrt(q / n) + 0.003
    for (a, b), seen in both.items():
        q = want[a] * want[b] / (1 - want[a])
        assert abs(seen / n - q) < 4 * math.sqrt(q / n) + 0.003


def test_inclusion_weights_are_unbiased(vocab):
    """Sums weighted by 1 / inclusion estimate sums over all segmentations (here: the number 1)."""
    store, n = pieces.Store(vocab), 3000
    total = 0.0
    for samples in pieces._slice_samples(store, list(range(n)), ["the cat"] * n, 3):
        total += sum(math.exp(log_p) / inclusion for log_p, _, inclusion, _ in samples)
    assert total / n == pytest.approx(1.0, abs=0.03)


def test_all_segmentations_of_a_short_text(vocab):
    want = all_segmentations("ab")
    (samples,) = pieces._slice_samples(pieces.Store(vocab), [1], ["ab"], 50)
    assert {tuple(s[3].tolist()) for s in samples} == set(want)
    assert all(s[2] == 1.0 for s in samples)
    values = [s[1] for s in samples]
    assert values == sorted(values, reverse=True)


def test_edges_and_round_trip(frame, vocab):
    docs = frame(EDGES, parts=2)
    got = pieces.sample_encodings(docs).collect()
    assert all(r.decodes for r in got)
    count = Counter(r.doc_id for r in got)
    assert count[101] == count[102] == 1 and count[105] == 2 and count[106] == 4 and count[None] == 2
    assert all(r.ids == [] and r.inclusion == 1.0 for r in got if r.doc_id in (101, 102))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = dict(EDGES)
    for r in got:
        if r.doc_id in (None, 103, 104, 106, 108):
            assert sp.decode(r.ids) == texts[r.doc_id]
    by_id = lambda rows: Counter((r.doc_id, r.sample, tuple(r.ids)) for r in rows)
    assert by_id(got) == by_id(pieces.sample_encodings(frame(EDGES, parts=5)).collect())  # seeded by the row's key
    assert pieces.sample_encodings(docs.where("false")).count() == 0


def test_store_starts_anew(vocab, monkeypatch):
    texts = [f"word{i} other{i}" for i in range(50)]
    want = [list(map(lambda s: s[3].tolist(), r)) for r in pieces._slice_samples(pieces.Store(vocab), list(range(50)), texts, 2)]
    monkeypatch.setattr(pieces, "STORE_EDGES", 10)
    store, got = pieces.Store(vocab), []
    for i in range(50):
        got += [[s[3].tolist() for s in r] for r in pieces._slice_samples(store, [i], [texts[i]], 2)]
    assert got == want


def samples_of(vocab, texts, k):
    return [[s[3].tolist() for s in r] for r in pieces._slice_samples(pieces.Store(vocab), list(range(len(texts))), texts, k)]


def test_rounds_do_not_grow_with_the_texts(vocab, monkeypatch):
    """All texts of a slice are searched at once; a search text by text hashes several times for each."""
    calls, hashed = [], pieces.uniform
    monkeypatch.setattr(pieces, "uniform", lambda *a: calls.append(1) or hashed(*a))

    def rounds(n):
        calls.clear()
        samples_of(vocab, ["the cat sat on the mat"] * n, 2)
        return len(calls)

    assert rounds(800) < 2 * rounds(40)


MIXED = ["", "a", "the cat sat on the mat\n\nand the cat", "  ", "ñandú 漢字 漢 🙂🙂\n x", "\n", "aaaaaaaaaaaaaaaaaaaaaaaa " * 40, "the cat", "▁ word", "\u0000\u0001 x"]
PINNED = [[0], [264, 86121], [240291, 207394, 211245], [57669, 2287, 29223], [2200981, 2241348, 3240083], [28731], [341556345, 343898528, 343202665], [76498, 2702, 1636], [91236, 3673, 64227], [122585, 375853]]


def test_samples_stay_as_they_were(vocab):
    """Pinned: the sums were taken from the search text by text that this one replaced."""
    sums = [[sum((i + 1) * p for i, p in enumerate(s)) for s in r] for r in samples_of(vocab, MIXED, 3)]
    assert sums == PINNED


def test_chunks_of_one_hash_are_told_apart(vocab, monkeypatch):
    want = samples_of(vocab, MIXED, 3)
    hashes = pieces.Store.hashes
    monkeypatch.setattr(pieces.Store, "hashes", lambda *a: hashes(*a) % 3 + 1)
    assert samples_of(vocab, MIXED, 3) == want


def test_table_of_chunks_grows(vocab, monkeypatch):
    texts = [f"w{i} x{i * 7} w{i // 2}" for i in range(300)]
    want = samples_of(vocab, texts, 2)
    monkeypatch.setattr(pieces.Store, "SLOTS", 4)
    assert samples_of(vocab, texts, 2) == want


def test_scoring_goes_as_far_as_needed(vocab, monkeypatch):
    """However few steps are scored first, the samples and the value after them stay the same."""
    texts = ["the cat sat on the mat and the dog sat on the log " * 30, "a" * 300, "the cat"]

    def all_values():
        return [[s[:3] for s in r] for r in pieces._slice_samples(pieces.Store(vocab), [1, 2, 3], texts, 6)]

    monkeypatch.setattr(pieces.Search, "STEPS", 100_000)
    want = all_values()
    monkeypatch.setattr(pieces.Search, "STEPS", 1)
    assert all_values() == want
