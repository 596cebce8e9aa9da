from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest_llm import EDGES

from tallyspark.llm import substrings


def slow(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out[key, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
    return out


def fast(df, window):
    rows = substrings.remove_repeats(df, window).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows)


def corpus(seed, n):
    rng = random.Random(seed)
    passage = [f"p{rng.randrange(50)}" for _ in range(60)]
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(120))]
        if i % 3 == 0:
            a = rng.randrange(20)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.randint(30, 40)]
        rows.append((200 + i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(900, "same " * 70), (901, rows[0][1]), (902, "  no-break  space " * 3)]
    return rows


def test_production_window(frame):
    rows = corpus(1, 90) + EDGES
    assert fast(frame(rows), 35) == slow(rows, 35)


@pytest.mark.parametrize("buckets", [50_000, 3])
def test_many_groups_and_ranges(frame, monkeypatch, buckets):
    monkeypatch.setattr(substrings, "MAX_BUCKETS", buckets)
    """Small bounds: many groups and ranges, and a sketch so narrow that it passes much in vain."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(substrings, "RANGE_ENTRIES", 500)
    monkeypatch.setattr(substrings, "CELLS", 0.5)
    rows = corpus(2, 80)
    assert fast(frame(rows), 5) == slow(rows, 5)


def test_empty(frame):
    assert substrings.remove_repeats(frame([(1, "x")]).where("false")).count() == 0


def test_packing_round_trip():
    import numpy as np

    values = np.unique(np.random.default_rng(1).integers(0, 2**62, 1000).astype(np.uint64))
    assert (substrings._unpacked(substrings._packed(values)) == values).all()
    assert len(substrings._unpacked(substrings._packed(values[:0]))) == 0
