from __future__ import annotations

import random
from collections import Counter

from conftest_llm import EDGES

from tallyspark.llm import decontam


def slow_distance(item, text):
    """Least edit distance of item to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def spoilt(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("xyz")]
    return "".join(out)


def test_against_full_table(frame, spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(2, 14))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "abc")]
    rows = [(200 + i, sentence(rng, 30)) for i in range(8)]
    for i in range(40):
        item = items[rng.randrange(12)][1]
        edits = rng.randint(0, decontam.budget(len(item)) + 2)
        rows.append((300 + i, f"{sentence(rng, 6)}\n{spoilt(rng, item, edits).upper()}, {sentence(rng, 6)}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.matches(frame(rows), table).collect())
    want = Counter()
    for key, text in rows:
        for item_id, item in items:
            m = decontam.normalise(item or "")
            if m and (d := slow_distance(m, decontam.normalise(text))) <= decontam.budget(len(m)):
                want[key, item_id, d] += 1
    assert got == want and len(want) > 20


def test_span_is_where_the_item_is():
    matcher = decontam.Matcher([(1, "the quick brown fox jumps over the lazy dog again")])
    text = "nothing here. The quick brwn fox jumps over the lazy dog, again! nothing more"
    ((key, distance, allowed, start, end),) = matcher.find(text)
    assert (key, distance, allowed) == (1, 1, 3)
    assert decontam.normalise(text)[start:end] == "the quick brwn fox jumps over the lazy dog again"


def test_edges(frame, spark):
    items = spark.createDataFrame([(1, "word7 and then word8 and then"), (2, "twice the same row")], "item_id long, text string")
    docs = frame(EDGES)
    got = Counter((r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect())
    assert got == {(105, 1): 1, (106, 2): 2}
    clean = decontam.without_items(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in EDGES if i not in (105, 106))
    none = items.where("false")
    assert decontam.matches(docs, none).count() == 0
    assert decontam.without_items(docs, none).count() == len(EDGES)
    assert decontam.matches(docs.where("false"), items).count() == 0


def test_blocks_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([(i, f"item number {i}") for i in range(30)], "item_id long, text string")
    parts = list(decontam.blocks(items))
    assert len(parts) > 5 and sorted(k for p in parts for k, _ in p) == list(range(30))
