"""The filter audit against a plain count over every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F

from tallyspark.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string"


def masks(rows, labels):
    """(part, failed filters, good, toxic) of each (doc_id, part, text)."""
    known = {}
    for i, q, t in labels:
        if i is not None:
            a, b = known.get(i, (-1, -1))
            known[i] = max(a, -1 if q is None else q), max(b, -1 if t is None else t)
    out = []
    for i, part, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (u or "") == text for j, _, u in rows),
        }
        q, t = known.get(i, (-1, -1))
        out.append((part or "", frozenset(f for f, bad in failed.items() if bad), q == 1, t == 1))
    return out


def plain_audit(rows, labels):
    found, out = masks(rows, labels), []
    for part in {p for p, *_ in found}:
        mine = [m for m in found if m[0] == part]
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [m for m in mine if f in m[1] and not m[1] & before]
                total[f] += len(here)
                steps.append((
                    f, "".join(order), k + 1, sum(not m[1] & (before | {f}) for m in mine), len(here),
                    sum(f in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {f} for m in mine),
                    sum(m[2] for m in here), sum(m[3] for m in here),
                ))
        out += [(part, *s[1:], total[s[0]]) for s in steps]
    return sorted(out)


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    *[(i, "en", t) for i, t in EDGES],
    *[(10 + i, ("en", "de", None)[i % 3], LONG) for i in range(9)],  # copies over parts
    (30, "de", LONG + " $"), (31, "de", LONG.upper()), (32, "en", "word " * 300), (33, "en", "word " * 300),
    (33, "en", "word " * 300), (None, "de", LONG), (None, "de", None), (40, None, "& A"), (41, None, "& A"), (5, "de", ""),
]
MARKS = [(10, 1, 0), (11, 0, 1), (12, 1, 1), (32, None, 1), (33, 1, None), (33, 0, 0), (None, 1, 1), (999, 1, 1), (40, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, p, t, "n", 3, 4, "x") for i, p, t in ROWS]
    # columns whose names the operator uses inside
    schema = "doc_id long, lang string, text string, part string, mask int, h long, lead string"
    labels = [(i, q, t, "clash") for i, q, t in MARKS]
    return spark.createDataFrame(docs, schema).repartition(4), spark.createDataFrame(labels, LABELS)


def result(counts):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in audit.audit(counts).select(names).collect())


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"hash_bits": 3}, {"hash_bits": 1, "broadcast_rows": 0}])
def test_audit_against_every_order(tables, options):
    """With long and short lists of repeats, and with hashes so short that different texts collide."""
    docs, labels = tables
    assert result(audit.mask_counts(docs, labels, **options)) == plain_audit(ROWS, MARKS)


def test_empty_tables(tables):
    docs, labels = tables
    assert result(audit.mask_counts(docs.where("false"), labels)) == []
    assert result(audit.mask_counts(docs, labels.where("false"))) == plain_audit(ROWS, [])


def test_no_repeat_is_cleared(spark):
    """All hashes that occur twice stay, whatever else shares their counters."""
    rows = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 3000, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    found = {r.h for r in audit.possible_repeats(rows.repartition(5), 20_000).collect()}
    repeated = {r.h for r in rows.groupBy("h").count().where("count > 1").collect()}
    assert repeated <= found and len(found - repeated) < 0.02 * 20_000
    crowded = {r.h for r in audit.possible_repeats(rows, 64).collect()}  # far too few counters
    assert repeated <= crowded
