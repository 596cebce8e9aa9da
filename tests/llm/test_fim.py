"""Fill-in-the-middle cuts against plain slicing, and the wavelet matrix against counting."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest_llm import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import fim

TEXT = st.text(alphabet=st.sampled_from("aé漢😀 \n\t.b"), max_size=40)


@given(st.lists(st.integers(0, 7), max_size=300))
@settings(max_examples=60, deadline=None)
def test_ranks_count(values):
    data = np.array(values, np.uint8)
    matrix = fim.WaveletMatrix(data, 3)
    at = np.arange(len(data) + 1)
    for v in range(8):
        assert matrix.rank(v, at).tolist() == [int((data[:i] == v).sum()) for i in at]


def starts_of(text, unit):
    """The characters at which units begin, one by one."""
    if unit == "char":
        return list(range(len(text)))
    blank = " \t\n\r\x0b\x0c"
    if unit == "word":
        return [i for i, c in enumerate(text) if c not in blank and (i == 0 or text[i - 1] in blank)]
    return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@given(texts=st.lists(TEXT, min_size=1, max_size=6), data=st.data())
@settings(max_examples=60, deadline=None)
def test_boundaries_against_plain_counts(unit, texts, data):
    places = fim.Boundaries([t.encode() for t in texts], unit)
    begins = [starts_of(t, unit) for t in texts]
    assert places.n.tolist() == [len(b) for b in begins]
    k = [data.draw(st.integers(0, len(b))) for b in begins]
    got = places.offsets(np.array(k))
    for text, b, n, offset in zip(texts, begins, k, got.tolist(), strict=True):
        end = 0 if n == 0 else len(text) if n == len(b) else b[n]
        assert offset == len(text[:end].encode())


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


MARKED = [(201, "holds <P> inside"), (202, "<M>"), (203, "<S"), (204, "ends in <"), (205, "<<<>>>PSM"), (2**53 + 1, "a large id")]


def test_transform_against_plain_slicing(spark, frame):
    rows = [*EDGES, *MARKED, *[(1000 + i, f"short {i} <{'é' * (i % 5)}> text\n{i}") for i in range(300)]]
    docs = frame(rows)
    out = fim.transform(docs).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in out), key=repr)
    assert got == sorted(((i, *plain(i, t)) for i, t in rows), key=repr)
    assert all(r.restored == r.text for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false")).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_between_units_and_restore(spark, frame, unit):
    docs = frame([(i, f"one two{' ' * (i % 3)}\nthree é{i}\n\nfour  ") for i in range(80)])
    for r in fim.transform(docs, unit=unit).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect():
        begins = starts_of(r.text, unit)
        assert r.restored == r.text and r.n == len(begins)
        if r.form != "plain":
            head = r.output.split("<P>")[1].split("<S>" if r.form == "psm" else "<M>")[0]
            assert len([b for b in begins if b < len(head)]) == r.prefix_units
