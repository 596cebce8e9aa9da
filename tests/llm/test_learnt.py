"""Toxicity network, compression classifier, page text, and the chain behind two of them."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F

from tallyspark.llm import compression, crf, html_text, pii, toxicity
from tallyspark.llm.common import labelled_sample, table

BAD = ["idiotic", "wretched", "stupidly"]


def toy_texts(seed, n):
    """(text, label): label 1 where one bad word stands somewhere in a longer text."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((" ".join(words) + ".", int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def net():
    return toxicity.fit(toy_texts(1, 300), steps=120, batch=32)


def test_network_learns_a_word_in_a_window(net):
    held = toy_texts(2, 150)
    scores = toxicity.score_texts(net, [t for t, _ in held])
    y = np.array([k for _, k in held])
    assert ((scores >= 0.5) == y).mean() > 0.97
    hidden = "plain words " * 400 + "idiotic " + "plain words " * 400
    assert toxicity.score_texts(net, [hidden])[0] > 0.5 > toxicity.score_texts(net, ["plain words " * 800])[0]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxicity.fit([], seed=3)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    p["out"] = rng.standard_normal(p["out"].shape)
    x = rng.standard_normal((9, toxicity.DIM))
    ids = rng.integers(0, 9, (3, 5))
    used = np.ones((5, 3), bool)
    used[3:, 1] = False
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        terms = {d: tuple(np.split(x @ p[f"in{d}"] + p[f"b{d}"], [2 * toxicity.HIDDEN], axis=1)) for d in "fb"}
        states = np.concatenate([slow_gru(*terms[d], ids, p[f"u{d}"], d == "b") for d in "fb"], axis=2)
        z = toxicity._pool(p, states, used)[0]
        return np.mean(np.log1p(np.exp(-z * (2 * y - 1))))

    def slow_gru(gates, news, ids, u, back):
        out = np.zeros((ids.shape[1], len(ids), toxicity.HIDDEN))
        for b in range(len(ids)):
            h = np.zeros(toxicity.HIDDEN)
            for t in reversed(range(ids.shape[1])) if back else range(ids.shape[1]):
                zr = 1 / (1 + np.exp(-(gates[ids[b, t]] + h @ u[:, : 2 * toxicity.HIDDEN])))
                z, r = np.split(zr, 2)
                n = np.tanh(news[ids[b, t]] + r * (h @ u[:, 2 * toxicity.HIDDEN :]))
                h = (1 - z) * n + z * h
                out[t, b] = h
        return out

    g = toxicity._gradients({k: v.astype(np.float32) for k, v in p.items()}, x.astype(np.float32), ids, used, y)
    for name, array in [*((k, p[k]) for k in ("inf", "uf", "bb", "ub", "att", "ask", "out", "bias")), ("x", x)]:
        for at in itertools.islice(np.ndindex(array.shape), 0, None, max(1, array.size // 7)):
            keep = array[at]
            array[at] = keep + 1e-5
            up = loss()
            array[at] = keep - 1e-5
            down = loss()
            array[at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=2e-4), (name, at)


def test_windows_cover_every_word():
    for counts in ([0, 1, 24, 25, 40, 41, 500], [3], [0]):
        start, end, owner = toxicity._windows(np.array(counts))
        first = np.cumsum(counts) - counts
        for d, n in enumerate(counts):
            mine = owner == d
            covered = {w for a, z in zip(start[mine], end[mine], strict=True) for w in range(a, z)}
            assert covered == set(range(first[d], first[d] + n))
            assert (start[mine][1:] < end[mine][:-1]).all()  # they overlap


def test_words_of_texts():
    texts = ["Ab, cd!! x1y", "", "12 ..", "é" * 40 + " no-break"]
    ids, words, counts = toxicity._read(texts)
    want = [toxicity._LETTERS.findall(t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert [words[i] for i in ids] == [w for ws in want for w in ws]


def test_toxicity_edges(frame, net):
    score = toxicity.scorer(net)
    got = {r.doc_id: r.s for r in frame(EDGES).select("doc_id", score("text").alias("s")).collect()}
    assert len(got) == len({i for i, _ in EDGES}) and all(0 <= s <= 1 for s in got.values())
    assert got[101] == got[102] == got[103] == 0.0
    assert frame(EDGES).where("false").select(score("text")).count() == 0
    for sample, least, most in (([], 0, 0.5), ([("fine", 0)], 0, 0.5), ([("vile", 1)], 0.5, 1)):
        assert least < toxicity.score_texts(toxicity.fit(sample), ["some text"])[0] < most


def test_sample_is_bounded_fixed_and_misses_held_out(frame, spark):
    rows = [(i, f"text number {i}") for i in range(200)] + [(500, None), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1), (None, 1), (7, None), (8, 1)], "doc_id long, toxic int")
    one = labelled_sample(frame(rows, 1), labels, "toxic", 5, 0, (20, 30), 100)
    assert one == labelled_sample(frame(rows, 7), labels.repartition(5), "toxic", 5, 0, (20, 30), 100)
    assert [y for _, y in one].count(0) == 20 and [y for _, y in one].count(1) == 29  # one has a null text
    ids = [int(t.split()[-1]) for t, _ in one]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert all(y == (1 if i == 8 else i % 2) for i, (_, y) in zip(ids, one, strict=True))
    assert labelled_sample(frame(rows), labels.where("false"), "toxic", 5, 0, (20, 30), 100) == []


def test_compression_separates_and_calibrates(frame):
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]

    def text(good):
        words = [rng.choice(stock) for _ in range(rng.randint(15, 200))]
        return " ".join(w if good else w.upper() + "##" for w in words)

    judge = compression.fit([(text(i % 2), i % 2) for i in range(300)])
    rows = [(1000 + i, text(i % 2)) for i in range(100)] + EDGES
    got = {r.doc_id: r.s for r in frame(rows).select("doc_id", compression.scorer(judge)("text").alias("s")).collect()}
    assert np.mean([(got[1000 + i] >= 0.5) == (i % 2) for i in range(100)]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[101] == got[102]
    for sample in ([], [("only good", 1)], [("only bad", 0)]):
        lone = compression.fit(sample)
        x = float(compression.Scale(lone.good, lone.bad).terms("any text") @ np.array(lone.curve))
        assert (x > 0) - (x < 0) == sum(2 * y - 1 for _, y in sample)


def test_viterbi_and_fit_against_enumeration():
    rng = np.random.default_rng(2)
    trans, first = rng.standard_normal((3, 3)), rng.standard_normal(3)
    e, lengths = rng.standard_normal((6, 5, 3)), np.array([5, 1, 3, 4, 2, 5])
    best = crf.viterbi(e, lengths, trans, first)
    for i, n in enumerate(lengths):
        score = lambda ys: first[ys[0]] + sum(e[i, t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in itertools.pairwise(ys))  # noqa: E731, B023
        assert tuple(best[i, :n]) == max(itertools.product(range(3), repeat=int(n)), key=score)
    # a label that only the label before it tells
    table = [([["a"], ["x"], ["x"]], ["A", "A", "A"]), ([["b"], ["x"], ["x"]], ["B", "B", "B"])]
    chain = crf.fit_chain(table, ("A", "B"), steps=150)
    for xs, ys in table:
        em = np.array([chain.emission(x) for x in xs])
        assert [chain.labels[y] for y in crf.decode(chain, em, np.array([3]))] == ys


def whole(chain, emissions, counts):
    """Viterbi over each whole sequence, one at a time."""
    out, at = [], 0
    for n in counts.tolist():
        if n:
            out += crf.viterbi(emissions[None, at : at + n], np.array([n]), chain.trans, chain.first)[0].tolist()
        at += n
    return out


@pytest.mark.parametrize("strength", [0.3, 2.0, 8.0])
@pytest.mark.parametrize("cells", [1, 40, 100_000])
def test_decoding_equals_the_path_over_whole_sequences(strength, cells):
    """From sequences without a certain position to ones that certain positions cut everywhere."""
    rng = np.random.default_rng(4)
    for k in (2, 3, 11):
        chain = crf.Chain(tuple(map(str, range(k))), {}, rng.normal(0, 1, (k, k)), rng.normal(0, 1, k))
        counts = rng.integers(0, 200, 30)
        counts[3], counts[7] = 1500, 0
        e = rng.normal(0, strength, (counts.sum(), k))
        e[:, 0] += strength
        assert crf.decode(chain, e, counts, cells).tolist() == whole(chain, e, counts)
    assert crf.decode(chain, np.zeros((0, k)), np.array([0, 0])).tolist() == []


def test_texts_and_pages_decode_as_a_whole(spark, monkeypatch):
    """The fitted chains on all documents and pages, against whole Viterbi."""
    seen = []
    plain = crf.decode

    def both(chain, emissions, counts, **kw):
        got = plain(chain, emissions, counts, **kw)
        seen.append((got.tolist(), whole(chain, np.asarray(emissions, np.float64), counts)))
        return got

    monkeypatch.setattr(pii, "decode", both)
    monkeypatch.setattr(html_text, "decode", both)
    docs = [r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    pii._added(pii.learn(), {}, docs)
    html_text.main_texts(html_text.learn(), [r.html or "" for r in table(spark, "/root/testdata/sf0.01", "pages").collect()])
    for got, want in seen:
        assert len(got) > 1000 and got == want


@pytest.fixture(scope="module")
def page_chain():
    return html_text.learn()


HELD_OUT = {
    "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>bold</b>er\n\n word.<br>Two&nbsp;three.<p>Last one.</article>"
    "<div class='comments'><p>First! Nice text.</p></div><footer>&copy; us</footer></body>": "A & B One bolder word. Two three. Last one.",
    "<html><script>var t='</p><article>no';</script><style>p{}</style><div class=ad>Buy this now, it is cheap.</div>"
    "<article><p>Cut off here": "Cut off here",
    "<body><header><p>Our paper.</p></header><main><h2>Title</h2><p>Body text, with a comma.</p><ul><li>x<li>y</ul></main>"
    "<aside><p>Related things to read.</p></aside><form><p>Search here</p></form></body>": "Title Body text, with a comma. x y",
    "": "", "<!-- only a comment": "", "<p": "", "<nav>menu</nav>": "",
}


def test_pages(frame, page_chain):
    pages = list(HELD_OUT)
    assert html_text.main_texts(page_chain, pages) == list(HELD_OUT.values())
    df = frame(list(enumerate(pages)) + [(99, None), (98, "<p>" * 3000 + "deep")])
    got = {r.doc_id: r.t for r in df.select("doc_id", html_text.extractor(page_chain)("text").alias("t")).collect()}
    assert got[99] == "" and all(got[i] == HELD_OUT[p] for i, p in enumerate(pages))
    assert df.where("false").select(html_text.extractor(page_chain)("text")).count() == 0


def test_labelled_pages_are_learnt(page_chain):
    for page in html_text.LABELLED:
        want = " ".join(b.text for b in html_text.leaf_blocks(page) if b.labelled)
        assert html_text.main_texts(page_chain, [page]) == [want]


def test_pages_of_the_tables(spark, page_chain):
    """Against the article cut out by a pattern, which works on the test pages."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for (page,), got in zip(rows, html_text.main_texts(page_chain, [r.html for r in rows]), strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", article)]
        assert got == " ".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


def test_scores_are_columns(frame, net):
    df = frame([(1, "x"), (2, "y")]).withColumn("s", toxicity.scorer(net)("text"))
    assert df.where(F.col("s") < 2).count() == 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>First one here.</p><svg class=i /><p>Rest of the article.</p></article>", "First one here. Rest of the article."),
        ("<article><p>First one here.</p><svg class=i><p>Rest of the article.</p></article>", "First one here. Rest of the article."),
        ("<article><p>First one here.</p><svg><title>icon</title><path d=1></svg><p>Rest of it.</p></article>", "First one here. Rest of it."),
        ("<article><h1>Title here</h1><title-bar>..</title-bar><p>Second one follows.</p></article>", "Title here .. Second one follows."),
        ("<article><p>So <math><mi>x</mi> + 1</math> is more than one.</p></article>", "So x + 1 is more than one."),
        ("<article><div><video src=a></div><p>Text after an open video.</p></article>", "Text after an open video."),
        ("<article><p>Before.</p><div><title>lost</div><p>After an open title.</p></article>", "Before. After an open title."),
        ("<article><p>Before it all.</p><script>if (a < b) { x = '<p>'; }</script><p>After it.</p></article>", "Before it all. After it."),
        ("<article><p>Kept text here.</p><object data=x><p>What the object shows.</p></object></article>", "Kept text here. What the object shows."),
        ("<article><p>Kept text here.</p><script>never ended <p>code</p></article>", "Kept text here."),
        ("<article><p>One.</p><select><option>a<p>Two of them.</p></article>", "One. Two of them."),
    ],
)
def test_elements_left_open_lose_nothing_behind_them(page, want):
    assert html_text.main_texts(html_text.learn(), [page]) == [want]
