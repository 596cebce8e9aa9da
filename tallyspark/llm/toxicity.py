"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a word: an embedding of the word (words seen often enough in the fit, else a shared
one) plus the embeddings of its hashed character trigrams. Windows of ``WINDOW`` words
overlap and cover the whole text; each is scored, and a text's score is that of its
worst window. The network is fitted in numpy on a bounded labelled sample: a text's label is
taken for its worst window, every window being scored first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import labelled_sample, sigmoid, slices, strings

WINDOW, STRIDE = 24, 16
DIM, HIDDEN, ATTEND = 12, 6, 6
TRIGRAMS, PIECE = 2048, 16
#: Bounds of the labelled sample: rows of label 0 and 1, and characters of a text.
SAMPLE, SAMPLE_CHARS = (1200, 1200), 6_000
LABEL_BUCKETS, LABEL_HELD_OUT = 5, 0
BLOCK = 1024

# Longer runs of letters are read as several words, so no letter is left out.
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % PIECE)


@dataclass
class Network:
    """``vocab`` maps words to rows of ``p['word']``; row 0 is for all other words."""

    vocab: dict[str, int]
    p: dict[str, np.ndarray]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram rows of each word with its edges marked, and their weights."""
    codes = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE).astype(np.int64)
    length = (codes > 0).sum(1)
    framed = np.zeros((len(words), PIECE + 2), np.int64)
    framed[:, 1:-1] = codes
    framed[:, 0] = 1
    framed[np.arange(len(words)), length + 1] = 2
    mixed = (framed[:, :-2] * 1_000_003 + framed[:, 1:-1] * 10_007 + framed[:, 2:]) * 2_654_435_761
    used = np.arange(PIECE) < length[:, None]
    rows = np.where(used, (mixed >> 15) % TRIGRAMS, 0)
    return rows, (used / np.sqrt(np.maximum(length, 1))[:, None]).astype(np.float32)


def _inputs(net: Network, words: list[str]) -> np.ndarray:
    rows, weights = _letters(words)
    known = np.fromiter((net.vocab.get(w, 0) for w in words), np.int64, len(words))
    return net.p["word"][known] + np.einsum("vkd,vk->vd", net.p["tri"][rows], weights)


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every window over texts of ``counts`` words laid end to end."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    n[counts == 0] = 0
    owner = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = first[owner] + STRIDE * step
    return start, np.minimum(start + WINDOW, (first + counts)[owner]), owner


def _gru(gates: np.ndarray, news: np.ndarray, ids: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None):
    """Hidden states (WINDOW, windows, HIDDEN); ``gates`` and ``news`` hold each word's input terms."""
    h = np.zeros((len(ids), HIDDEN), np.float32)
    u_gates, u_news = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    out = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32)
    for t in range(ids.shape[1] - 1, -1, -1) if back else range(ids.shape[1]):
        at = ids[:, t]
        zr = gates.take(at, axis=0)
        zr += h @ u_gates
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1.0
        zr *= 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        hu = h @ u_news
        n = r * hu
        n += news.take(at, axis=0)
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n, hu))
        h = h - n
        h *= z
        h += n
        out[t] = h
    return out


def _terms(p: dict, x: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray]:
    proj = (x @ p[f"in{d}"] + p[f"b{d}"]).astype(np.float32)
    return np.ascontiguousarray(proj[:, : 2 * HIDDEN]), np.ascontiguousarray(proj[:, 2 * HIDDEN :])


def _pool(p: dict, states: np.ndarray, used: np.ndarray):
    """Attention over the used positions; the logit of each window and what the gradient needs."""
    a = np.tanh(states @ p["att"])
    e = np.where(used, a @ p["ask"], -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (states * w[:, :, None]).sum(0)
    return pooled @ p["out"] + p["bias"][0], (a, w, pooled)


def _states(p: dict, terms: dict, ids: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    both = [_gru(*terms[d], ids, p[f"u{d}"], d == "b", keep and keep[i]) for i, d in enumerate("fb")]
    return np.concatenate(both, axis=2)


def _layout(start: np.ndarray, end: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    used = at < end[:, None]
    return np.where(used, ids[np.minimum(at, len(ids) - 1)], pad), used.T


def _read(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word numbers of all texts end to end, the distinct words, and the words of each text.

    Tokens are cut at white space first; only distinct ones are cut into runs of letters.
    """
    tokens = [t.lower().split() for t in texts]
    flat = [w for ws in tokens for w in ws]
    of_token, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    runs = [_LETTERS.findall(w) for w in distinct]
    n_runs = np.fromiter(map(len, runs), np.int64, len(runs))
    numbers, words = pd.factorize(np.array([w for r in runs for w in r] or [""], dtype=object))
    first = np.cumsum(n_runs) - n_runs
    n = n_runs[of_token]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = numbers[np.repeat(first[of_token], n) + step]
    ends = np.cumsum([len(ws) for ws in tokens])
    total = np.concatenate([[0], np.cumsum(n)])
    return ids, list(words), np.diff(total[ends], prepend=0)


def window_logits(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text number of every window of ``texts``."""
    ids, words, counts = _read(texts)
    start, end, owner = _windows(counts)
    out = np.empty(len(start), np.float32)
    if not len(ids):
        return out, owner
    x = np.concatenate([_inputs(net, words), np.zeros((1, DIM), np.float32)])
    terms = {d: _terms(net.p, x, d) for d in "fb"}
    for k in range(0, len(start), BLOCK):
        rows, used = _layout(start[k : k + BLOCK], end[k : k + BLOCK], ids, len(words))
        out[k : k + BLOCK] = _pool(net.p, _states(net.p, terms, rows), used)[0]
    return out, owner


def score_texts(net: Network, texts: list[str]) -> np.ndarray:
    """The worst window's probability for each text; 0 for a text without a letter."""
    logits, owner = window_logits(net, texts)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, owner, logits)
    return sigmoid(worst)


def _gradients(p: dict, x: np.ndarray, ids: np.ndarray, used: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean logistic loss over windows ``ids`` (rows of ``x``), and of ``x``."""
    keep: tuple[list, list] = ([], [])
    states = _states(p, {d: _terms(p, x, d) for d in "fb"}, ids, keep)
    logit, (a, w, pooled) = _pool(p, states, used)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = (sigmoid(logit) - y) / len(y)
    g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * p["out"]
    d_states = w[:, :, None] * d_pooled
    d_w = (states * d_pooled).sum(2)
    d_e = w * (d_w - (w * d_w).sum(0))
    g["ask"] = np.einsum("tba,tb->a", a, d_e)
    d_a = d_e[:, :, None] * p["ask"] * (1 - a * a)
    g["att"] = np.einsum("tbs,tba->sa", states, d_a)
    d_states = d_states + d_a @ p["att"].T
    d_x = np.zeros_like(x)
    for i, name in enumerate("fb"):
        u, d_h = p[f"u{name}"], np.zeros((len(ids), HIDDEN), np.float32)
        d_own = d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN]
        for t, h, z, r, n, hun in reversed(keep[i]):
            d_h = d_h + d_own[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * hun * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_n], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"u{name}"] += h.T @ d_hu
            g[f"b{name}"] += d_in.sum(0)
            g[f"in{name}"] += x[ids[:, t]].T @ d_in
            np.add.at(d_x, ids[:, t], d_in @ p[f"in{name}"].T)
            d_h = d_h * z + d_hu @ u.T
    g["x"] = d_x
    return g


def _lean(net: Network, sample: list[tuple[str, int]], df: Counter) -> None:
    """Start the first embedding entry of known words at how much they lean to label 1."""
    toxic = Counter(w for t, y in sample if y for w in set(_LETTERS.findall(t.lower())))
    share = sum(y for _, y in sample) / max(len(sample), 1)
    net.p["word"][0, 0] = 0
    for w, row in net.vocab.items():
        expected = share * df[w]
        net.p["word"][row, 0] = 0.5 * (toxic[w] - expected) / np.sqrt(expected + 1)


def fit(sample: list[tuple[str, int]], steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network on (text, label) rows; Adam, fixed seed.

    A sample of one label tells nothing: all texts then score alike, below one half unless all rows are toxic.
    """
    rng = np.random.default_rng(seed)
    found = [(t, y) for t, y in sample if _LETTERS.search(t)]
    df = Counter(w for t, _ in found for w in set(_LETTERS.findall(t.lower())))
    least = min(8, max(3, len(found) // 150))
    vocab = {w: i for i, w in enumerate((w for w, n in sorted(df.items()) if n >= least), 1)}
    s = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"word": s(len(vocab) + 1, DIM), "tri": s(TRIGRAMS, DIM), "att": s(2 * HIDDEN, ATTEND), "ask": s(ATTEND), "out": s(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"in{d}": s(DIM, 3 * HIDDEN), f"u{d}": s(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    net = Network(vocab, p)
    _lean(net, found, df)
    m, v = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}
    if len({y for _, y in found}) < 2:
        p["out"][:] = 0
        p["bias"][:] = 2.0 if found and found[0][1] else -2.0
        return net
    queue = np.concatenate([rng.permutation(len(found)) for _ in range(-(-steps * batch // len(found)))])
    for step in range(1, steps + 1):
        docs = [found[i] for i in queue[(step - 1) * batch : step * batch]]
        ids, distinct, counts = _read([t for t, _ in docs])
        start, end, owner = _windows(counts)
        x = np.concatenate([_inputs(net, distinct), np.zeros((1, DIM), np.float32)])
        rows, used = _layout(start, end, ids, len(distinct))
        logits = _pool(p, _states(p, {d: _terms(p, x, d) for d in "fb"}, rows), used)[0]
        worst = pd.Series(logits).groupby(owner).idxmax().to_numpy()
        y = np.array([y for _, y in docs], np.float32)
        g = _gradients(p, x, rows[worst], used[:, worst], y)
        d_x = g.pop("x")[:-1]
        letters, weights = _letters(distinct)
        g["word"], g["tri"] = np.zeros_like(p["word"]), np.zeros_like(p["tri"])
        np.add.at(g["word"], np.fromiter((vocab.get(w, 0) for w in distinct), np.int64), d_x)
        np.add.at(g["tri"], letters, weights[:, :, None] * d_x[:, None, :])
        lr = rate * (1 - 0.9 * step / steps)
        for name, value in p.items():
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
            value -= (lr * (m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6) + 1e-3 * value)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on the bounded sample of ``labels.toxic`` rows that are not held out."""
    return fit(labelled_sample(docs, labels, "toxic", LABEL_BUCKETS, LABEL_HELD_OUT, SAMPLE, SAMPLE_CHARS))


def scorer(net: Network) -> Callable[[Column], Column]:
    """A column function: the toxicity score (0 to 1) of a whole text.

    Null, empty and letterless texts score 0. Very long texts are scored window by window.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done = [score_texts(net, run) for run in slices(strings(texts))]
            yield pd.Series(np.concatenate(done) if done else np.zeros(0))

    return F.pandas_udf(score, "double")
