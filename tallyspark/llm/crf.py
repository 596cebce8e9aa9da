"""Linear-chain conditional random fields in numpy: fitting on a small table, batched Viterbi."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of features (by name) for each label, of label pairs, and of first labels."""

    labels: tuple[str, ...]
    weights: dict[str, np.ndarray]
    trans: np.ndarray
    first: np.ndarray

    def emission(self, features: Sequence[str]) -> np.ndarray:
        total = np.zeros(len(self.labels))
        for f in features:
            if f in self.weights:
                total = total + self.weights[f]
        return total


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit_chain(
    table: Sequence[tuple[Sequence[Sequence[str]], Sequence[str]]], labels: Sequence[str],
    steps: int = 250, rate: float = 0.1, decay: float = 2e-3,
) -> Chain:
    """Maximum likelihood with weight decay over (features of each position, labels) sequences."""
    at = {y: i for i, y in enumerate(labels)}
    names = {f: i for i, f in enumerate(sorted({f for xs, _ in table for x in xs for f in x}))}
    n, t, k = len(table), max(len(xs) for xs, _ in table), len(labels)
    used = np.zeros((n, t), bool)
    gold = np.zeros((n, t, k))
    rows, cols = [], []
    for i, (xs, ys) in enumerate(table):
        used[i, : len(xs)] = True
        for j, (x, y) in enumerate(zip(xs, ys, strict=True)):
            gold[i, j, at[y]] = 1
            rows += [i * t + j] * len(x)
            cols += [names[f] for f in x]
    rows, cols = np.array(rows), np.array(cols)
    gold_trans = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    p = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [0 * a for a in p], [0 * a for a in p]
    for step in range(1, steps + 1):
        w, trans, first = p
        e = np.zeros((n * t, k))
        np.add.at(e, rows, w[cols])
        e = e.reshape(n, t, k)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = first + e[:, 0]
        for j in range(1, t):
            here = _log_sum(alpha[:, j - 1, :, None] + trans, 1) + e[:, j]
            alpha[:, j] = np.where(used[:, j, None], here, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            here = _log_sum(trans + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(used[:, j + 1, None], here, 0)
        z = _log_sum(alpha[:, -1], 1)
        mean = np.exp(alpha + beta - z[:, None, None]) * used[:, :, None]
        pair = alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        pair = (np.exp(np.where(used[:, 1:, None, None], pair, -np.inf))).sum((0, 1))
        over = (mean - gold).reshape(n * t, k)
        g = np.zeros_like(w)
        np.add.at(g, cols, over[rows])
        grads = [g / n + decay * w, (pair - gold_trans) / n + decay * trans, (mean[:, 0] - gold[:, 0]).sum(0) / n + decay * first]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Chain(tuple(labels), {f: p[0][i] for f, i in names.items()}, p[1], p[2])


def viterbi(
    emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, after: np.ndarray | float = 0.0
) -> np.ndarray:
    """Best label numbers (sequences, positions); positions past a length repeat its last label.

    ``first`` and ``after`` are added to the labels of the first and the last position.
    """
    n, t, k = emissions.shape
    score = first + emissions[:, 0]
    back = np.tile(np.arange(k, dtype=np.int16), (t, n, 1))
    for j in range(1, t):
        reach = score[:, :, None] + trans
        live = (j < lengths)[:, None]
        back[j] = np.where(live, reach.argmax(1), back[j])
        score = np.where(live, reach.max(1) + emissions[:, j], score)
    best = np.empty((n, t), np.int64)
    best[:, -1] = (score + after).argmax(1)
    for j in range(t - 1, 0, -1):
        best[:, j - 1] = back[j][np.arange(n), best[:, j]]
    return best


def certain(chain: Chain, emissions: np.ndarray, ends: np.ndarray, slack: float = 1e-3) -> np.ndarray:
    """Positions at which every best path has the first label.

    A path leaves the first label for runs of positions. Put the first label in place of a whole
    run, and the score changes by the emissions and transitions of the run alone; if every run over
    a position can only lose, no best path has one there. What a position can add to a run at most
    is bounded by its emissions and its share of the transitions around it, so the best run over a
    position is a difference of extremes of cumulated bounds. ``ends`` are the sequences' ends.
    """
    n, k = emissions.shape
    if not n or k < 2:
        return np.ones(n, bool)
    gain = chain.trans - chain.trans[0, 0]
    start = chain.first[1:] - chain.first[0]
    enter = np.maximum.reduce([gain[0, 1:], gain[1:, 1:].max(0) / 2, start])
    leave = np.maximum.reduce([gain[1:, 0], gain[1:, 1:].max(1) / 2, np.zeros(k - 1)])
    most = (emissions[:, 1:] + (enter + leave).astype(emissions.dtype)).max(1) - emissions[:, 0]
    most = most.astype(np.float64) + slack
    # no run goes over the end of a sequence
    wall = np.abs(most).sum() + 1.0
    stop = np.zeros(n + 1)
    stop[ends[:-1]] = -wall
    walls = np.cumsum(stop)[:n]
    total = np.concatenate([[0.0], np.cumsum(most)])
    before = np.minimum.accumulate(total[:-1] + walls)
    behind = np.maximum.accumulate((total[1:] + walls)[::-1])[::-1]
    return behind - before < 0


def decode(chain: Chain, emissions: np.ndarray, counts: np.ndarray, cells: int = 100_000) -> np.ndarray:
    """Label numbers of sequences of ``counts`` positions laid end to end, the best path of each.

    Certain positions cut a sequence into runs that are decoded alone, between two first labels
    or an end of the sequence: the path is that of the whole sequence, however long. Runs of like
    length share a rectangle of about ``cells`` positions.
    """
    out = np.zeros(len(emissions), np.int64)
    ends = np.cumsum(counts)
    open_ = np.flatnonzero(~certain(chain, emissions, ends))
    if not len(open_):
        return out
    owner = np.searchsorted(ends, open_, side="right")
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) > 1) | (np.diff(owner) > 0)
    at = np.flatnonzero(new)
    start, size = open_[at], np.diff(at, append=len(open_))
    of = owner[at]
    at_start, at_end = start == (ends - counts)[of], start + size == ends[of]
    order = np.argsort(size, kind="stable")
    done = 0
    while done < len(order):
        # sizes ascend: a rectangle is as wide as its last run
        room = np.arange(1, len(order) - done + 1) * size[order[done:]] <= cells
        n = max(1, int(room.sum()))
        runs = order[done : done + n]
        done += n
        width = int(size[runs[-1]])
        spots = np.minimum(start[runs, None] + np.arange(width), len(emissions) - 1)
        first = np.where(at_start[runs, None], chain.first, chain.trans[0])
        after = np.where(at_end[runs, None], 0.0, chain.trans[:, 0])
        best = viterbi(emissions[spots], size[runs], chain.trans, first, after)
        mine = np.arange(width) < size[runs, None]
        out[spots[mine]] = best[mine]
    return out
