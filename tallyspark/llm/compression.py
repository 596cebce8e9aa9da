"""Text quality by compression: which of two zstandard dictionaries fits a text better.

One dictionary is built from good, one from bad labelled texts. A text is cut into blocks, each
compressed with both; the difference of the sizes over the number of bytes is the signal. A
logistic curve fitted on other labelled texts turns it into a score; the shorter a text, the
nearer it is to one value fitted for texts too short to tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import labelled_sample, sigmoid, strings

#: Bounds of the labelled sample: rows of label 0 and 1, and characters of a text.
SAMPLE, SAMPLE_CHARS = (1600, 4800), 20_000
LABEL_BUCKETS, LABEL_HELD_OUT = 3, 1
BLOCK, DICTIONARY, LEVEL = 2048, 512 * 1024, 3
#: Bytes at which a text's signal weighs as much as the curve's value for very short texts.
SHORT = 200


@dataclass
class Judge:
    """The dictionaries' bytes, and the weights of (w * signal, w, 1 - w), w = bytes / (bytes + SHORT)."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


def _blocks(text: str) -> list[bytes]:
    octets = text.encode("utf-8", "surrogatepass")
    return [octets[i : i + BLOCK] for i in range(0, len(octets), BLOCK)]


def _dictionary(texts: list[str]) -> bytes:
    """A dictionary of the texts; for too few to train one, the texts themselves."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {} if not dictionary else {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
    return zstandard.ZstdCompressor(
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False
        ),
        **plain,
    )


class Scale:
    """Signals of texts under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def terms(self, text: str) -> tuple[float, float, float]:
        """What the curve weighs; the signal is (size under bad - size under good) / bytes."""
        blocks = _blocks(text)
        size = sum(map(len, blocks))
        gain = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in blocks)
        w = size / (size + SHORT)
        return gain / (size + SHORT), w, 1 - w


def fit(sample: list[tuple[str, int]]) -> Judge:
    """Dictionaries from two of three rows of each class, the curve from the remaining rows.

    Without rows of both classes the score is one value for all texts.
    """
    good, bad = ([t for t, y in sample if y == k] for k in (1, 0))
    learnt = [[t for i, t in enumerate(part) if i % 3] or part for part in (good, bad)]
    judge = Judge(*map(_dictionary, learnt))
    if not good or not bad:
        value = 2.0 * bool(good) - 2.0 * bool(bad)
        judge.curve = (0.0, value, value)
        return judge
    scale = Scale(judge.good, judge.bad)
    held = [(scale.terms(t), y) for part, y in ((good, 1), (bad, 0)) for t in part[::3]]
    x, y = np.array([s for s, _ in held]), np.array([k for _, k in held], float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    spread = np.array([x[:, 0].std() or 1.0, 1.0, 1.0])
    x = x / spread
    curve = np.zeros(3)
    for _ in range(60):  # Newton steps with a little shrinkage
        p = sigmoid(x @ curve)
        grad = x.T @ (weight * (p - y)) + 1e-3 * curve
        curve = curve - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(3), grad)
    judge.curve = tuple((curve / spread).tolist())
    return judge


def learn(docs: DataFrame, labels: DataFrame) -> Judge:
    """Fit on the bounded sample of ``labels.quality`` rows that are not held out."""
    return fit(labelled_sample(docs, labels, "quality", LABEL_BUCKETS, LABEL_HELD_OUT, SAMPLE, SAMPLE_CHARS))


def scorer(judge: Judge) -> Callable[[Column], Column]:
    """A column function: the chance (0 to 1) that a whole text is good; null counts as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scale = Scale(judge.good, judge.bad)
        for texts in batches:
            x = np.array([scale.terms(t) for t in strings(texts)]).reshape(-1, 3)
            yield pd.Series(sigmoid(x @ np.array(judge.curve)))

    return F.pandas_udf(score, "double")
