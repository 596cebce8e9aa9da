"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with references of
each language by the Jensen-Shannon distance; the nearest language counts. Both rules have a
minimum length under which a histogram says too little, and bounds that allow for the noise of
short texts. Before that, base rules on words and repetition apply.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.llm.common import strings
from tallyspark.llm.substrings import windows_of

# Common words of each language, most frequent first.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "en": "the of and to a in is that it for on was with be as by this are at from".split(),
    "es": "de la que el en y los se del las por un con no una para su al es lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur par au pas avec".split(),
}
# Shares of lower-case letters, capitals, digits, white space, stops, signs and the rest in prose.
CLASSES = {
    "de": (0.806, 0.0145, 0.001, 0.155, 0.0235, 0.0, 0.0),
    "en": (0.795, 0.0145, 0.001, 0.166, 0.0235, 0.0, 0.0),
    "es": (0.800, 0.0145, 0.001, 0.161, 0.0235, 0.0, 0.0),
    "fr": (0.794, 0.0145, 0.001, 0.166, 0.0240, 0.0, 0.0),
}
#: The share of the r-th most common word in prose: Zipf's law.
ZIPF_SHARE, ZIPF_POWER = 0.054, 0.9

#: Base rules: fewer words, or a larger share of repeated words (percent), fail.
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: Divergence rules: minimum length, bound on the distance, and its allowance over the root of the length.
CLASS_RULE = {"least": 200, "bound": 0.12, "slack": 1.0}
WORD_RULE = {"least": 60, "bound": 0.20, "slack": 1.2}

_SIGNS = re.compile(r"[#*$%&|<>]")
_BLANK = " \t\n\x0b\x0c\r"


def _class_of(c: str) -> int:
    if c in _BLANK:
        return 3
    if c in "#*$%&|<>":
        return 5
    if c in ".,;:!?'\"()-¿¡«»„“”‘’–—":
        return 4
    return 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 6


def class_table() -> np.ndarray:
    """The class of each code point of the basic plane; beyond it, all are of the last class."""
    table = np.full(0x10000 + 1, 6, np.int64)
    table[: 0xD800] = [_class_of(chr(i)) for i in range(0xD800)]
    table[0xE000:0x10000] = [_class_of(chr(i)) for i in range(0xE000, 0x10000)]
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(table[np.minimum(codes, 0x10000)], minlength=7)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms that sum to one."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(terms.sum() / 2, 0.0)))


def word_reference(n: int) -> np.ndarray:
    shares = ZIPF_SHARE * np.arange(1, n + 1) ** -ZIPF_POWER
    return np.append(shares, 1 - shares.sum())


def word_distance(text: str) -> tuple[float, str]:
    """The least distance over the languages of common-word histograms, and that language."""
    counts = Counter(text.lower().split())
    total = sum(counts.values())
    best = (1.0, "")
    for lang, words in COMMON.items():
        own = np.array([counts.get(w, 0) for w in words], float)
        own = np.append(own, total - own.sum()) / max(total, 1)
        best = min(best, (distance(own, word_reference(len(words))), lang))
    return best


def repeated_words(counts: np.ndarray, starts: np.ndarray, keys: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text."""
    n = int(counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0], owner[starts]))
    k, o = keys[order], owner[starts][order]
    same = (k[1:] == k[:-1]).all(1) & (o[1:] == o[:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    bad = starts[twice]
    change = np.bincount(bad, minlength=n + 1)[: n + 1] - np.bincount(bad + window, minlength=n + 1)[: n + 1]
    return np.bincount(owner[np.cumsum(change)[:n] > 0], minlength=len(counts))


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _passes(value: float, length: int, rule: dict) -> bool:
    return length < rule["least"] or value <= rule["bound"] + rule["slack"] / length**0.5


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double, nearest string"
)


def measure(texts: list[str], table: np.ndarray) -> list[tuple]:
    """``COLUMNS`` of each text."""
    out: list[tuple] = []
    for words, starts, keys in windows_of(texts, REPEAT_WINDOW):
        counts = np.fromiter(map(len, words), np.int64, len(words))
        for n, repeated in zip(counts.tolist(), repeated_words(counts, starts, keys).tolist(), strict=True):
            text = texts[len(out)]
            classes = class_counts(text, table)
            n_chars = int(classes.sum())
            shares = classes / max(n_chars, 1)
            by_class = min(distance(shares, np.array(ref)) for ref in CLASSES.values())
            by_word, nearest = word_distance(text)
            failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
            kept = not failed and _passes(by_class, n_chars, CLASS_RULE) and _passes(by_word, n, WORD_RULE)
            out.append((
                n, n_chars - int(classes[3]), len(_SIGNS.findall(text)), duplicate_lines(text), repeated, failed, kept,
                by_class, by_word, nearest or None,
            ))
    return out


def rules() -> Column:
    """A column function of whole texts: struct of ``COLUMNS``.

    Null and empty texts have no words and fail the base rules. White space is ASCII white space;
    very long texts are read whole.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = class_table()
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for texts in batches:
            yield pd.DataFrame(measure(strings(texts), table), columns=names)

    return F.pandas_udf(run, COLUMNS)
