"""Fill-in-the-middle: cut texts at two random boundaries and move the middle to the end.

The UTF-8 bytes of a slice of texts are mapped to a few character classes, and a wavelet matrix
over these classes answers how many bytes of a class stand before any position. The classes
that begin a unit (a code point, a word, a line) add up to the number of units before a
position; the byte of a cut is found by bisection on that count, for all cuts of the slice at
once. Nothing is counted text by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of 100: rows from here on stay plain; below, of the others, the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20

# The class of a byte. Every class but the first begins a code point.
CONTINUES, INSIDE, WORD, BLANK, LINE_WORD, LINE_BLANK = range(6)
#: The classes whose bytes begin a unit.
UNITS = {
    "char": (INSIDE, WORD, BLANK, LINE_WORD, LINE_BLANK),
    "word": (WORD, LINE_WORD),
    "line": (LINE_WORD, LINE_BLANK),
}
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class WaveletMatrix:
    """Rank over small numbers: one bit vector a level, most significant bits first.

    Every level is ordered stably by its bit for the next, and kept as words of 64 bits with
    the number of set bits before each word.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in reversed(range(bits)):
            ones = (values >> level) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            words = np.zeros(len(values) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            is_one = ones.astype(bool)
            self.levels.append((words, before, len(values) - int(is_one.sum())))
            values = np.concatenate([values[~is_one], values[is_one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` values equal ``value``."""
        first, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, (words, before, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            if value >> level & 1:
                first, at = zeros + self._ones(words, before, first), zeros + self._ones(words, before, at)
            else:
                first, at = first - self._ones(words, before, first), at - self._ones(words, before, at)
        return at - first


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that begin at ``starts``."""
    blank = _IS_BLANK[data]
    text_start = np.zeros(len(data), bool)
    text_start[starts[starts < len(data)]] = True
    after_blank, after_line = text_start.copy(), text_start
    after_blank[1:] |= blank[:-1]
    after_line[1:] |= data[:-1] == 10
    out = np.where(blank, BLANK, np.where(after_blank, WORD, INSIDE)).astype(np.uint8)
    out[after_line] = np.where(blank[after_line], LINE_BLANK, LINE_WORD)
    out[(data & 0xC0) == 0x80] = CONTINUES
    return out


class Boundaries:
    """Counts and places of unit boundaries in a slice of encoded texts."""

    def __init__(self, encoded: Sequence[bytes], unit: str = "char"):
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = np.frombuffer(b"".join(encoded), np.uint8)
        self.matrix, self.begins = WaveletMatrix(byte_classes(data, self.starts), 3), UNITS[unit]
        self.base = self.before(self.starts)
        self.n = self.before(self.ends) - self.base

    def before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in self.begins)

    def offsets(self, k: np.ndarray) -> np.ndarray:
        """For each text, the byte within it at which its first ``k`` units end.

        What stands before the first unit belongs to it: no units end at byte 0.
        """
        low, high = self.starts.copy(), np.where(k > 0, self.ends, self.starts)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            fits = self.before(mid) - self.base <= k
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low - self.starts


def cut_texts(texts: Sequence[str], forms: Sequence[str], draw1, draw2, unit: str = "char") -> list[tuple]:
    """(n, prefix units, middle units, output) of each text of one slice."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    places = Boundaries(encoded, unit)
    a, b = np.asarray(draw1, np.int64) % (places.n + 1), np.asarray(draw2, np.int64) % (places.n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    cuts = zip(places.offsets(first).tolist(), places.offsets(second).tolist(), strict=True)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    out = []
    for text, data, form, n, x, y, (i, j) in zip(
        texts, encoded, forms, places.n.tolist(), first.tolist(), second.tolist(), cuts, strict=True
    ):
        if form == "plain":
            out.append((n, None, None, text))
            continue
        head, middle, tail = data[:i], data[i:j], data[j:]
        parts = (marks[0], head, marks[1], tail) if form == "psm" else (marks[1], tail, marks[0], head)
        out.append((n, x, y - x, b"".join((*parts, marks[2], middle)).decode("utf-8", "surrogatepass")))
    return out


def _cutter(unit: str):
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, forms, draw1, draw2 in batches:
            rows, at = [], 0
            for part in slices(strings(texts)):
                z = at + len(part)
                rows += cut_texts(part, forms[at:z], draw1[at:z], draw2[at:z], unit)
                at = z
            found = pd.DataFrame(rows, columns=["n", "prefix", "middle", "output"])
            yield found.astype({"prefix": "Int64", "middle": "Int64"})

    return F.pandas_udf(cut, "n long, prefix long, middle long, output string")


def _draw(doc_id: Column, seed: str, group: int) -> Column:
    """Group ``group`` of eight hex digits of the SHA-256 of seed and id, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1",
    plain_from: int = PLAIN_FROM, suffix_first_below: int = SUFFIX_FIRST_BELOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_units, middle_units, text, output.

    ``n`` counts the units of the text. The draws hang on the id alone, so repeated ids are cut
    alike, and rows without an id as if it were the empty text. Null texts count as empty. Empty
    texts, texts that hold a marker, and the share above ``plain_from`` stay ``plain``: the
    output is the text and the unit counts are null. Equal draws give an empty middle. An empty
    table gives an empty result; other columns are ignored.
    """
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_draw(doc_id, seed, 2) % 100 >= plain_from)
    suffix_first = _draw(doc_id, seed, 3) % 100 < suffix_first_below
    form = F.when(plain, "plain").when(suffix_first, "spm").otherwise("psm")
    cut = _cutter(unit)("text", "form", _draw(F.col("doc_id"), seed, 0), _draw(F.col("doc_id"), seed, 1))
    drawn = docs.select(doc_id.alias("doc_id"), text.alias("text"), form.alias("form")).withColumn("cut", cut)
    return drawn.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.col("cut.prefix").alias("prefix_units"),
        F.col("cut.middle").alias("middle_units"), "text", F.col("cut.output").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    No text that was cut holds a marker, and no marker can begin inside another, so the three
    markers of an output are found by plain search.
    """
    parts = F.split(output, "<[PSM]>")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )
