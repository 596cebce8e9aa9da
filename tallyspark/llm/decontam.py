"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes (normalised) may occur in a text with up to ``budget(m)`` edits. Cut it
into one more piece than that: an occurrence leaves at least one piece untouched. All pieces of
a block of items go into one automaton, which is run over every whole text; around each exact
piece hit Myers' bit-parallel recurrence computes the edit distance and decides.

The items are a query set: they are taken in blocks of bounded size, each block one more pass
over the texts, without any shuffle of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tallyspark.llm.common import strings

#: One edit is allowed for each so many bytes of an item.
BYTES_PER_EDIT = 16
#: Normalised bytes of items in one block, about: what one automaton holds.
BLOCK_BYTES = 2_000_000

_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str) -> str:
    """Lower-case words joined by one space, each character one byte of the UTF-8 form.

    ASCII characters other than letters and digits count as white space.
    """
    octets = text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)
    return b" ".join(octets.split()).decode("latin-1")


def budget(length: int, bytes_per_edit: int = BYTES_PER_EDIT) -> int:
    return length // bytes_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def best_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and its first end (Myers)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        equal[c] |= 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = equal[c] if c in equal else 0
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph <<= 1
        up = ((mh << 1) | ~(xv | ph)) & full
        down = ph & xv & full
    return best, end


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], bytes_per_edit: int = BYTES_PER_EDIT):
        self.items = [(key, norm) for key, text in items if (norm := normalise(text))]
        self.edits = [budget(len(norm), bytes_per_edit) for _, norm in self.items]
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, norm) in enumerate(self.items):
            for offset, piece in pieces(norm, self.edits[i]):
                owners[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item key, distance, edits allowed, start, end) of the best occurrence of each item."""
        if not self.items:
            return
        norm = normalise(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(norm):
            for i, offset in where:
                starts[i].append(last + 1 - length - offset)
        for i in sorted(starts):
            key, item = self.items[i]
            k = self.edits[i]
            best = None
            for a, z in self._spans(sorted(starts[i]), len(item), k):
                a = max(a, 0)
                distance, end = best_end(item, norm[a:z])
                if distance <= k and (best is None or distance < best[0]):
                    back = norm[max(a, a + end - len(item) - k) : a + end][::-1]
                    best = distance, a + end - best_end(item[::-1], back)[1], a + end
            if best:
                yield key, best[0], k, best[1], best[2]

    @staticmethod
    def _spans(starts: list[int], length: int, k: int) -> Iterator[tuple[int, int]]:
        """The stretches of text that hold every occurrence around the hits, merged."""
        a, z = starts[0] - k, starts[0] + length + k
        for s in starts[1:]:
            if s - k > z:
                yield a, z
                a = s - k
            z = s + length + k
        yield a, z


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about ``BLOCK_BYTES``, each small enough for a task's memory."""
    rows = items.where(F.length(text_col) > 0).select(id_col, text_col)
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(n):
        mine = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b)
        yield sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is not None, r))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text and item it holds: doc_id, item_id, distance, edits, start, end.

    start and end are byte positions in the normalised text (the best occurrence: least
    distance, then the first). Texts without an item have no row; null and empty texts and items
    match nothing; repeated rows of either side repeat in the result; null ids are carried along.
    """
    id_type = docs.schema[id_col].dataType
    item_type = items.schema["item_id"].dataType
    # ids travel as text: next to a null, pandas would turn large numbers into doubles
    schema = StructType(
        [StructField("doc_id", StringType()), StructField("item_id", StringType())]
        + [StructField(c, IntegerType()) for c in ("distance", "edits")]
        + [StructField(c, LongType()) for c in ("start", "end")]
    )
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in blocks(items.withColumn("item_id", F.col("item_id").cast("string"))):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block)
            for batch in batches:
                rows = [
                    (key, *hit) for key, text in zip(batch["doc_id"], strings(batch["text"]), strict=True)
                    for hit in matcher.find(text)
                ]
                yield pd.DataFrame(rows, columns=schema.names).astype({"doc_id": object, "item_id": object})

        part = narrow.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumns({"doc_id": F.col("doc_id").cast(id_type), "item_id": F.col("item_id").cast(item_type)})


def holds_item(block: list[tuple[int, str]]):
    """A column function: whether a whole text holds an item of the block (false for nulls)."""

    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block)
        for texts in batches:
            yield pd.Series([any(True for _ in matcher.find(t)) for t in strings(texts)], dtype=bool)

    return F.pandas_udf(check, "boolean")


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged."""
    for block in blocks(items):
        flagged: Column = holds_item(block)(F.col(text_col))
        docs = docs.where(~flagged)
    return docs
