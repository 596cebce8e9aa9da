"""Substring dedup: windows of words that occur more than once, found behind a count-min prefilter.

Texts are dealt once into groups of bounded size, a table bucketed by group that later passes
read without a shuffle.

1. Each group sketches its windows: ``DEPTH`` hash rows, of each row the cells in use and
   whether one was hit twice (counts above two make no difference). Sketches are cut by cell
   range; the ranges of all groups merge in parallel, and every group gets one bit back for each
   of its cells: was it hit at least twice by all groups together? A count-min sketch never
   underestimates, so no repeated window is lost.
2. Windows whose cells are all hit twice are grouped exactly by 128-bit keys, again by range,
   each distinct key once for each group, so a window that fills a third of the corpus is one
   entry of each group; one bit comes back for each key.

What moves is the texts once, a few bytes for each window, and 16 bytes for each distinct
window of a group that may be repeated. No sketch is held whole anywhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallyspark.llm.common import slices, strings, written

WINDOW = 35
DEPTH = 2
#: Cells of a hash row for each window of the corpus: two rows of it pass about 1.5 % in vain.
CELLS = 8
#: Text bytes of a group, sketch entries and exact keys of a range.
GROUP_BYTES, RANGE_ENTRIES = 12_000_000, 4_000_000
#: Buckets of the dealt table at most (Spark refuses more than 100,000); beyond it a bucket holds several groups.
MAX_BUCKETS = 50_000

_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def split_words(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACE).split(b" ") if w]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``window`` consecutive word hashes."""
    n = len(words)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))
        inverse = np.cumprod(
            np.concatenate([[np.uint64(1)], np.full(max(n - window, 0), pow(base, -1, 2**64), np.uint64)])
        )
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n])])
        return _mix((total[window:] - total[: n - window + 1]) * inverse[: n - window + 1])


def windows_of(texts: list[str], window: int = WINDOW) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Slice by slice: the words of each text; and of each window, its first word's number in
    the slice and its 128-bit key as two numbers."""
    for part in slices(texts):
        words = [split_words(t) for t in part]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if len(flat) < window:
            yield words, np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
            continue
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        hashes = np.frombuffer(b"".join([xxhash.xxh128_digest(w) for w in distinct]), ">u8").reshape(-1, 2)
        hashes = hashes.astype(np.uint64)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))  # words to the text's end
        starts = np.nonzero(left >= window)[0]
        keys = np.stack([_rolled(hashes[codes, i], _BASES[i], window)[starts] for i in (0, 1)], axis=1)
        yield words, starts, keys


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as zstandard-compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


class Plan:
    """Sizes that follow the corpus: groups, cells of a hash row, ranges."""

    def __init__(self, n_bytes: int, window: int):
        self.window = window
        self.groups = max(1, math.ceil(n_bytes / GROUP_BYTES))
        n_windows = max(1, n_bytes // 5)  # words are seldom shorter; only sizes hang on it
        self.cell_bits = max(10, math.ceil(math.log2(CELLS * n_windows)))
        self.range_bits = max(0, math.ceil(math.log2(n_windows / RANGE_ENTRIES)))

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        mixed = _mix(keys[:, 0] + np.uint64(2 * row + 1) * keys[:, 1])
        return mixed >> np.uint64(64 - self.cell_bits)

    def ranges(self, values: np.ndarray, bits: int) -> np.ndarray:
        """Where each range begins in the sorted values, and the end."""
        edges = np.arange(2**self.range_bits, dtype=np.uint64) << np.uint64(bits - self.range_bits)
        return np.append(np.searchsorted(values, edges), len(values))


def _sketch_rows(plan: Plan, keys: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(hash row, range, cells, hit twice) of a group's sketch."""
    for row in range(DEPTH):
        cells, count = np.unique(plan.cells(keys, row), return_counts=True)
        at = plan.ranges(cells, plan.cell_bits)
        for r in range(len(at) - 1):
            a, z = at[r], at[r + 1]
            if z > a:
                yield row, r, _packed(cells[a:z]), _bits(count[a:z] > 1)


def _hot(plan: Plan, keys: np.ndarray, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
    """Whether each window is estimated to occur at least twice."""
    hot = np.ones(len(keys), bool)
    for row in range(DEPTH):
        own = plan.cells(keys, row)
        cells, back = np.unique(own, return_inverse=True)
        at = plan.ranges(cells, plan.cell_bits)
        twice = [_flags(answers[row, r], at[r + 1] - at[r]) for r in range(len(at) - 1) if at[r + 1] > at[r]]
        hot &= np.concatenate(twice)[back] if twice else True
    return hot


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and the number of each key's distinct one."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    number = np.cumsum(new) - 1
    back = np.empty(len(keys), np.int64)
    back[order] = number
    return ordered[new], np.bincount(number, minlength=int(new.sum())), back


def _key_rows(plan: Plan, keys: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(DEPTH, range, keys, seen twice) of a group's windows that may be repeated."""
    found, count, _ = _distinct(keys)
    at = plan.ranges(found[:, 0], 64)
    for r in range(len(at) - 1):
        a, z = at[r], at[r + 1]
        if z > a:
            yield DEPTH, r, found[a:z].tobytes(), _bits(count[a:z] > 1)


_SENT = StructType(
    [StructField(c, LongType()) for c in ("hash_row", "cell_range", "dealt")]
    + [StructField(c, BinaryType()) for c in ("sent", "twice")]
)
_ANSWER = "dealt long, hash_row long, cell_range long, answer binary"


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of all groups: for each group, which of its entries occur at least twice."""
    exact = int(rows["hash_row"].iloc[0]) == DEPTH
    sent = [np.frombuffer(b, np.uint64).reshape(-1, 2) if exact else _unpacked(b) for b in rows["sent"]]
    sizes = [len(s) for s in sent]
    twice = np.concatenate([_flags(b, n) for b, n in zip(rows["twice"], sizes, strict=True)])
    if exact:
        _, count, back = _distinct(np.concatenate(sent))
    else:
        _, back, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    count[back[twice]] = 2
    hot = np.split(count[back] > 1, np.cumsum(sizes)[:-1])
    return pd.DataFrame(
        {"dealt": rows["dealt"], "hash_row": rows["hash_row"], "cell_range": rows["cell_range"], "answer": [_bits(h) for h in hot]}
    )


def _answers(rows: pd.DataFrame, exact: bool) -> dict:
    mine = rows[(rows["hash_row"] == DEPTH) == exact]
    return {(int(d), int(r)): a for d, r, a in zip(mine["hash_row"], mine["cell_range"], mine["answer"], strict=True)}


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, by one space).

    A word goes if a window over it has a word sequence that also starts anywhere else, in any
    row, the same one included; windows are judged on the input. Repeated rows are texts like any
    other, so all their windows repeat. Null and empty texts have no words and keep the empty text;
    null ids are carried along; very long texts are cut nowhere.
    """
    spark = docs.sparkSession
    # ids travel as text: next to a null, pandas would turn large numbers into doubles
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    plan = Plan(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0, window)

    # a table of the warehouse: only those know that they are dealt by group
    dealt = f"dealt_{uuid.uuid4().hex}"
    grouped = narrow.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.groups)))
    buckets = min(plan.groups, MAX_BUCKETS)
    grouped.repartition(buckets, "dealt").write.bucketBy(buckets, "dealt").format("parquet").saveAsTable(dealt)
    table = spark.table(dealt)

    def all_keys(texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.uint64), *(keys for _, _, keys in windows_of(texts, window))])

    def sent(group: int, rows: Iterator[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(list(rows), columns=["hash_row", "cell_range", "sent", "twice"])
        return frame.assign(dealt=group)[_SENT.names]

    def sketch(rows: pd.DataFrame) -> pd.DataFrame:
        return sent(int(rows["dealt"].iloc[0]), _sketch_rows(plan, all_keys(strings(rows["text"]))))

    def candidates(rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=_SENT.names)
        keys = all_keys(strings(rows["text"]))
        keys = keys[_hot(plan, keys, _answers(bits, False))]
        return sent(int(rows["dealt"].iloc[0]), _key_rows(plan, keys))

    result = StructType([
        StructField("doc_id", StringType()), StructField("n_words", LongType()),
        StructField("n_removed", LongType()), StructField("kept", StringType()),
    ])

    def clean(rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=result.names)
        texts = strings(rows["text"])
        keys = all_keys(texts)
        repeated = _hot(plan, keys, _answers(bits, False))
        found, _, back = _distinct(keys[repeated])
        at = plan.ranges(found[:, 0], 64)
        exact = _answers(bits, True)
        sure = [_flags(exact[DEPTH, r], at[r + 1] - at[r]) for r in range(len(at) - 1) if at[r + 1] > at[r]]
        repeated[repeated] = np.concatenate(sure)[back] if sure else False
        done, out = 0, []
        for words, starts, _ in windows_of(texts, window):
            bad = starts[repeated[done : done + len(starts)]]
            done += len(starts)
            n = sum(map(len, words))
            change = np.bincount(bad, minlength=n + 1)[: n + 1] - np.bincount(bad + window, minlength=n + 1)[: n + 1]
            gone = (np.cumsum(change) > 0).tolist()
            first = 0
            for ws in words:
                left = [w for w, g in zip(ws, gone[first : first + len(ws)], strict=True) if not g]
                first += len(ws)
                out.append((len(ws), len(ws) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        frame = pd.DataFrame(out, columns=result.names[1:])
        frame.insert(0, "doc_id", rows["doc_id"].to_numpy())
        return frame

    by_range = ("hash_row", "cell_range")
    sketches = table.groupBy("dealt").applyInPandas(sketch, _SENT)
    maybe = written(sketches.groupBy(*by_range).applyInPandas(_merge, _ANSWER))
    doubtful = table.groupBy("dealt").cogroup(maybe.groupBy("dealt")).applyInPandas(candidates, _SENT)
    sure = written(doubtful.groupBy(*by_range).applyInPandas(_merge, _ANSWER))
    bits = maybe.unionByName(sure)
    cleaned = table.groupBy("dealt").cogroup(bits.groupBy("dealt")).applyInPandas(clean, result)
    return cleaned.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))

