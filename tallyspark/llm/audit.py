"""How filters interact: what each removes, in every order of the filters.

Four filters look at one text alone and are column expressions. The fifth, duplicates, needs
the smallest id of each text over the whole table, and is found without moving unique texts:

1. every row becomes a narrow fact (id, part, mask of the other filters, two 64-bit hashes),
   written once;
2. a counting Bloom filter over the hashes: a text adds one to a counter in each quarter of its
   block. Every task folds its own counters (a partition's sketch), then sketches are added up by
   counter. A text with a counter of 1 is unique for certain; blocks and counters grow with the
   table and are never whole anywhere;
3. only rows that the merged counters can not clear are read again with their text, and
   grouped by it for the exact smallest id;
4. rows are not joined back to their flags one by one: the counts of each mask are sums. Rows
   of possibly repeated texts move to the mask with the duplicate bit, the rows that hold the
   smallest id of their text move back. Copies fold to one row a task before any of this.

The counts of all masks decide every order: a mask, an order and a step tell who is removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: A block has this many counters, a quarter for each of the four that a text adds to; each
#: distinct text finds about 16 counters.
BLOCK, QUARTERS, TEXTS_A_BLOCK = 512, 4, 32
#: Hashes of possibly repeated texts are sent to every task up to this number (16 MB of rows).
BROADCAST_ROWS = 1_000_000
DUPLICATE = "E"
_BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    """What a text must keep to."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    signs: str = "#$%&*|"


def text_filters(text: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    any_sign = "[" + "".join(f"\\{s}" for s in limits.signs) + "]"
    return {
        "A": n_words < limits.least_words,
        "B": 100 * n_distinct < limits.distinct_percent * n_words,
        "C": 100 * capitals > limits.capital_percent * F.length(text),
        "D": F.rlike(text, F.lit(any_sign)),
    }


def _mask(flags: dict[str, Column]) -> Column:
    bits = [F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags.values())]
    return reduce(Column.__add__, bits)


def _hashes(text: Column, bits: int) -> tuple[Column, Column]:
    """Two hashes of a text; fewer bits than 64 only serve to test what happens when they collide."""
    first, second = F.xxhash64(text), F.xxhash64(text, F.lit("second"))
    return (first, second) if bits == 64 else (F.shiftright(first, 64 - bits), F.shiftright(second, 64 - bits))


def bloom_blocks(hashes: DataFrame, n_rows: int) -> DataFrame:
    """The merged counting Bloom filter of ``hashes(h)``: per block, the counters that reach 2.

    One row (block, q0..q3), each quarter as two 64-bit words; blocks without such a counter
    are left out.
    """
    blocks = max(1, n_rows // TEXTS_A_BLOCK)
    width = BLOCK // QUARTERS
    spots = F.explode(F.array(*[F.lit(q * width) + _spot(q) for q in range(QUARTERS)]))
    counters = (
        hashes.select(_block(blocks).alias("block"), spots.alias("spot"))
        .groupBy("block", "spot").agg(F.count(F.lit(1)).alias("n"))
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("spot") / 64) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}")
        for w in range(BLOCK // 64)
    ]
    return counters.where("n > 1").groupBy("block").agg(*words)


def _block(blocks: int) -> Column:
    return F.pmod(F.col("h"), F.lit(blocks).cast("long"))


def _spot(quarter: int) -> Column:
    """A counter in a quarter, from other bits than those that choose the block."""
    return F.pmod(F.xxhash64("h", F.lit(quarter)), F.lit(BLOCK // QUARTERS).cast("long"))


def possible_repeats(hashes: DataFrame, n_rows: int) -> DataFrame:
    """The distinct ``h`` of which no counter is 1: all that occur twice, and few others."""
    blocks = max(1, n_rows // TEXTS_A_BLOCK)
    merged = bloom_blocks(hashes, n_rows)
    # a block's texts as one set: the copies of a text fold in the tasks that read them
    by_block = hashes.select(_block(blocks).alias("block"), "h").groupBy("block").agg(F.collect_set("h").alias("hs"))
    both = by_block.join(merged, "block").select(F.explode("hs").alias("h"), *[f"w{w}" for w in range(BLOCK // 64)])
    full = F.lit(True)
    for q in range(QUARTERS):
        spot = _spot(q)
        half = F.when(spot < 64, F.col(f"w{2 * q}")).otherwise(F.col(f"w{2 * q + 1}"))
        full = full & (F.getbit(half, F.pmod(spot, F.lit(64).cast("long")).cast("int")) == 1)
    return both.where(full).select("h")


def first_rows(docs: DataFrame, repeats: DataFrame, broadcast_rows: int, hash_bits: int) -> DataFrame:
    """The smallest id of each possibly repeated text: rows (h, h2, lead), one a text.

    Texts whose hash is in ``repeats`` are grouped by the text itself. The list goes to every
    task while it is short; beyond that both sides move by hash.
    """
    listed = repeats.select(F.col("h").alias("listed"))
    if repeats.count() <= broadcast_rows:
        listed = F.broadcast(listed)
    h, h2 = _hashes(F.col("text"), hash_bits)
    again = docs.withColumn("h", h).join(listed, F.col("h") == F.col("listed"), "left_semi")
    leads = again.groupBy("text").agg(F.min("doc_id").alias("lead"))
    return leads.select(h.alias("h"), h2.alias("h2"), "lead")


def mask_counts(
    docs: DataFrame, labels: DataFrame, part_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
    limits: Limits = Limits(), broadcast_rows: int = BROADCAST_ROWS, hash_bits: int = 64,
) -> DataFrame:
    """Rows of each set of failed filters: (part, mask, n, n_good, n_toxic).

    Bit i of ``mask`` stands for the i-th of the filters A to E. Null texts count as empty, a
    null part as the empty string. A row fails E if a row of a smaller id has the same text;
    rows without an id never do, and no row fails for them. Repeated rows are all counted, and
    rows that share the smallest id of their text all pass E. A label given twice counts once,
    the larger one. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    h, h2 = _hashes(F.col("text"), hash_bits)
    facts = written(
        rows.select("doc_id", "part", _mask(text_filters(F.col("text"), limits)).alias("mask"), h.alias("h"), h2.alias("h2"))
    )
    repeats = written(possible_repeats(facts.where("doc_id is not null").select("h"), facts.count()))
    leads = written(first_rows(rows.where("doc_id is not null").select("doc_id", "text"), repeats, broadcast_rows, hash_bits))

    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    good = F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")
    marked = facts.join(known, "doc_id", "left").select("*", good.alias("good"), bad.alias("bad"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_toxic")]
    cells = marked.groupBy("part", "mask", "h", "h2", F.isnull("doc_id").alias("no_id")).agg(*sums)

    duplicate = 1 << len(text_filters(F.lit("")))
    # hashes of two texts that collide stand in ``leads`` twice: their rows must not count twice
    keys = leads.select("h", "h2").distinct()
    may_repeat = cells.where("not no_id").join(keys, ["h", "h2"], "left_semi")
    lead = leads.select(F.col("lead").alias("doc_id"), "h", "h2").distinct()
    first = marked.join(lead, ["doc_id", "h", "h2"], "left_semi").groupBy("part", "mask").agg(*sums)
    names = ("n", "n_good", "n_toxic")

    def signed(df: DataFrame, sign: int, bit: int) -> DataFrame:
        return df.select("part", (F.col("mask") + bit).alias("mask"), *[(sign * F.col(c)).alias(c) for c in names])

    terms = [
        signed(cells, 1, 0), signed(may_repeat, -1, 0), signed(may_repeat, 1, duplicate),
        signed(first, 1, 0), signed(first, -1, duplicate),
    ]
    total = reduce(DataFrame.unionByName, terms).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in names])
    return total.where("n > 0")


def audit(counts: DataFrame, filters: Sequence[str] = ("A", "B", "C", "D", DUPLICATE)) -> DataFrame:
    """Every order of the filters applied to ``mask_counts``: one row per part, order and step.

    kept after the step, removed in it, redundant (fail the step's filter but are gone), those
    that fail this filter only, good and toxic rows removed, and the filter's removals summed
    over all orders. Every part has all rows, zeros included.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = []
    for order in permutations(filters):
        gone = 0
        for k, f in enumerate(order):
            steps.append((gone, bit[f], "".join(order), k + 1))
            gone |= bit[f]
    plan = ", ".join(f"struct({g} AS gone, {b} AS bit, '{o}' AS filter_order, {s} AS step)" for g, b, o, s in steps)
    rows = counts.select("*", F.explode(F.expr(f"array({plan})")).alias("s")).select("*", "s.*")
    mask, gone, this = F.col("mask"), F.col("gone"), F.col("bit")
    passed = mask.bitwiseAND(gone) == 0
    fails = mask.bitwiseAND(this) != 0
    removed = passed & fails
    # of all orders, each failed filter of a mask comes first equally often
    share = len(list(permutations(filters))) / F.nullif(F.bit_count("mask"), F.lit(0))

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    n = F.col("n")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails, n).alias("kept"),
        total(removed, n).alias("removed"),
        total(fails & ~passed, n).alias("redundant"),
        total(mask == this, n).alias("unique_fails"),
        total(removed, F.col("n_good")).alias("good_lost"),
        total(removed, F.col("n_toxic")).alias("toxic_lost"),
        total(fails, F.round(n * share).cast("long")).alias("shapley"),
    )
