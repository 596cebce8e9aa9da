"""Text, number and date parsing with the null rules of a ledger file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a CSV reader takes as missing, matched before any trimming.
READ_NULL_TOKENS = (
    "", "#N/A", "#NA", "N/A", "n/a", "NA", "NULL", "null", "NaN", "nan", "-nan", "-NaN", "None",
    "<NA>", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Texts that count as missing after trimming, case-sensitive.
TEXT_NULL_TOKENS = ("", "nan", "None")

# Every character that Unicode counts as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

DEFAULT_DATE_FORMATS = ("iso",)


def strip_space(c: Column) -> Column:
    """Strip all Unicode white space at both ends (plain ``trim`` only knows U+0020).

    Trimming by a character set is slow, so only texts that start or end with one of the
    characters take it.
    """
    space = F.lit(SPACE_CHARS)
    edge = F.contains(space, F.substring(c, 1, 1)) | F.contains(space, F.substring(c, -1, 1))
    return F.when(edge, F.trim(c, space)).otherwise(c)


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*READ_NULL_TOKENS), c)


def norm_text(stripped: Column) -> Column:
    """Missing-value texts, already stripped, become null; the rest is lower-cased."""
    return F.when(~stripped.isin(*TEXT_NULL_TOKENS), F.lower(stripped))


def parse_amount(stripped: Column) -> Column:
    """Stripped text to double, null when it is no number.

    NaN becomes null because Spark orders NaN above every number, and the type suffixes
    and hex digits of Java literals are refused.
    """
    low = F.lower(stripped)
    # an infinity ends in f as well, but holds no digit before it
    java_only = low.contains("x") | low.endswith("d") | (low.endswith("f") & ~low.endswith("inf"))
    return F.when(~java_only, not_nan(stripped.try_cast("double")))


def not_nan(c: Column) -> Column:
    """Null for NaN, in one comparison: NaN is above infinity."""
    return F.when(c <= float("inf"), c)


def parse_date(stripped: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Stripped text to timestamp by the first format that fits, null when none does.

    ``iso`` is a complete ISO date with or without a time of day, read by a cast, which is
    several times faster than a pattern. A single pattern accepts nothing else.
    """
    tries = [
        F.when(F.length(stripped) >= 8, stripped.try_cast("timestamp_ntz"))
        if f == "iso"
        else F.try_to_timestamp(stripped, F.lit(f)).cast("timestamp_ntz")
        for f in formats
    ]
    return F.coalesce(*tries)


def slug(c: Column) -> Column:
    """Category text as it appears inside a feature name."""
    return F.replace(F.lower(strip_space(c)), F.lit(" "), F.lit("_"))


def slug_text(name: str) -> str:
    return name.strip().lower().replace(" ", "_")
