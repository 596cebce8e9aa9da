"""Rows that every operator must take."""

from __future__ import annotations

LONG = " ".join(f"word{i} and then" for i in range(12_000))
EDGES = [
    (None, "a row without an id has words too"), (101, None), (102, ""), (103, " \t\n "), (104, "one"),
    (105, LONG), (106, "twice the same row of plain words here"), (106, "twice the same row of plain words here"),
    (107, "x" * 50_000), (108, "été ñandú 漢字   \U0001f600 Straße"),
]
