from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use inside
    "fp long, comp long, score double, found string, dealt long, sample_id long, rep long, a long, b long, "
    "lead_id long, row string, lead string, tags map<string,int>"
)


@pytest.fixture
def frame(spark):
    """Documents with columns whose names clash with inner ones, from (doc_id, text) rows."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 0.5, "f", 3, 4, 5, 6, 7, 8, "r", "l", {"k": 1}) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return make
