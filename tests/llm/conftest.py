from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that operators use inside, as columns a table may have too.
CLASHING = ("id", "h", "n", "row", "words", "value", "begins", "__id", "bucket", "keep", "root")


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a table, with extra columns of clashing names."""

    def build(rows):
        names = ", ".join(f"`{c}` string" for c in CLASHING)
        data = [(doc, text, "en", "s", len(text or ""), *["x"] * len(CLASHING)) for doc, text in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {names}")

    return build
