import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_odd import ODD  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of given (doc_id, text) pairs, with columns whose names clash with those inside operators."""

    def make(rows, extra=False):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            clashing = ("row", "n", "pos", "name", "id", "t", "f", "e", "score", "label", "x", "h", "w", "term", "entity", "kept", "block", "address", "k1")
            frame = frame.withColumns({c: F.lit(1) for c in clashing})
        return frame

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows, a missing id, and clashing extra columns."""
    return make_docs(ODD, extra=True)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
