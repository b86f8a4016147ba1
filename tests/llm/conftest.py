import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as documents, with extra columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string"
        return spark.createDataFrame(
            [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t), 0.5, False, "x") for i, t in rows], schema
        )

    return make
