import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows): documents with a clashing name besides the usual columns."""

    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long, id long, row string"):
        width = len(columns.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], columns)

    return make
