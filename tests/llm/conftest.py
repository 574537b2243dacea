import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) as documents, with columns beside them whose names clash with operators' own."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, "k") for i, t, lang, src in full], DOCS)

    return make
