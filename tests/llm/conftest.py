import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from texts, with ids from 0."""

    def make(texts, ids=None, lang=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, lang[k] if lang else "en", "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "spans", "items", "hit", "c", "n", "p", "label", "kind", "score", "text_key", "id", "salt", "length", "k", "start")
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
