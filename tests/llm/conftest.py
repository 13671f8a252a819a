import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_data import SCHEMA, rows  # noqa: E402


@pytest.fixture
def make(spark):
    """A documents table from texts, with columns of clashing names."""

    def build(texts, sources=None, ids=None):
        made = rows(texts, sources)
        if ids is not None:
            made = [(i, *r[1:]) for i, r in zip(ids, made, strict=True)]
        return spark.createDataFrame(made, SCHEMA)

    return build

