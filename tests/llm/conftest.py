"""Fixtures for the training-text operators."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
