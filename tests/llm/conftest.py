import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

TEXT_ROWS = [
    (0, "The quick brown fox jumps over the lazy dog", "en"),
    (1, "the QUICK brown fox\tjumps over  the lazy dog", "en"),
    (2, None, None),
    (3, "", "de"),
    (4, "  \n\t ", "de"),
    (5, "one", "fr"),
    (6, "two words", "fr"),
    (7, "Ünïcode Straße 東京 and İstanbul", "de"),
    (7, "Ünïcode Straße 東京 and İstanbul", "de"),
    (8, "one", "fr"),
    (9, "a b c " * 30_000, "en"),
    (None, "one", None),
    (None, None, None),
    (10, "The quick brown fox jumps over the lazy dog", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and further columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, lang, 1, "x") for i, t, lang in TEXT_ROWS], "doc_id long, text string, lang string, n long, kept string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def folder():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables")
    return path
