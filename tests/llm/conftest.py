import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ODD = "doc_id long, text string, lang string, source string, n_chars long, n long, row long, kept string, host string, _salt string, token string, part string, own string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with those of operators."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or ""), 7, 8, "k", "h", "s", "t", "p", "o") for r in rows]
        return spark.createDataFrame(full, ODD)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null, empty and blank texts, repeated rows, a very long text, odd characters."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
    return [
        (1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "one two three four five six seven"),
        (2, None), (3, ""), (4, " \t\n \n"), (None, None), (5, long, None, None), (6, "short", "EN-us", ""), (7, "Ünïcode 日本 \U0001f600 text\nwith lines\n\nwith lines", "??", None),
        (8, "x" * 50_000),
    ]
