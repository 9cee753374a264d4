import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("needs the given tables")
    return FOLDER


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with columns whose names clash with the operators' own."""
    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), 0.5, 1, "x") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, score double, size int, digest string")

    return make


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "one"), (5, "ONE  twoé three four five"), (6, "word " * 60000)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and white texts, repeated rows and ids, a null id and source, a long text."""
    return make_docs(*ODD, (7, "no source here", None, None))
