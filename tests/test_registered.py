"""Every registered query beside its reference SQL, on the smallest tables."""

import re
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402
from gleanworks.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
WITHOUT_SQL = set()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="session")
def outcomes(spark):
    """All comparisons, several at a time; each thread has its own DuckDB connection."""
    def run(name):
        try:
            return name, compare.compare(spark, compare.duck(FOLDER), name, FOLDER)[0]
        except Exception as error:
            return name, f"FAILED {type(error).__name__}: {str(error)[:400]}"

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(outcomes, name):
    assert outcomes[name] == ("rows only" if name in WITHOUT_SQL else "same")


def test_every_query_but_the_listed_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["lang", "status", "n", "avg_score"] and df.count() > 0


@pytest.mark.parametrize("group, last, gaps", [
    ("s", 29, {11}), ("p", 27, {3, 17}), ("v", 26, {10, 19}), ("j", 13, set()), ("a", 25, set()), ("w", 10, set()), ("l", 6, set()),
    ("u", 2, set()), ("f", 30, set()), ("x", 20, set()), ("t", 12, set()), ("e", 6, set()),
])
def test_inventory_is_covered(group, last, gaps):
    present = {int(m.group(1)) for m in (re.match(rf"{group}(\d\d)_", name) for name in QUERIES) if m}
    assert present == set(range(1, last + 1)) - gaps


def test_every_outcome_and_kind_of_mention_occurs(spark):
    outcomes = {(r.status, r.reason) for r in QUERIES["x10_nlp_gate"](spark, FOLDER).select("status", "reason").distinct().collect()}
    assert outcomes == {("COMPLETED", None), ("FAILED", "LOW_CONFIDENCE"), ("FAILED", "UNREADABLE")}
    kinds = {r.type for r in QUERIES["x06_entities"](spark, FOLDER).select("type").distinct().collect()}
    assert kinds >= {"DRUG", "CONDITION", "DOSAGE", "CLINICAL_TRIAL", "INTERACTION", "EMAIL"}
