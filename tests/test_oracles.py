"""Every query of the library against its SQL twin on the smallest tables."""

import pytest

from lectern.plans import registry
from tests.compare import connection, same
from tests.conftest import SF

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(registry.queries()[name](spark, SF), con, ORACLES[name])


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0


def test_library_does_not_import_llm():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['lectern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
