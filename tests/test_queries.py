"""Every registered query against its SQL oracle on the smallest data folder."""

import pytest

import __spark_entry__ as registry
from monofila.checks.oracle import oracle_queries
from monofila.checks.registry import registered
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
ORACLE = oracle_queries()
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) <= set(registry.oracle_sql())


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(registry.queries()[name](spark, FOLDER), duck, ORACLE[name]) is None


def test_modules_that_were_left_out(tmp_path, monkeypatch):
    import __spark_entry__ as registry

    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "half" / "left").mkdir(parents=True)
    (tmp_path / "broken.py").write_text("from os import no_such_name")
    assert registry.optional("no_such_package.queries") is None and registry.optional("half.left.queries") is None
    with pytest.raises(ImportError):
        registry.optional("broken")
