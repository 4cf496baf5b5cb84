"""Every registered query of the engine against its SQL, and the driver contract."""

import pytest

from tests.conftest import DATA, rows_of, sql_rows


def _names():
    from driftloom.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_against_sql(spark, duck, name):
    from driftloom.oracles import ORACLES
    from driftloom.queries import QUERIES

    df = QUERIES[name](spark, DATA)
    got = rows_of(df)
    if name in ORACLES:
        assert got == sql_rows(duck, ORACLES[name], sorted(df.columns))


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() > 0


def test_rewritten_pages_change_only_where_there_are_links(spark):
    from driftloom import queries

    rows = queries.rewritten_pages(spark, DATA).collect()
    assert any(r["changed"] for r in rows) and len(rows) == queries.pages(spark, DATA).count()
