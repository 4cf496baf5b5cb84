"""Pages that share a URL: what is once in the SQL comes once."""

import duckdb

from tests.conftest import rows_of, sql_rows


def test_broken_links_of_pages_that_share_a_url(spark, tmp_path):
    from driftloom.oracles import ORACLES
    from driftloom.queries import QUERIES

    anchors = lambda n: "<p>" + "".join(f'<a href="/p/{"a" * (k + 1)}.html">x</a>' for k in range(n)) + "</p>"
    rows = [(0, "https://e.example.com/i", anchors(6)), (1, "https://e.example.com/i", anchors(8)), (2, "https://e.example.com/j", anchors(6))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        df = QUERIES["broken_links"](spark, str(tmp_path))
        got = rows_of(df)
        assert got and got == sql_rows(c, ORACLES["broken_links"], sorted(df.columns))
