"""Pages whose headings and titles hold references that are cut off or that the queries' SQL does not read."""

import pytest

from quiremill.plans import registry
from quiremill.sources import html

PAGE = '<html lang="en"><head><title>{0}</title></head><body><h1>{0}</h1><p>x</p></body></html>'
TEXTS = ["the&amp;&amp", "token = &quot;73ab", "a &lt;b&gt; &amp;lt; &copy; &middot;", "a&am", "&", "x &copy y", "caf&eacute; &#38; &#x26;", "&amp;quot;"]


@pytest.mark.parametrize("name", ["page_headings", "page_titles"])
def test_references_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    import duckdb

    rows = [(i, f"/{i}", PAGE.format(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert found == sorted(db.execute(registry.oracle_sql()[name]).fetchall()) and len(found) == len(TEXTS)


def test_pages_are_read_with_all_references():
    tree, meta = html.parse(PAGE.format("a &quot;b&quot; &amp").encode())
    assert meta["title"] == 'a "b" &'
