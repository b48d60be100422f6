"""Every query of the catalog on the smallest tables, against its SQL where it has one."""

import os

import pytest

from quiremill.plans import registry

SF_DIR = os.environ.get("QUIREMILL_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SF_DIR):
        db.execute(f"create view {name.split('.')[0]} as select * from '{SF_DIR}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, tmp_path, name):
    registry.queries()[name](spark, SF_DIR).write.parquet(str(tmp_path / "out"))
    sql = registry.oracle_sql().get(name)
    found = duck.execute(f"select count(*) from '{tmp_path}/out/*.parquet'").fetchall()[0][0]
    if sql is None:
        assert found > 0
        return
    columns = [r[0] for r in duck.execute(f"describe {sql}").fetchall()]
    kinds = {r[0]: r[1] for r in duck.execute(f"describe select * from '{tmp_path}/out/*.parquet'").fetchall()}
    assert {r[0]: r[1] for r in duck.execute(f"describe {sql}").fetchall()} == kinds
    own, other = (f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from {t}" for t in (f"({sql})", f"'{tmp_path}/out/*.parquet'"))
    assert duck.execute(f"select * from ({own} except all {other}) limit 3").fetchall() == []
    assert duck.execute(f"select count(*) from ({sql})").fetchall()[0][0] == found
