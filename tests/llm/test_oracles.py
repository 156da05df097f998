import pytest

from skylocus.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == want
