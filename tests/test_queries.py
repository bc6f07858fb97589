"""Every registered query of the matrix part against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from shardloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    plain = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", [*Q.SQL])
def test_matches_sql(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    sql = db.execute(Q.SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, sql.fetchall())


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_all_diagonals_hold_every_entry(spark):
    found = Q.all_diagonals(spark, SF).collect()
    got = sorted((r.diag_offset, int(row), int(v)) for r in found for row, v in zip(r.rows.split(","), r.vals.split(","), strict=True))
    want = sorted((r.col - r.row, r.row, int(r.value)) for r in Q.entries(spark, SF).collect())
    assert got == want and len(want) > 5000
