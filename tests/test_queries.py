"""Every query with SQL against DuckDB, on the smallest tables; the others give rows."""

import duckdb
import pytest
from ruleforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.queries()) <= set(e.queries())


def test_pair_lists_have_short_lines(spark, duck, monkeypatch):
    """A nation of any size is many lines, and no pair is lost."""
    from pyspark.sql import functions as F
    from ruleforge.plans import registry_files

    paths, write = [], registry_files.lines
    monkeypatch.setattr(registry_files, "LISTED", 8, raising=False)
    monkeypatch.setattr(registry_files, "lines", lambda *a: paths.append(write(*a)) or paths[-1])
    found = registry.queries()["OP009_pair_lists"](spark, "/root/testdata/sf0.01")
    sql = registry.oracle_sql()["OP009_pair_lists"].replace("supplier a", "'/root/testdata/sf0.01/supplier.parquet' a").replace("supplier b", "'/root/testdata/sf0.01/supplier.parquet' b")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(sql).fetchall())
    assert spark.read.text(paths[0]).agg(F.max(F.length("value"))).first()[0] < 200
