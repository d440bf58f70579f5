"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from brickwork import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that round or compare doubles, which also run on larger tables, where more values fall on a border.
LARGER = "score_application score_scheme score_company score_legacy perf_rating perf_trend contract_risk gap_rating gap_revenue epc_strategies fuzzy_match dedupe_pairs jsonld page_rents".split()
#: Queries that SQL can't express; tests/test_operators.py and tests/test_webdata.py hold them against plain Python.
NO_SQL = {"address_match", "sequence_match"}


def connection(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.fixture(scope="module")
def larger():
    return connection(SF.replace("0.001", "0.01"))


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


def compare(spark, con, name, folder):
    df = registry.QUERIES[name](spark, folder)
    got = rows(df.columns, df.collect())
    found = con.execute(registry.ORACLE_SQL[name])
    assert got == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, name, SF)


@pytest.mark.parametrize("name", LARGER)
def test_query_equals_sql_on_larger_tables(spark, larger, name):
    compare(spark, larger, name, SF.replace("0.001", "0.01"))


def test_queries_without_sql_are_the_known_ones():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == NO_SQL


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
