"""The registered queries against their SQL in DuckDB, on the smallest tables; and what their plans look like."""

import os
import re

import pytest

import __spark_entry__
from graphloom import workload
from graphloom.sparql.parser import Parser, QueryError

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@needs_tables
@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, duck, name):
    df = workload.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    q = duck.sql(workload.ORACLES[name])
    assert sorted(q.columns) == names
    assert got == sorted((tuple(r[q.columns.index(c)] for c in names) for r in q.fetchall()), key=repr)


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_plans(spark):
    text = plan(workload.QUERIES["sparql_star_scan"](spark, SMALL))
    assert text.count("FileScan") == 1 and "Exchange" not in text  # a star over a keyed table is one scan
    assert re.search(r"c_mktsegment#\d+ = BUILDING", text)
    text = plan(workload.QUERIES["sparql_constant_iri"](spark, SMALL))
    assert re.search(r"c_custkey#\d+L? = 17", text)  # templates are inverted to column conditions
    assert not re.search("Python|Pandas", plan(workload.QUERIES["fn_strings"](spark, SMALL)))
    text = plan(workload.QUERIES["shop_graph"](spark, SMALL))
    assert text.count("FileScan") <= 5 + 2 * 4  # one for each table, two for each join


def test_parser_errors():
    for bad in ("SELECT", "SELECT ?x WHERE { ?x", "SELECT ?x WHERE { ?x ex:p ?y }", "INSERT DATA { <a> <b> <c> }", "SELECT ?x WHERE { ?x <p> ?y } nonsense", "SELECT ?x FROM <g> WHERE { ?x <p> ?y }", "SELECT ?x FROM NAMED <g> { ?x <p> ?y }"):
        with pytest.raises(QueryError):
            Parser(bad).parse()
