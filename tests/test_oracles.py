"""Every registered query against its SQL on the driver's tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The operators for training text are tested in a folder of their own.
TRAINING_TEXT = re.compile(r"op\d+_|pipeline$")
QUERIES, ORACLES = (
    {k: v for k, v in found.items() if not TRAINING_TEXT.match(k)}
    for found in (entry_module.queries(), entry_module.oracle_sql())
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    yield con
    con.close()


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.codegen.wholeStage": "true",
        "spark.sql.codegen.factoryMode": "FALLBACK",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=str)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    want_columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(want_columns)
    want = _sorted_rows(want_columns, result.fetchall())
    assert _sorted_rows(got.columns, map(tuple, got.collect())) == want


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["rw", "set_idx", "n_lines", "center"]
    assert df.count() == 35
