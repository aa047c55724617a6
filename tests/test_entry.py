import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyjoin.plans import registry
from tests.test_operators import shuffled_rows

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df, sql = registry.QUERIES[name](spark, DATA), con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    want = [tuple(plain(r[sql.columns.index(c)]) for c in order) for r in sql.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_join_alignment_of_null_customers_sorts_no_copies(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else i % 3, "O") for i in range(120)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").repartition(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.QUERIES["join_alignment"](spark, str(tmp_path))
    assert set(map(tuple, got.collect())) == set(con.sql(registry.ORACLE_SQL["join_alignment"]).fetchall())
    assert got.count() > 3_000 and shuffled_rows(got) <= 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_the_rest_works_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tallyjoin.llm") or name.startswith("tallyjoin.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "pk_join" in q and "pipeline" not in q and not any(x.startswith("op") and x[2].isdigit() for x in q)
assert set(e.oracle_sql()) == set(q)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tallyjoin").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallyjoin.llm" not in p.read_text()
