"""Every registered plan against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomstone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_plan_matches_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF)
    theirs = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    got = sorted(tuple(map(plain, r)) for r in ours.select(*names).collect())
    assert got == sorted(tuple(map(plain, r)) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_plan_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 300 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_first_long_words_are_the_first_in_both(spark, tmp_path):
    """Of more than three long words the first three by place count, in the query and in its SQL, repeats aside."""
    import duckdb

    from loomstone.plans import lifecycle

    long = [f"{c * 12}" for c in "zyxwvutsrqponmlkjihgfedcba"]
    spark.createDataFrame([(k, " ".join([long[k], "short", long[k], *long[k + 1 :: 2], *long[:k:3]])) for k in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, " ".join(long[k : k + 1 + k % 4])) for k in range(26)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, lifecycle.text_fallback(spark, str(tmp_path)).collect())) == sorted(con.execute(lifecycle.SQL["R19_text_fallback"]).fetchall())


def test_suppliers_are_no_parts_of_their_number(spark, tmp_path):
    """Beyond a million parts one has the number that is shown for a supplier; it gets none of that supplier's relations."""
    import datetime as dt

    import duckdb

    from loomstone.plans import knowledge

    spark.createDataFrame([(0,), (50,), (1_000_050,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 50, 50, "A"), (2, 1_000_050, 7, "R"), (3, 9, 0, "N"), (3, 0, 0, "N")], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in (1, 2, 3)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, knowledge.r21(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(knowledge.SQL["R21_local_context"]).fetchall()) and (50, "relations", "50 A 1000050", 1) in got
