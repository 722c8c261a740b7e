import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/phrasewell-warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = f"{sf}/{f}" if not os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}/*.parquet"
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return c


def plain(v):
    """Values that compare alike whichever engine they come from."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        names = sorted(df.columns)
        got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        at = [rel.columns.index(n) for n in names]
        assert sorted(rel.columns) == names
        want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        norm = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None and not isinstance(v, (bool, str)) else v for v in r) for r in rows]
        assert norm(got) == norm(want)

    return check
