import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


def same(spark, name, query, sql, sf=SF):
    """The query's rows equal the SQL's, and there are some."""
    import glob

    import duckdb

    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(f).stem} AS FROM '{f}'")
    got = query(spark, sf)
    cols = sorted(got.columns)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    a = sorted((tuple(r) for r in got.select(cols).collect()), key=repr)
    b = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in want.fetchall()), key=repr)
    assert sorted(names) == cols and a, name
    assert a == b, name
