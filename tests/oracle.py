"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os

FOLDER = os.environ.get("FJORDMILL_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T", " ")
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return v if isinstance(v, (bool, int)) else str(v)


def connection():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in glob.glob(FOLDER + "/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def same_rows(spark, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, FOLDER)
    cur = connection().execute(e.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in data), key=str)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)
