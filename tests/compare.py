import os

import duckdb

DATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    return repr(round(float(x), 9)) if isinstance(x, float) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())
