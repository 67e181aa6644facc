"""Rows of a query and of its SQL, in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def rows_of_sql(sql, folder=None, **frames):
    con = duckdb.connect()
    for t in TABLES if folder else ():
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    for name, frame in frames.items():
        con.register(name, frame)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
