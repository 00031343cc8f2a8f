import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def sql_rows(sql: str, size: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{size}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{size}/{t}.parquet'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def same_as_sql(spark, query, sql: str, size: str = "sf0.001"):
    """The query's rows are those of its SQL, in any order."""
    df = query(spark, f"{DATA}/{size}")
    names, want = sql_rows(sql, size)
    assert sorted(df.columns) == sorted(names)
    round9 = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(round9(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(round9, r)) for r in want), key=repr)
