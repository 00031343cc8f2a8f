import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, size: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{size}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{size}/{t}.parquet'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def same_as_sql(spark, query, sql: str, size: str):
    df = query(spark, f"{DATA}/{size}")
    names, want = sql_rows(sql, size)
    assert sorted(df.columns) == sorted(names)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in want), key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []
