"""Compare a query with its DuckDB oracle, order apart."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: None if v is None or v != v else str(v.tolist() if hasattr(v, "tolist") else v).removesuffix(".0")) if not df[c].isna().all() else None
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def expected(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con.sql(sql).df()


def matches(got, sql: str, folder: str) -> bool:
    a, b = frame(got), frame(expected(sql, folder))
    return list(a.columns) == list(b.columns) and len(a) == len(b) and a.astype(str).equals(b.astype(str))
