"""Compare a registered query with its SQL, as row multisets."""

import duckdb


def same(spark, sf_dir, name, tables=("documents", "benchmark", "labels")):
    from pathlib import Path

    from fathom.llm import queries

    con = duckdb.connect()
    for t in tables:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            files = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if Path(f"{sf_dir}/{t}.parquet").is_dir() else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    a, b = sorted((tuple(r) for r in got.select(*columns).collect()), key=key), sorted(rows, key=key)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]][:5] == []
