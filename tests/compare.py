"""Run registered queries beside their SQL in DuckDB and compare the sorted rows.

    python tests/compare.py [scale factor] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, sf_dir, run, sql) -> tuple[str, int]:
    """An empty text when both sides agree, and the row count."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(tuple(r[n]) if isinstance(r[n], list) else r[n] for n in names) for r in df.collect())
    if sql is None:
        return "", sum(mine.values())
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}", sum(mine.values())
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    if mine == theirs:
        return "", sum(mine.values())
    return (
        f"{sum(mine.values())} rows against {sum(theirs.values())}; "
        f"only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    ), sum(mine.values())


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from relgraph.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = local_session("compare", "local[8]", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connection(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            found, rows = differences(spark, con, sf_dir, run, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            found, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(found)
        kind = "ok  " if not found else "BAD "
        print(f"{kind}{name:32} {rows:8} rows {time.time() - began:6.1f}s {'' if name in sqls else '(no SQL)'} {found}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
