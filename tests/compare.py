"""Run registered queries beside their SQL: python tests/compare.py FOLDER [QUERY...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return v


def rows(names, values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def by_sql(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())


def by_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows(df.columns, df.collect())


def difference(spark, folder: str, query, sql: str) -> tuple[int, str]:
    """The number of rows, and what differs ('' if nothing does)."""
    names, have = by_spark(query(spark, folder))
    want_names, want = by_sql(folder, sql)
    if names != want_names:
        return 0, f"columns {names} {want_names}"
    extra, missing = have - want, want - have
    said = f"extra {sum(extra.values())} {list(extra)[:2]} missing {sum(missing.values())} {list(missing)[:2]}" if extra or missing else ""
    return sum(have.values()), said[:1500]


def main() -> None:
    import __spark_entry__ as e

    from stepaudit.session import session

    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    sqls = e.oracle_sql()
    for name, query in e.queries().items():
        if wanted and not any(name.startswith(w) if w != "ref" else not name.startswith(("op", "pipe")) for w in wanted):
            continue
        t = time.time()
        try:
            n, said = difference(spark, folder, query, sqls[name]) if name in sqls else (len(query(spark, folder).collect()), "rows only")
        except Exception as x:  # noqa: BLE001 - the report goes on
            n, said = -1, f"FAILED {type(x).__name__} {str(x)[:1500]}"
        print(f"{name}: {n} rows, {time.time() - t:.1f} s, {said or 'equal'}", flush=True)


if __name__ == "__main__":
    main()
