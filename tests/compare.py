"""Run registered queries against their DuckDB oracle and compare names, types and values."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(arrow) -> list:
    names = sorted(arrow.column_names)
    columns = [[_plain(v) for v in arrow.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr) if columns else []


def compare(spark, con, root, name, make, sql) -> dict:
    start = time.time()
    got = make(spark, root).toArrow()
    took = time.time() - start
    out = {"query": name, "rows": got.num_rows, "spark_sec": round(took, 2)}
    if sql is None:
        return out | {"ok": True, "note": "rows only"}
    start = time.time()
    want = con.execute(sql).to_arrow_table()
    out["duck_sec"] = round(time.time() - start, 2)
    problems = []
    if sorted(got.column_names) != sorted(want.column_names):
        problems.append(f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}")
    else:
        for n in got.column_names:
            a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
            a, b = a.replace(", tz=UTC", "").replace("large_", ""), b.replace(", tz=UTC", "").replace("large_", "")
            if a.split("<")[0] != b.split("<")[0]:
                problems.append(f"type of {n}: {a} vs {b}")
        if got.num_rows != want.num_rows:
            problems.append(f"rows {got.num_rows} vs {want.num_rows}")
        a, b = rows_of(got), rows_of(want)
        if a != b:
            sa, sb = set(a), set(b)
            problems.append(f"values: {len(sa - sb)} extra {list(sa - sb)[:2]} / {len(sb - sa)} missing {list(sb - sa)[:2]}"
                            f" columns {sorted(got.column_names)}")
    return out | {"ok": not problems, "problems": problems}


def main(root: str, only: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = connect(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    chosen = [n for n in queries if not only or any(n == o or (o.endswith("*") and n.startswith(o[:-1])) for o in only)]

    def check(name: str) -> dict:
        try:
            return compare(spark, con.cursor(), root, name, queries[name], oracle.get(name))
        except Exception as exc:  # report every failing query, not only the first
            if len(only) == 1:
                traceback.print_exc()
            return {"query": name, "ok": False, "problems": [str(exc)[:700]]}

    workers = int(os.environ.get("COMPARE_WORKERS", "1"))
    for res in ThreadPoolExecutor(workers).map(check, chosen):
        name = res["query"]
        bad += not res["ok"]
        print(("OK  " if res["ok"] else "FAIL"), res, flush=True)
        if res.get("rows") == 0:
            print("WARN empty result:", name, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
