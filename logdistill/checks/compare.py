"""Run registered queries against their DuckDB statements on one data directory."""

from __future__ import annotations

import math
import time
from pathlib import Path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return v
    return int(v) if hasattr(v, "__index__") else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


# Python workers and joins without an equal key do not belong into any query's plan.
UNWANTED = (
    "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


def check(spark, con, query, sql: str | None, sf_dir: str) -> dict:
    """Compare one query; the result tells rows on both sides and the first differences."""
    begin = time.time()
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    unwanted = [word for word in UNWANTED if word in plan]
    if unwanted:
        return {"ok": False, "detail": f"plan holds {unwanted}"}
    names, rows = _rows(df.columns, df.collect())
    result = {"rows": len(rows), "seconds": round(time.time() - begin, 2), "ok": True}
    if sql is None:
        return result
    cur = con.execute(sql)
    duck_names, duck_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    result["oracle_rows"] = len(duck_rows)
    if names != duck_names:
        result.update(ok=False, detail=f"columns {names} against {duck_names}")
    elif rows != duck_rows:
        mine, theirs = set(map(repr, rows)), set(map(repr, duck_rows))
        result.update(
            ok=False,
            detail={
                "only_spark": sorted(mine - theirs)[:3], "only_duckdb": sorted(theirs - mine)[:3],
                "differ": len(mine - theirs),
            },
        )
    return result
