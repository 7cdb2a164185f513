"""Run every registered query on Spark and its SQL on DuckDB; compare rows, schema and values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


_SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diffs(spark_df, rel) -> list[str]:
    s_types = {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [f"{c}: spark={s_types[c]} duck={d_types.get(c)}" for c in sorted(s_types)
            if s_types[c] != d_types.get(c)]


def compare(spark_df, con, sql):
    td = type_diffs(spark_df, con.sql(sql))
    if td:
        return False, "types differ: " + "; ".join(td)
    cols = sorted(spark_df.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()]
    rel = con.sql(sql)
    dcols = list(rel.columns)
    if sorted(dcols) != cols:
        return False, f"columns differ: spark={cols} duck={sorted(dcols)}"
    order = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    key = lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff:\n  spark={str(x)[:400]}\n  duck ={str(y)[:400]}"
    return True, f"{len(srows)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from prefspark.session import get_spark
    spark = get_spark("local[8]", 8)
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(q)):
        t = time.time()
        try:
            df = q[name](spark, sf_dir)
            if name not in o:
                n = df.count()
                print(f"ROWS  {name}: {n} rows (no oracle) {time.time()-t:.1f}s", flush=True)
                continue
            ok, msg = compare(df, con, o[name])
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {name}: {msg} {time.time()-t:.1f}s", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
