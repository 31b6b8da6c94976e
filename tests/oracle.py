"""Run a registered query on Spark and its SQL twin on DuckDB and compare."""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_session(cpus: int = 8, shuffle: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("changerisk")
            .config("spark.sql.shuffle.partitions", str(shuffle))
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").getOrCreate())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float, float]:
    from changerisk.workload import ORACLES, QUERIES

    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_rows = df.collect()
    took = time.time() - started
    if name not in ORACLES:
        return ("rows only" if got_rows else "EMPTY"), len(got_rows), took, 0.0
    started = time.time()
    rel = con.sql(ORACLES[name])
    names, types = list(rel.columns), [str(t) for t in rel.types]
    want_rows = rel.fetchall()
    duck = time.time() - started
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", len(got_rows), took, duck
    got, want = rows_of(df.columns, got_rows), rows_of(names, want_rows)
    if got == want:
        odd = [t for t in types if "HUGEINT" in t or "DECIMAL" in t]
        status = "ok" + (f" types {odd}" if odd else "") + ("" if got else " EMPTY")
        return status, len(got), took, duck
    missing = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else []
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
    return (f"DIFF {len(got)} vs {len(want)} cols={sorted(names)}\n   sql only {missing}\n"
            f"   spark only {extra}"), len(got), took, duck


if __name__ == "__main__":
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = spark_session()
    session.sparkContext.setLogLevel("ERROR")
    from changerisk.workload import QUERIES

    connection = connect(sf)
    for query_name in QUERIES:
        if wanted and not any(query_name.startswith(w) for w in wanted):
            continue
        try:
            status, n, a, b = compare(session, connection, query_name, sf)
        except Exception as exc:  # noqa: BLE001 - report every query
            status, n, a, b = f"ERROR {type(exc).__name__} {str(exc)[:700]}", 0, 0.0, 0.0
        print(f"@ {query_name:38s} rows={n:<8d} spark={a:6.1f}s duck={b:5.1f}s {status}", flush=True)
