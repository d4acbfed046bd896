"""Run a query in Spark and its statement in DuckDB and compare the two results."""

import datetime as dt
import decimal
import sys
import threading
import time

import duckdb

from rolecall.workload.tables import TABLES


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, float):
        return repr(round(value, 9))
    return repr(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, name, queries, sql, folder):
    """Empty text if both agree, else a short account of the difference."""
    df = queries[name](spark, folder)
    result = con.execute(sql[name])
    want_columns = [c[0] for c in result.description]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    want = lines(want_columns, result.fetchall())
    got = lines(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{len(got)} rows, want {len(want)}; only Spark {extra[:3]}; only SQL {missing[:3]}"


def main(folder, names):
    import __spark_entry__ as entry
    from rolecall.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        watch = threading.Timer(110, spark.sparkContext.cancelAllJobs)
        watch.start()
        try:
            if name in sql:
                text = difference(spark, con, name, queries, sql, folder)
            else:
                text = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as problem:  # noqa: BLE001
            text = f"{type(problem).__name__}: {str(problem)[:600]}"
        watch.cancel()
        bad += bool(text) and not text.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s {text or 'ok'}", flush=True)
    print("different:", bad, "of", len(names or queries))


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1], sys.argv[2:])
