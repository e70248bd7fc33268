"""Compare named queries with their SQL in DuckDB.

    python -m siftline.checks FOLDER [name ...]
"""
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    """A comparable form of a cell from either engine."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ in ("ndarray",):
        return tuple(plain(v) for v in value.tolist())
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def duckdb_rows(folder, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, build, sql):
    """(matches, spark rows, message)"""
    df = build(spark, folder)
    got = normalised(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), "rows only"
    want = normalised(*duckdb_rows(folder, sql))
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, len(got[1]), f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return False, len(got[1]), f"first difference\n   spark {a}\n   check {b}"
    return True, len(got[1]), ""


def main(args):
    from siftline.plans import catalog
    from siftline.session import build_session

    folder, names = args[0], args[1:] or list(catalog.QUERIES)
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in names:
        start = time.time()
        try:
            ok, n, message = compare(spark, folder, catalog.QUERIES[name], catalog.CHECK_SQL.get(name))
        except Exception as error:  # a failing query is reported, the others still run
            ok, n, message = False, 0, f"{type(error).__name__}: {str(error)[:1500]}"
        if ok is False:
            bad.append(name)
        state = {True: "match", False: "DIFF", None: "rows"}[ok]
        print(f"{state:6}{name:28}{n:8} rows {time.time() - start:6.1f}s {message}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not fine: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
