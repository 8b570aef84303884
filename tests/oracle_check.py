"""Compare registered queries with their SQL on DuckDB: names, row count, values."""

import datetime
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return "nan" if v != v else repr(round(v, 6) + 0.0)
        if isinstance(v, datetime.datetime):
            v = v.date() if v.time() == datetime.time(0) else v
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    got, gn = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want, wn = canonical(cur.fetchall(), [d[0] for d in cur.description])
    if gn != wn:
        return f"columns {set(gn) ^ set(wn)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(n, x, y) for n, x, y in zip(gn, a, b) if x != y]
        return f"{len(bad)} of {len(got)} rows differ: {a[:3]} {diff[:6]}"
    return f"ok {len(got)}" if got else "EMPTY"


def main(sf, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from barloom.session import local_session
    spark = local_session()
    con = connect(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    for n in names or list(os_):
        t = time.time()
        try:
            res = compare(spark, con, n, qs[n], os_[n], sf)
        except Exception as ex:  # report and go on
            res = "ERROR " + str(ex)[:600]
        print(f"{n:22s} {time.time() - t:6.2f}s {res}", flush=True)
    for n in set(os_) - set(qs):
        print("no query for", n)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
