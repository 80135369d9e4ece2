"""Compare registered queries with their SQL on DuckDB.

Run as a script: ``python tests/oracle.py DIR [name ...]``.
"""

import datetime
import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime) and value.tzinfo:
        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "varchar": "string", "timestamp": "timestamp_ntz", "hugeint": "HUGEINT"}


def compare(spark, con, directory, run, sql):
    df = run(spark, directory)
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_types = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in res.description}
    want = table(names, res.fetchall())
    problems = []
    if got[0] != want[0]:
        problems.append(f"columns {got[0]} != {want[0]}")
        return problems, len(got[1])
    for c in got[0]:
        a, b = got_types[c], want_types[c]
        if a != b:
            problems.append(f"type of {c}: {a} != {b}")
    if len(got[1]) != len(want[1]):
        problems.append(f"rows {len(got[1])} != {len(want[1])}")
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        problems.append(f"values differ: {got[0]} only spark {sorted(a - b)[:3]} only sql {sorted(b - a)[:3]}")
    return problems, len(got[1])


if __name__ == "__main__":
    import __spark_entry__ as entry
    from opslake.session import local_session

    directory, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(directory)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems, n = compare(spark, con, directory, run, oracles[name])
            else:
                problems, n = ["no oracle"], len(run(spark, directory).collect())
        except Exception as e:  # report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ':4} {name:26} rows={n:<7} {time.time() - start:5.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} problems")
