"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.11g}")
    if isinstance(v, (date, datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def difference(df, con, text: str) -> str | None:
    """None when equal, otherwise what differs."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        more, less = ours[1] - theirs[1], theirs[1] - ours[1]
        return (
            f"{sum(ours[1].values())} rows against {sum(theirs[1].values())}; {ours[0]}; only here "
            f"{list(more)[:4]}; only in SQL {list(less)[:4]}"
        )
    return None
