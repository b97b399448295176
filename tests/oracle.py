"""Side-by-side check: a Spark query against its SQL in an in-process database."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def compare(df, con, sql):
    """Empty text if both agree, else the first difference."""
    result = con.execute(sql)
    sql_names, sql_rows = _rows([d[0] for d in result.description], result.fetchall())
    names, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if len(rows) != len(sql_rows):
        return f"rows {len(rows)} / {len(sql_rows)}: {[r for r in rows if r not in sql_rows][:2]} / {[r for r in sql_rows if r not in rows][:2]}"
    for mine, theirs in zip(rows, sql_rows):
        if repr(mine) != repr(theirs):
            return f"values {names}: {mine!r:.600} / {theirs!r:.600}"
    return ""
