"""Rows of a query and of its SQL, as sorted texts."""

from __future__ import annotations

import math


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([cell(r[i]) for i in order]) for r in rows)


def same(df, db, sql):
    cursor = db.cursor()
    result = cursor.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
