"""Table folders and row normalisation shared by the tests (import these from here,
never from a conftest: each folder has its own)."""

import datetime as dt
import math
from decimal import Decimal

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def sorted_rows(rows):
    out = [tuple(norm(x) for x in r) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted_rows([tuple(r[c] for c in cols) for r in df.collect()])


def duck_rows(rel, cols):
    idx = [rel.columns.index(c) for c in cols]
    return sorted_rows([tuple(r[i] for i in idx) for r in rel.fetchall()])
