"""Run a registered query and its SQL oracle side by side and compare row multisets."""

import math
from collections import Counter

import duckdb

from courtflow.plans.inputs import TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v != 0 else 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir):
    con = duckdb.connect()
    for t in sorted(TABLES):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


KIND = {"bigint": "i", "int": "i", "double": "f", "string": "s", "boolean": "b",
        "BIGINT": "i", "INTEGER": "i", "DOUBLE": "f", "VARCHAR": "s", "BOOLEAN": "b"}


def differences(df, con, sql, show=5):
    """Empty string when equal, else a description."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(df.dtypes)
    odd = [(n, types[n], kinds[n]) for n in names
           if KIND.get(types[n], types[n]) != KIND.get(kinds[n], kinds[n])]
    if odd:
        return f"types differ: {odd}"
    order = sorted(names)
    a = Counter(tuple(norm(r[n]) for n in order) for r in df.collect())
    b = Counter(tuple(norm(r[names.index(n)]) for n in order) for r in theirs)
    if a == b:
        return ""
    out = [f"rows {sum(a.values())} vs {sum(b.values())}; columns {order}"]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    out += [f"  spark only: {x}" for x in sorted((a - b), key=key)[:show]]
    out += [f"  oracle only: {x}" for x in sorted((b - a), key=key)[:show]]
    return "\n".join(out)
