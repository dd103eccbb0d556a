"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(scols, srows, dcols, drows):
    if sorted(scols) != sorted(dcols):
        return f"columns differ: {sorted(scols)} vs {sorted(dcols)}"
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = sorted((tuple(norm(r[i]) for i in si) for r in srows), key=_key)
    b = sorted((tuple(norm(r[i]) for i in di) for r in drows), key=_key)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first differing row: {x} vs {y}"
    return None
