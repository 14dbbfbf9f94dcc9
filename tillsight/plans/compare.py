"""Order-insensitive comparison of two result frames (Spark vs oracle), as pandas."""

from __future__ import annotations

import math


def norm(v):
    import pandas as pd
    if v is None:
        return None
    try:
        if not isinstance(v, (list, tuple, dict)) and pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if len(s) >= 10 and s[10:] in ("", "T00:00:00") else s
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark_pdf, oracle_pdf) -> str | None:
    """None when equal, else a short description of the first difference."""
    sc, sr = rows_of(spark_pdf)
    oc, orows = rows_of(oracle_pdf)
    if sc != oc:
        return f"columns differ spark={sc} oracle={oc}"
    if len(sr) != len(orows):
        return f"rows spark={len(sr)} oracle={len(orows)}"
    diff = [(a, b) for a, b in zip(sr, orows) if a != b]
    if diff:
        return f"{len(diff)} rows differ, e.g. spark={diff[0][0]} oracle={diff[0][1]}"
    return None
