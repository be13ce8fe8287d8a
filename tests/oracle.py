"""Spark rows against DuckDB rows over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return v


def bag(df: pd.DataFrame) -> Counter:
    return Counter(repr([plain(x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


def sql(text: str, sf_dir: str = SF) -> pd.DataFrame:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c.execute(text).df()
