"""A session for all tests, DuckDB over the smallest tables, and the comparison of two results."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from furrow.session import build_session

    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(pdf):
    """A result with its columns and rows in order and values in comparable forms."""
    import numpy as np

    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        kind = str(out[c].dtype)
        if kind == "object" or kind.startswith("str"):
            out[c] = out[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(list(v)) if isinstance(v, list | np.ndarray) else str(v))
        elif kind.startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif kind == "bool":
            out[c] = out[c].astype(str)
        else:
            out[c] = out[c].astype(float)
    return out.sort_values(list(out.columns), na_position="last").reset_index(drop=True)


def assert_same(a, b):
    """Two results hold the same rows; numbers may differ in the last places."""
    import pandas as pd

    a, b = normal(a), normal(b)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=2e-6)
