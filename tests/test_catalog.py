"""Every catalog query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tracelens.plans.catalog import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not pd.api.types.is_scalar(v):
        return "[" + ",".join(plain(x) for x in list(v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and math.isnan(v) or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, (int, float)) or type(v).__module__ in ("numpy", "decimal"):
        try:
            return f"{float(v):.6g}" if not type(v).__name__.startswith("bool") else str(bool(v))
        except (TypeError, ValueError):
            return str(v)
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(db.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_flagship(spark):
    out = flagship(spark, SF).toPandas()
    agreed = {f"src{k}" for k in range(20) if k % 3}
    assert set(out["profile_id"]) <= agreed and len(out)
    assert out["score"].notna().all() and out["hours"].map(len).eq(24).all()
