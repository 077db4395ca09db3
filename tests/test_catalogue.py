"""Every query with an oracle gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from framewright.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(plain(x) for _, x in sorted(v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(repr, (plain([r[c] for c in cols]) for r in df.collect())))
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(map(repr, (plain([r[names.index(c)] for c in cols]) for r in rel.fetchall())))
    assert len(got) == len(want) and got == want


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def exactly(spark, duck_of, name, folder):
    """Rows of a query and of its SQL over tables of a folder, floats by all their bits."""
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()]
    return sorted(map(repr, got)), sorted(map(repr, duck_of.execute(catalogue.ORACLE_SQL[name]).fetchall()))


def test_gains_near_a_half(spark, tmp_path):
    gains = [s * (k + h) * 0.1 / 20 for k in range(5) for s in (1, -1) for h in (0.4999995, 0.49999999, 0.5, 0.5000005, 0.2)] + [9.0, -9.0, 0.0, 1e-9, -1e-9, 0.3, -0.3, 0.1, 0.7, -0.7]
    spark.createDataFrame([(k, gains[k:] + gains[:k]) for k in range(3)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = exactly(spark, c, "joc_roundtrip", tmp_path)
    assert len(got) == 3 and got == want


def test_power_that_looks_like_a_tie(spark, tmp_path):
    # 9.84 ** 2 / 1536 is shown as 0.0630375 and is less
    rows = [(k, k, 1_700_000_000_000_000 + k, "view", v) for k, v in enumerate((9.84, 0.01, -9.84, 110.16, 0.0, 500.0))]
    d = spark.createDataFrame(rows, "event_id long, user_id long, us long, event_type string, value double")
    d.selectExpr("event_id", "user_id", "timestamp_micros(us) AS ts", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = exactly(spark, c, "bin_power", tmp_path)
    assert len(got) == 6 and got == want
