"""Every core query against its SQL on the smallest tables."""

import json
import os

import duckdb
import pytest

from freshet import queries as Q

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/sf0.001/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    return "null" if v is None else f"{v + 0.0:.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    df = Q.queries()[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in Q.oracle_sql():
        assert got
        return
    cursor = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_cell_histories_read_every_row(spark):
    """Each row of lineitem is in a cell's history, and both fits occur."""
    d = f"{DATA}/sf0.001"
    rows = Q.queries()["agg14_reach_thresholds_from_history"](spark, d).select("metadata_json").collect()
    counts = [json.loads(r.metadata_json)["sample_count"] for r in rows]
    assert sum(counts) == spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert min(counts) < 10 <= max(counts)


def test_parsing_of_odd_events_against_sql(spark, tmp_path):
    """Events without a user, with a negative one, a NaN or an infinite value: the SQL has the query's rule."""
    con = duckdb.connect()
    users, values = "[NULL, -7, 0, 9000000000]", "['NaN'::DOUBLE, NULL, '-Infinity'::DOUBLE, -0.0, 1e-7]"
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-02-28 23:59:59.5' + to_days(i::INTEGER) AS ts, {users}[1 + abs(i) % 4]::BIGINT AS user_id, {values}[1 + abs(i) % 5] AS value FROM range(-60, 120) r(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = Q.queries()["scl_parsing"](spark, str(tmp_path))
    got = sorted(tuple(norm(v) for v in r) for r in df.collect())
    assert got == sorted(tuple(norm(v) for v in r) for r in con.execute(Q.oracle_sql()["scl_parsing"]).fetchall())
