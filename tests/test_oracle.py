"""Every query of the image engine against its SQL, run by another engine on the same tables."""

import math

import duckdb
import pytest

from mosaiq.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def tables(sf_dir):
    made = duckdb.connect()
    made.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    yield made
    made.close()


def plain(v):
    return round(v, 4) if isinstance(v, float) and math.isfinite(v) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str), sorted(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, tables):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    answer = tables.execute(SQL[name])
    want = rows_of([c[0] for c in answer.description], answer.fetchall())
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    for g, w in zip(got[0], want[0], strict=True):
        assert all(a == pytest.approx(b, abs=1e-3) if isinstance(b, float) else a == b for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
