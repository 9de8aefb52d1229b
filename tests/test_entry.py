"""The registered queries: names, and those with SQL against DuckDB on the smallest tables."""

import glob
import inspect
import os

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def cells(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(one(r[i]) for i in at) for r in rows)


@needs_data
def test_engine_queries(spark):
    import duckdb

    from tracewell.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert set(SQL) <= set(QUERIES)
    for name in ("product_details", "lru_hits", "next_use", "last_percentiles", "write_expiry", "ring_owners", "log_file_replay", "trace_dense_ids", "distinct_hll"):
        got, want = QUERIES[name](spark, DATA), con.execute(SQL[name])
        assert cells(got.columns, got.collect()) == cells([c[0] for c in want.description], want.fetchall()), name


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workloads_are_registered_in_full(monkeypatch):
    from tracewell import queries

    seen = []
    monkeypatch.setattr(queries.matrix, "ranking", lambda results, workload, capacity: results)
    real = inspect.signature(queries.matrix.hit_ratio_matrix)

    def record(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)

    monkeypatch.setattr(queries.matrix, "hit_ratio_matrix", record)
    queries.QUERIES["workload_matrix"](None, DATA)
    queries.QUERIES["workload_ranking"](None, DATA)
    assert [a["requests"] for a in seen] == [300_000] * 2 and [tuple(a["seeds"]) for a in seen] == [(1, 2, 3)] * 2
    assert tuple(seen[0]["capacities"]) == (50, 200, 1000) and seen[0]["workloads"] is None and len(seen[0]["policies"]) == 12


def test_expire_all_is_reported(spark):
    from tracewell.queries import QUERIES

    assert [tuple(r) for r in QUERIES["chaos_expire_all"](spark, DATA).collect()] == [("expire-all", 0, 64, 0.0)]
