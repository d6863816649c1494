"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import catalogues

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: f for c in catalogues() for name, f in c.queries.items()}
SQL = {name: sql for c in catalogues() for name, sql in c.sql.items()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
    if isinstance(x, datetime):
        return x.isoformat()[:19]
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_evidence_of_all_documents_against_brute_force(spark):
    from tidemark.plans.series import labelled_evidence

    sf = "/root/testdata/sf0.01"
    pairs = {(*sorted((r.a, r.b)), r.state) for r in labelled_evidence(spark, sf).collect()}
    states = {s: {(a, b) for a, b, t in pairs if t == s} for s in ("exact", "confirmed", "rejected")}
    assert all(max(b for _, b in states[s]) > 900 and sum(a >= 200 for a, _ in states[s]) > 20 for s in states)
    up = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for a, b in (states["exact"] | states["confirmed"]) - states["rejected"]:
        x, y = sorted((top(a), top(b)))
        if x != y:
            up[y] = x
    got = {r.node: r.group_id for r in QUERIES["evidence_components"](spark, sf).collect()}
    assert len(got) == 1000 and all(g == top(n) for n, g in got.items())
    assert sum(top(a) != top(b) for a, b in states["rejected"]) > 20
