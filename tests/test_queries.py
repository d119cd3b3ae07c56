"""Every query with SQL gives DuckDB's rows; the folds without SQL are held against plain loops."""

import math

import duckdb
import pytest

from ticklattice.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows, names):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def fold_rows(spark, rows, order):
    by = {}
    for r in sorted(rows.collect(), key=lambda r: tuple(r[c] for c in ("symbol", *order))):
        by.setdefault(r.symbol, []).append(r)
    return by


def test_winsorised_history_equals_a_loop(spark):
    from statistics import mean, median, stdev

    from ticklattice.operators import indicators
    from ticklattice.plans.flow import _ofi

    got = {r.seq: r.z for r in indicators.winsorised_history_z(_ofi(spark, SF), "ofi", 30, 12).collect()}
    for rows in fold_rows(spark, _ofi(spark, SF), ("ts_ms", "seq")).values():
        past = []
        for r in rows:
            last = past[-30:]
            want = (r.ofi - mean(last)) / max(stdev(last), 1e-4) if len(last) >= 12 else None
            assert (got[r.seq] is None) == (want is None) and (want is None or math.isclose(got[r.seq], want, rel_tol=1e-9, abs_tol=1e-9))
            x = r.ofi
            if len(last) > 10:
                m = median(last)
                mad = median(abs(v - m) for v in last)
                x = min(max(x, m - 0.9 * mad), m + 0.9 * mad) if mad > 0 else x
            past.append(x)


def test_every_query_has_sql_or_is_a_fold():
    assert sorted(set(QUERIES) - set(ORACLE)) == ["fusion_signals", "winsorised_ofi_z"]
