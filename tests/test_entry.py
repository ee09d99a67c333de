import duckdb

from conftest import SF0001
import __spark_entry__ as entry_mod
from sigspan.sources.tables import TABLES


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and "x_skew" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(entry_mod.QUERIES) <= set(entry_mod.oracle_sql())


def _norm(v):
    return None if v is None else (round(v, 6) + 0.0 if isinstance(v, float) else v)


def test_small_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF0001}/{t}.parquet'")
    sqls = entry_mod.oracle_sql()
    for name in ["row_index", "segment_profile_20", "window_labels", "spectral_pipeline", "train_test_union", "mae_metric"]:
        df = entry_mod.queries()[name](spark, SF0001)
        cols = sorted(df.columns)
        ours = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
        res = con.execute(sqls[name])
        ocols = [d[0] for d in res.description]
        idx = [ocols.index(c) for c in cols]
        theirs = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
        assert ours == theirs, name
