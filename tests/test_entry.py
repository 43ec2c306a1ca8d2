"""The driver's contract: every SQL has a query, and a sample of them agrees with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rate_global", "moving_std_hop", "step_upsample_asof", "box_resample", "topk_best", "mae_shift", "interp_linear_fill", "dft_peak", "random_distortion", "pad_frames", "hrv_sdnn_sequences", "overlay_sequences", "detrend", "bandpass"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    key = lambda r: tuple("-" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r)
    got = [tuple(r[c] for c in cols) for r in entry.queries()[name](spark, SF).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want.select(", ".join(cols)).fetchall()))
