"""Named queries over the star-schema tables, each with DuckDB SQL where SQL can express it.

Floating-point results are rounded to six places on both sides; NaN results are
given as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import expr, kernels
from pulsegrid.operators import asof, augment, detect, elementwise, image, interp, metrics, physio, roi, spectral, topk, windows
from pulsegrid.sources import media
from pulsegrid.sources.tables import event_signals, micros, read, vector_frames, vector_pairs, vector_signals

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ["signal_id"]

EV = "ev AS (SELECT user_id AS signal_id, event_id, epoch_us(ts) AS us, value AS val, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
EM = "em AS (SELECT vec_id AS signal_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS val FROM embeddings)"
PAIR = EM + ", pr AS (SELECT a.signal_id, a.i, a.val AS y_true, b.val AS y_pred FROM em a JOIN em b ON b.signal_id = a.signal_id + 1 AND b.i = a.i)"
FR = EM + ", fr AS (SELECT signal_id AS frame, (i // 8)::INT AS y, (i % 8)::INT AS x, (floor(abs(val) * 1000)::BIGINT % 256)::INT AS p FROM em)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.nanvl(x.cast("double"), F.lit(None).cast("double")), 6)


def _power_sql(nfft: int, low: float, high: float, step: str) -> str:
    """Power of zero-padded 64-sample signals at the frequencies k * step within [low, high]."""
    return f"WITH {EM}, k AS (SELECT k, k * ({step}) AS f FROM (SELECT unnest(range(0, {nfft // 2 + 1})) AS k) WHERE k * ({step}) BETWEEN {low} AND {high}), c AS (SELECT signal_id, k, f, sum(val * cos(-2 * pi() / {nfft} * k * i)) AS re, sum(val * sin(-2 * pi() / {nfft} * k * i)) AS im FROM em, k GROUP BY ALL), pw AS (SELECT signal_id, k, f, re * re + im * im AS p FROM c)"


# --- rates and variability -------------------------------------------------------


def _detections(s: SparkSession, d: str) -> DataFrame:
    return event_signals(s, d).select("signal_id", "us", (F.col("us") / 1e6).alias("t"))


DIFFS = f"WITH {EV}, df AS (SELECT signal_id, us, us / 1e6 AS t, (us / 1e6) - lag(us / 1e6) OVER (PARTITION BY signal_id ORDER BY us) AS d FROM ev)"
RUNS = f"WITH {EV}, g AS (SELECT signal_id, us / 1e6 AS t, us, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY signal_id ORDER BY us)), sq AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS seq_id FROM g), df AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id, seq_id ORDER BY us) AS d FROM sq)"


def _sequences(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("signal_id").orderBy("us")
    e = _detections(s, d).withColumn("n", F.coalesce((F.col("us") - F.lag("us").over(w) > 7_200_000_000).cast("int"), F.lit(0)))
    return e.withColumn("seq_id", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("n")


@query(DIFFS + " SELECT signal_id, CASE WHEN count(d) < 1 OR count(*) FILTER (d = 0) > 0 THEN NULL ELSE round(60 / median(d), 6) END AS rate FROM df GROUP BY signal_id")
def rate_global(s, d):
    return physio.rate_from_detections(_detections(s, d), KEY).select("signal_id", r6("rate").alias("rate"))


@query(RUNS + " SELECT signal_id, CASE WHEN count(d) < 1 OR count(*) FILTER (d = 0) > 0 THEN NULL ELSE round(60 / median(d), 6) END AS rate FROM df GROUP BY signal_id")
def rate_pooled_sequences(s, d):
    return physio.rate_from_sequences(_sequences(s, d), KEY).select("signal_id", r6("rate").alias("rate"))


@query(RUNS + ", q AS (SELECT signal_id, seq_id, CASE WHEN count(d) < 1 OR count(*) FILTER (d = 0) > 0 THEN NULL ELSE 60 / median(d) END AS v, max(t) - min(t) AS w FROM df GROUP BY ALL) SELECT signal_id, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS rate FROM q GROUP BY signal_id")
def rate_weighted_sequences(s, d):
    return physio.rate_from_sequences(_sequences(s, d), KEY, weighted=True).select("signal_id", r6("rate").alias("rate"))


@query(DIFFS + " SELECT signal_id, us, CASE WHEN row_number() OVER (PARTITION BY signal_id ORDER BY us) >= 5 AND count(*) FILTER (d = 0) OVER w = 0 THEN round(60 / quantile_cont(d, 0.5) OVER w, 6) END AS rate FROM df WINDOW w AS (PARTITION BY signal_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_rate_detections(s, d):
    return physio.rolling_rate_by_detections(_detections(s, d).select("signal_id", "us", "t"), KEY, 5).select("signal_id", "us", r6("rate").alias("rate"))


_PREV = f"WITH {EV}, p AS (SELECT signal_id, us, lag(us) OVER (PARTITION BY signal_id ORDER BY us) AS prev FROM ev)"


@query(_PREV + ", x AS (SELECT e.signal_id, e.us, median((j.us - j.prev) / 1e6::DOUBLE) AS m, count(*) FILTER (j.us = j.prev) AS z FROM p e LEFT JOIN p j ON j.signal_id = e.signal_id AND j.us <= e.us AND j.prev > e.us - 172800000000 GROUP BY ALL) SELECT signal_id, us, CASE WHEN z = 0 THEN round(60 / m, 6) END AS rate FROM x")
def rolling_rate_seconds(s, d):
    r = physio.rolling_rate(_detections(s, d), KEY, 0.0, 172_800.0, unit="seconds", time="t")
    return r.select("signal_id", F.round(F.col("t") * 1e6).cast("long").alias("us"), r6("rate").alias("rate"))


@query(DIFFS + ", x AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY us) AS n, sqrt(var_pop(d / 7200000) OVER w) * 1000 AS v, count(*) FILTER (d = 0) OVER w AS z FROM df WINDOW w AS (PARTITION BY signal_id ORDER BY us ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) SELECT signal_id, us, CASE WHEN n >= 10 AND z = 0 THEN round(least(greatest(v, 1.0), 200.0), 4) END AS value FROM x")
def rolling_hrv_sdnn(s, d):
    """SDNN of the last ten detections; a unit of time stands for two hours here."""
    e = _detections(s, d).withColumn("t", F.col("us") / 7.2e12)
    r = physio.rolling_hrv(e, KEY, "sdnn", 10, 10, overlap=9, min_dets=8, min_t=0.0)
    return r.select("signal_id", F.round(F.col("t") * 7.2e12).cast("long").alias("us"), F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


_HRV = "x AS (SELECT signal_id, t, d / 3600 AS d, d / 3600 - lag(d / 3600) OVER (PARTITION BY signal_id ORDER BY us) AS dd FROM df), g AS (SELECT signal_id, count(d) - 1 >= 8 AND max(t) - min(t) >= 10 AS ok, sqrt(var_pop(d)) * 1000 AS sdnn, sqrt(avg(dd * dd)) * 1000 AS rmssd FROM x GROUP BY signal_id)"


def _hours(s, d):
    """Detection times in hours, which stand for seconds here."""
    return _detections(s, d).select("signal_id", (F.col("us") / 1e6 / 3600).alias("t"))


@query(f"WITH {EV}, df AS (SELECT signal_id, us / 1e6 / 3600 AS t, us, us / 1e6 / 3600 - lag(us / 1e6 / 3600) OVER (PARTITION BY signal_id ORDER BY us) AS d FROM ev), g AS (SELECT signal_id, count(d) - 1 >= 8 AND max(t) - min(t) >= 10 AS ok, sqrt(var_pop(d / 2000)) * 1000 AS v FROM df GROUP BY signal_id) SELECT signal_id, CASE WHEN ok THEN round(least(greatest(v, 1.0), 200.0), 4) END AS value FROM g")
def hrv_sdnn(s, d):
    h = _hours(s, d).withColumn("t2", F.col("t") / 2000)
    return physio.hrv_from_detections(h.select("signal_id", F.col("t2").alias("t")), KEY, "sdnn", min_t=10 / 2000).select("signal_id", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


@query(f"WITH {EV}, df AS (SELECT signal_id, us / 1e6 / 7200000 AS t, us, us / 1e6 / 7200000 - lag(us / 1e6 / 7200000) OVER (PARTITION BY signal_id ORDER BY us) AS d FROM ev), x AS (SELECT *, d - lag(d) OVER (PARTITION BY signal_id ORDER BY us) AS dd FROM df), g AS (SELECT signal_id, count(d) - 1 >= 8 AND max(t) - min(t) >= 0.005 AS ok, sqrt(avg(dd * dd)) * 1000 AS v FROM x GROUP BY signal_id) SELECT signal_id, CASE WHEN ok THEN round(least(greatest(v, 1.0), 200.0), 4) END AS value FROM g")
def hrv_rmssd(s, d):
    h = _detections(s, d).select("signal_id", (F.col("us") / 1e6 / 7_200_000).alias("t"))
    return physio.hrv_from_detections(h, KEY, "rmssd", min_t=0.005).select("signal_id", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


@query()
def hrv_lfhf(s, d):
    return physio.hrv_from_detections(_detections(s, d).select("signal_id", (F.col("us") / 1e6 / 14_400).alias("t")), KEY, "lfhf").select("signal_id", r6("value").alias("value"))


@query()
def hr_rolling_from_signal(s, d):
    return physio.hr_from_signal(vector_signals(s, d), KEY, 8.0, window=32).select("signal_id", "i", r6("out").alias("rate"))


@query(_power_sql(480, 1 / 60, 1.0, "1 / 120.0::DOUBLE") + " SELECT signal_id, round(arg_max(f, p) * 60, 6) AS rate FROM pw GROUP BY signal_id")
def rr_from_signal(s, d):
    return physio.rr_from_signal(vector_signals(s, d), KEY, 4.0).select("signal_id", r6("rate").alias("rate"))


@query()
def hrv_from_signal(s, d):
    v = vector_signals(s, d).withColumn("conf", F.lit(0.9))
    return physio.hrv_from_signal(v, KEY, "sdnn", 8.0, 32, conf="conf", min_dets=2, min_t=1.0).select("signal_id", r6("value").alias("value"), "confidence")


# --- element-wise ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def div0_ratio(s, d):
    li = read(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(expr.div0(F.col("l_extendedprice"), F.col("l_discount"))).alias("ratio"))


@query(f"WITH {EV} SELECT signal_id, i, round(coalesce((val - avg(val) OVER (PARTITION BY signal_id)) / nullif(stddev_pop(val) OVER (PARTITION BY signal_id), 0), 0), 6) AS out FROM ev")
def standardize_user(s, d):
    return elementwise.standardize(event_signals(s, d), KEY).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EV} SELECT signal_id, i, round(val - avg(val) OVER (PARTITION BY signal_id) + 1e-9, 6) AS out FROM ev")
def normalize_user(s, d):
    return elementwise.normalize(event_signals(s, d), KEY).select("signal_id", "i", r6(F.col("out") + 1e-9).alias("out"))


@query(f"WITH {EV} SELECT signal_id, i, round(coalesce(val / nullif(stddev_pop(val) OVER (PARTITION BY signal_id), 0), 0), 6) AS out FROM ev")
def scale_user(s, d):
    return elementwise.scale(event_signals(s, d), KEY).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EV}, x AS (SELECT signal_id, i, val - lag(val) OVER (PARTITION BY signal_id ORDER BY i) AS out FROM ev) SELECT signal_id, i, round(out, 6) AS out FROM x WHERE i > 0")
def signal_diff(s, d):
    return elementwise.diff(event_signals(s, d), KEY).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM} SELECT signal_id, i, CASE WHEN val > 0 THEN round(20 * log10(val), 6) WHEN val = 0 THEN -1e9::DOUBLE END AS db FROM em")
def magnitude_db(s, d):
    """Values below zero have no level (NULL), zero has -inf (given as -1e9)."""
    db = expr.mag2db(F.col("val"))
    return vector_signals(s, d).select("signal_id", "i", F.when(db == float("-inf"), -1e9).otherwise(r6(db)).alias("db"))


@query("SELECT p_partkey, greatest(floor(sqrt(0.196202 + (4.0 / p_size) * (4.0 / p_size)) / (4.0 / p_size)), 1)::INT AS ma_size, floor(0.1614 * pow(p_size, 1.9804))::INT AS hr_lambda, floor(4.4248 * pow(p_size, 2.1253))::INT AS rr_lambda FROM part")
def filter_sizes(s, d):
    f_s = F.col("p_size").cast("double")
    return read(s, d, "part").select("p_partkey", expr.moving_average_size(f_s, 4.0).alias("ma_size"), expr.detrend_lambda(f_s, "hr").alias("hr_lambda"), expr.detrend_lambda(f_s, "rr").alias("rr_lambda"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS flag FROM orders")
def str2bool(s, d):
    words = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "P", "1").otherwise("n")
    return read(s, d, "orders").select("o_orderkey", expr.str2bool(words).alias("flag"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey <= 3 THEN 0.01 + (0.1 - 0.01) * o_orderkey / 3.0 WHEN o_orderkey <= 9 THEN 0.1 WHEN o_orderkey <= 1900 THEN 0.01 ELSE 0.001 END, 6) AS lr FROM orders")
def lr_schedule(s, d):
    return read(s, d, "orders").select("o_orderkey", r6(expr.lr_schedule(F.col("o_orderkey"), [9, 1900], [0.1, 0.01, 0.001], 0.01, 3)).alias("lr"))


@query("SELECT l_orderkey, l_linenumber, round((1 - l_discount) * l_quantity + l_discount * l_tax, 6) AS out, round(l_tax - l_quantity, 6) AS dx, round(1 - l_discount, 6) AS dv1, round(l_discount, 6) AS dv2 FROM lineitem")
def linear_combination(s, d):
    c = elementwise.linear_combination(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[r6(v).alias(k) for k, v in c.items()])


# --- windows -----------------------------------------------------------------------

_MIRROR = "m AS (SELECT signal_id, i, val FROM em UNION ALL SELECT signal_id, -1 - i, val FROM em WHERE i < 5 UNION ALL SELECT signal_id, 127 - i, val FROM em WHERE i >= 59)"


@query(f"WITH {EM}, {_MIRROR}, o AS (SELECT signal_id, i, avg(val) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS out FROM m) SELECT signal_id, i, round(out, 6) AS out FROM o WHERE i BETWEEN 0 AND 63")
def moving_average_center(s, d):
    return windows.moving_average(vector_signals(s, d), KEY, 5).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM}, {_MIRROR}, o AS (SELECT signal_id, i, avg(val) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS out FROM m) SELECT signal_id, i, round(out, 6) AS out FROM o WHERE i BETWEEN 0 AND 63")
def moving_average_trailing(s, d):
    return windows.moving_average(vector_signals(s, d), KEY, 5, center=False).select("signal_id", "i", r6("out").alias("out"))


_STD = f"WITH {EM}, o AS (SELECT signal_id, i, val, CASE WHEN i >= 7 THEN stddev_pop(val) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS sd FROM em), f AS (SELECT signal_id, i, val, coalesce(sd, avg(sd) OVER (PARTITION BY signal_id)) AS sd FROM o)"


@query(_STD + " SELECT signal_id, i, round(sd, 6) AS out FROM f")
def moving_std_trailing(s, d):
    return windows.rolling(vector_signals(s, d), KEY, 8, F.stddev_pop, fill="mean").select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM}, x AS (SELECT signal_id, i, val, k FROM em, (SELECT unnest(range(0, 21)) AS k) WHERE i >= 3 * k AND i < 3 * k + 5), v AS (SELECT signal_id, k, CASE WHEN count(*) = 5 THEN stddev_pop(val) END AS v FROM x GROUP BY ALL) SELECT signal_id, i, CASE WHEN count(*) = count(v) THEN round(sum(v) / greatest(count(*) FILTER (v <> 0), 1), 6) END AS out FROM x JOIN v USING (signal_id, k) GROUP BY signal_id, i")
def moving_std_hop(s, d):
    return windows.rolling(vector_signals(s, d), KEY, 5, F.stddev_pop, overlap=2).select("signal_id", "i", r6("out").alias("out"))


@query(f"{_STD}, m AS (SELECT signal_id, i, val FROM em UNION ALL SELECT signal_id, -1 - i, val FROM em WHERE i < 8 UNION ALL SELECT signal_id, 127 - i, val FROM em WHERE i >= 56), a AS (SELECT signal_id, i, avg(val) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS a FROM m) SELECT f.signal_id, f.i, round((f.val - a.a) / f.sd, 6) AS out FROM f JOIN a USING (signal_id, i)")
def windowed_standardize(s, d):
    return windows.windowed_standardize(vector_signals(s, d), KEY, 8).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM}, x AS (SELECT signal_id, i, val, k FROM em, (SELECT unnest(range(0, 15)) AS k) WHERE i >= 4 * k AND i < 4 * k + 8), v AS (SELECT signal_id, k, avg(val) AS v FROM x GROUP BY ALL) SELECT signal_id, i, round(sum(v) / greatest(count(*) FILTER (v <> 0), 1), 6) AS out FROM x JOIN v USING (signal_id, k) GROUP BY signal_id, i")
def rolling_mean_hop(s, d):
    return windows.rolling(vector_signals(s, d), KEY, 8, F.avg, overlap=4).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM} SELECT signal_id, i, round(avg(val) OVER (PARTITION BY signal_id, i // 8), 6) AS out FROM em")
def rolling_mean_tumbling(s, d):
    return windows.rolling(vector_signals(s, d), KEY, 8, F.avg, overlap=0).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM}, o AS (SELECT signal_id, i, CASE WHEN i >= 5 THEN max(abs(val)) OVER w - min(abs(val)) OVER w END AS v FROM em WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT signal_id, i, round(coalesce(v, avg(v) OVER (PARTITION BY signal_id)), 6) AS out FROM o")
def rolling_callable(s, d):
    """A reducer and a transform given as functions."""
    import numpy as np

    return windows.rolling_apply(vector_signals(s, d), KEY, np.ptp, 6, 6, transform=np.abs, fill="mean").select("signal_id", "i", r6("out").alias("out"))


_RANGE = "OVER (PARTITION BY signal_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"


@query(f"WITH {EV} SELECT signal_id, us, count(val) {_RANGE} AS out FROM ev")
def rolling_count_seconds(s, d):
    return windows.rolling_seconds(event_signals(s, d).select("signal_id", "us", "val"), KEY, F.count, 86_400.0).select("signal_id", "us", "out")


@query(f"WITH {EV} SELECT signal_id, us, CASE WHEN us - min(us) OVER (PARTITION BY signal_id) >= 43200000000 THEN round(quantile_cont(val, 0.5) {_RANGE}, 6) END AS out FROM ev")
def rolling_median_seconds(s, d):
    e = event_signals(s, d).select("signal_id", "us", "val")
    return windows.rolling_seconds(e, KEY, lambda c: F.percentile(c, F.lit(0.5)), 86_400.0, 43_200.0).select("signal_id", "us", r6("out").alias("out"))


# --- joins and runs ------------------------------------------------------------------


@query(f"WITH {EV}, m AS (SELECT signal_id, us, val FROM ev WHERE i % 7 = 0) SELECT e.signal_id, e.us, round(m.val, 6) AS v FROM ev e ASOF LEFT JOIN m ON e.signal_id = m.signal_id AND e.us >= m.us")
def step_upsample_asof(s, d):
    e = event_signals(s, d)
    return asof.asof(e, e.where("i % 7 = 0").withColumnRenamed("val", "v"), KEY).select("signal_id", "us", r6("v").alias("v"))


@query(f"WITH {EV}, x AS (SELECT *, val > 50 AS ok FROM ev), y AS (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER (PARTITION BY signal_id ORDER BY us), false) THEN 1 ELSE 0 END AS n FROM x), z AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS seq_id FROM y) SELECT signal_id, seq_id, count(*) AS n, min(us) AS first_us FROM z WHERE ok GROUP BY ALL")
def confidence_runs(s, d):
    r = asof.runs(event_signals(s, d), KEY, "us", F.col("val") > 50)
    return r.groupBy("signal_id", "seq_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


@query(f"WITH {EV}, g AS (SELECT signal_id, us, coalesce(us - lag(us) OVER w, lead(us) OVER w - us)::DOUBLE AS gap FROM ev WINDOW w AS (PARTITION BY signal_id ORDER BY us)), x AS (SELECT *, coalesce(gap > 0.6 * 3.6e10 AND gap < 1.8 * 3.6e10, false) AS ok FROM g), y AS (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER (PARTITION BY signal_id ORDER BY us), false) THEN 1 ELSE 0 END AS n FROM x), z AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS seq_id FROM y) SELECT signal_id, seq_id, count(*) AS n FROM z WHERE ok GROUP BY ALL HAVING count(*) > 1")
def valid_runs(s, d):
    r = detect.valid_runs(event_signals(s, d), KEY, "us", F.lit(3.6e10))
    return r.groupBy("signal_id", "seq_id").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, h AS (SELECT *, i % 5 IN (2, 3) AS bad FROM ev), p AS (SELECT *, last_value(CASE WHEN NOT bad THEN {{'x': i, 'y': val}} END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN NOT bad THEN {{'x': i, 'y': val}} END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM h) SELECT signal_id, i, round(CASE WHEN NOT bad THEN val WHEN p IS NOT NULL AND q IS NOT NULL THEN p.y + (q.y - p.y) * (i - p.x) / (q.x - p.x) ELSE coalesce(p.y, q.y) END, 6) AS out FROM p")
def interp_linear_fill(s, d):
    e = event_signals(s, d).withColumn("val", F.when(~(F.col("i") % 5).isin(2, 3), F.col("val")))
    return interp.fill(e, KEY).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EV}, h AS (SELECT *, abs(val - median(val) OVER (PARTITION BY signal_id)) > 0.3 * median(val) OVER (PARTITION BY signal_id) AS bad FROM ev), p AS (SELECT *, last_value(CASE WHEN NOT bad THEN {{'x': i, 'y': val}} END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN NOT bad THEN {{'x': i, 'y': val}} END IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM h) SELECT signal_id, i, round(CASE WHEN NOT bad THEN val WHEN p IS NOT NULL AND q IS NOT NULL THEN p.y + (q.y - p.y) * (i - p.x) / (q.x - p.x) ELSE coalesce(p.y, q.y, val) END, 6) AS out FROM p")
def interp_skipped(s, d):
    return interp.fill_skipped(event_signals(s, d), KEY).select("signal_id", "i", r6("out").alias("out"))


@query(f"WITH {EM}, dt AS (SELECT signal_id, unnest([16, 32, 48]) AS det_idx FROM (SELECT DISTINCT signal_id FROM em)), x AS (SELECT dt.signal_id, dt.det_idx, e.i, row_number() OVER (PARTITION BY dt.signal_id, dt.det_idx ORDER BY e.val DESC, e.i) AS n FROM dt JOIN em e ON e.signal_id = dt.signal_id AND e.i >= det_idx - 3 AND e.i < det_idx + 3) SELECT signal_id, det_idx, i AS refined FROM x WHERE n = 1")
def refine_peaks(s, d):
    v = vector_signals(s, d)
    dets = read(s, d, "embeddings").select(F.col("vec_id").alias("signal_id"), F.explode(F.expr("array(16L, 32L, 48L)")).alias("det_idx"))
    return detect.refine(v, dets, KEY, 6).select("signal_id", "det_idx", "refined")


# --- metrics and reductions -----------------------------------------------------------


@query(f"WITH {PAIR} SELECT signal_id, round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg((y_true - y_pred) ** 2), 6) AS mse, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(corr(y_true, y_pred), 6) AS cor FROM pr GROUP BY signal_id")
def error_metrics(s, d):
    t, p = F.col("y_true"), F.col("y_pred")
    return vector_pairs(s, d).groupBy("signal_id").agg(*[r6(fn(t, p)).alias(n) for n, (fn, _) in metrics.METRICS.items()])


_SHIFT = f"WITH {PAIR}, sh AS (SELECT t.signal_id, s, t.y_true, p.y_pred FROM pr t, (SELECT unnest(range(-9, 10)) AS s) JOIN pr p ON p.signal_id = t.signal_id AND p.i = t.i - s)"


@query(_SHIFT + ", m AS (SELECT signal_id, s, avg(abs(y_true - y_pred)) AS m FROM sh GROUP BY ALL) SELECT signal_id, round(min(m), 4) AS out FROM m GROUP BY signal_id")
def mae_shift(s, d):
    return metrics.shift_pooled(vector_pairs(s, d), KEY, "mae", 30.0).select("signal_id", F.round(F.col("out").cast("double"), 4).alias("out"))


@query(_SHIFT + ", m AS (SELECT signal_id, s, corr(y_true, y_pred) AS m FROM sh GROUP BY ALL) SELECT signal_id, round(max(m), 4) AS out FROM m GROUP BY signal_id")
def cor_shift(s, d):
    return metrics.shift_pooled(vector_pairs(s, d), KEY, "cor", 30.0).select("signal_id", F.round(F.col("out").cast("double"), 4).alias("out"))


@query(f"WITH {EV}, h AS (SELECT *, CASE WHEN i % 3 > 0 THEN val END AS x FROM ev) SELECT signal_id, round(avg(x), 6) AS nan_mean, round(coalesce(sum(x * 0.5), 0), 6) AS nan_sum FROM h GROUP BY signal_id")
def nan_reductions(s, d):
    x = F.when(F.col("i") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("val"))
    e = event_signals(s, d).withColumn("x", x)
    return e.groupBy("signal_id").agg(r6(metrics.nan_mean(F.col("x"))).alias("nan_mean"), r6(metrics.nan_sum(F.col("x"), 0.5, 0.0)).alias("nan_sum"))


@query(f"WITH {EV} SELECT signal_id, i, CASE WHEN i % 3 > 0 THEN round(1.0 / count(*) FILTER (i % 3 > 0) OVER (PARTITION BY signal_id), 6) ELSE 0 END AS grad, CASE WHEN i % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS grad_sum FROM ev")
def nan_gradients(s, d):
    e = event_signals(s, d).withColumn("x", F.when(F.col("i") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("val")))
    g = metrics.nan_mean_gradient(e, KEY, "x")
    return g.select("signal_id", "i", r6("grad").alias("grad"), metrics.nan_sum_gradient(F.col("x")).alias("grad_sum"))


@query(f"WITH {PAIR} SELECT signal_id, round(avg(CASE WHEN abs(y_true - y_pred) < 1 THEN (y_true - y_pred) ** 2 / 2 ELSE abs(y_true - y_pred) - 0.5 END), 6) AS smooth_l1, round(avg(abs(y_true - y_pred)), 6) AS mae FROM pr GROUP BY signal_id")
def losses(s, d):
    t, p = F.col("y_true"), F.col("y_pred")
    return vector_pairs(s, d).groupBy("signal_id").agg(r6(F.avg(metrics.smooth_l1(t, p))).alias("smooth_l1"), r6(metrics.mae(t, p)).alias("mae"))


@query("WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY 1) SELECT vec_id, e.label, round((SELECT sum(c) FROM c) / c.c / (SELECT count(*) FROM c), 6) AS weight FROM embeddings e JOIN c USING (label)")
def class_weights(s, d):
    return metrics.balanced_weights(read(s, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", "label", r6("weight").alias("weight"))


@query(_power_sql(64, 0.5, 4.0, "0.25::DOUBLE") + ", q AS (SELECT signal_id, sum(p) FILTER (k IN (6, 12)) AS s, sum(p) FILTER (k NOT IN (6, 12)) AS n FROM pw GROUP BY signal_id) SELECT signal_id, round(10 * log10(s / n), 6) AS snr FROM q")
def snr_db(s, d):
    v = vector_signals(s, d).withColumn("f_true", F.lit(1.5))
    return metrics_snr(v)


def metrics_snr(v: DataFrame) -> DataFrame:
    return spectral.snr(v, KEY, 16.0, 0.25).select("signal_id", r6("out").alias("snr"))


# --- spectra ---------------------------------------------------------------------------

_DFT = f"WITH {EM}, c AS (SELECT signal_id, k, sum(val * cos(-2 * pi() / 64 * k * i)) AS re, sum(val * sin(-2 * pi() / 64 * k * i)) AS im FROM em, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL), pw AS (SELECT signal_id, k, re * re + im * im AS p FROM c)"


@query(_DFT + " SELECT signal_id, round(arg_max(k, p) * 0.5, 6)::DOUBLE AS freq FROM pw GROUP BY signal_id")
def dft_peak(s, d):
    return spectral.dft_peak(vector_signals(s, d), KEY, 64, 32.0).select("signal_id", r6("freq").alias("freq"))


@query(_DFT + " SELECT signal_id, round(max(p) / sum(p), 6) AS out FROM pw GROUP BY signal_id")
def periodicity(s, d):
    return spectral.periodicity(vector_signals(s, d), KEY, 64).select("signal_id", r6("out").alias("out"))


@query(_DFT + ", q AS (SELECT label, signal_id, round(max(p) / sum(p), 9) AS o FROM pw JOIN embeddings ON vec_id = signal_id GROUP BY ALL) SELECT label, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o DESC, signal_id) AS n FROM q) WHERE n = 1")
def most_periodic(s, d):
    v = vector_signals(s, d).join(read(s, d, "embeddings").select(F.col("vec_id").alias("signal_id"), "label"), "signal_id")
    return spectral.most_periodic(v, ["label"], "signal_id", 64)


@query(_power_sql(128, 0.5, 12.0, "0.25::DOUBLE") + " SELECT signal_id, round(arg_max(f, p), 6) AS freq FROM pw GROUP BY signal_id")
def freq_periodogram(s, d):
    return spectral.estimate_freq(vector_signals(s, d), KEY, 32.0, (0.5, 12.0), 0.25).select("signal_id", r6("out").alias("freq"))


@query()
def freq_from_peaks(s, d):
    return spectral.estimate_freq(vector_signals(s, d), KEY, 32.0, (0.5, 12.0), method="peak", window=32).select("signal_id", r6("out").alias("freq"))


def _detrend_sql(n: int, lam: float) -> str:
    """z - x where (I + lam^2 D'D) x = z: a factorisation L d L' with two subdiagonals, then both substitutions, by recursion."""
    w = lam * lam
    main = f"(1 + {w} * CASE WHEN i + 1 = {n - 1} THEN 1 WHEN i + 1 IN (1, {n - 2}) THEN 5 ELSE 6 END)"
    one = f"({w} * CASE WHEN i IN (0, {n - 2}) THEN -2 ELSE -4 END)"
    return f"""WITH RECURSIVE {EM},
    cf(i, d, d1, l1, l2) AS (SELECT 0, (1 + {w})::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
        SELECT i + 1, {main} - m2 * m2 * d1 - m1 * m1 * d, d, m1, m2
        FROM (SELECT *, ({one} - m2 * d1 * l1) / d AS m1 FROM (SELECT *, CASE WHEN i > 0 THEN {w} / d1 ELSE 0 END AS m2 FROM cf)) WHERE i < {n - 1}),
    fw(signal_id, i, y, y1) AS (SELECT signal_id, 0, val, 0::DOUBLE FROM em WHERE i = 0 UNION ALL
        SELECT f.signal_id, f.i + 1, e.val - c.l2 * f.y1 - c.l1 * f.y, f.y FROM fw f JOIN em e ON e.signal_id = f.signal_id AND e.i = f.i + 1 JOIN cf c ON c.i = f.i + 1),
    bw(signal_id, i, x, x1) AS (SELECT signal_id, i, y / d, 0::DOUBLE FROM fw JOIN cf USING (i) WHERE i = {n - 1} UNION ALL
        SELECT b.signal_id, b.i - 1, f.y / c.d - o.l1 * b.x - coalesce(t.l2 * b.x1, 0), b.x
        FROM bw b JOIN fw f ON f.signal_id = b.signal_id AND f.i = b.i - 1 JOIN cf c ON c.i = b.i - 1 JOIN cf o ON o.i = b.i LEFT JOIN cf t ON t.i = b.i + 1)
    SELECT e.signal_id, e.i, round(e.val - b.x, 6) AS out FROM em e JOIN bw b ON b.signal_id = e.signal_id AND b.i = e.i"""


@query(_detrend_sql(64, 10.0))
def detrend(s, d):
    return spectral.detrend(vector_signals(s, d), KEY, 10.0).select("signal_id", "i", r6("out").alias("out"))


def _bandpass_sql(b, a, n: int) -> str:
    """The filter (coefficients as designed) forwards and backwards over the signal with mirrored ends, sample by sample by recursion."""
    m, pad = len(a), 3 * len(a)
    size = n + 2 * pad
    b, a = [repr(float(x)) for x in b], [repr(float(x)) for x in a]
    gain = f"(({' + '.join(b)}) / ({' + '.join(a)}))"
    # the state that a constant input of 1 leaves as it is
    start = ["(" + " + ".join(f"{b[q]} - {a[q]} * {gain}" for q in range(k, m)) + ")" for k in range(1, m)]
    z = [f"z{k}" for k in range(1, m)]

    def passes(name: str, source: str) -> str:
        nexts = [f"{f'r.z{k + 1} + ' if k < m - 1 else ''}{b[k]} * x.v - {a[k]} * ({b[0]} * x.v + r.z1)" for k in range(1, m)]
        return f"""{name}(signal_id, j, y, {', '.join(z)}) AS (SELECT signal_id, -1, 0::DOUBLE, {', '.join(f'{c} * v' for c in start)} FROM {source} WHERE j = 0 UNION ALL
        SELECT r.signal_id, r.j + 1, {b[0]} * x.v + r.z1, {', '.join(nexts)} FROM {name} r JOIN {source} x ON x.signal_id = r.signal_id AND x.j = r.j + 1)"""

    return f"""WITH RECURSIVE {EM},
    ex AS (SELECT signal_id, i + {pad} AS j, val AS v FROM em
        UNION ALL SELECT e.signal_id, {pad} - e.i, 2 * o.val - e.val FROM em e JOIN em o ON o.signal_id = e.signal_id AND o.i = 0 WHERE e.i BETWEEN 1 AND {pad}
        UNION ALL SELECT e.signal_id, {pad + 2 * (n - 1)} - e.i, 2 * o.val - e.val FROM em e JOIN em o ON o.signal_id = e.signal_id AND o.i = {n - 1} WHERE e.i BETWEEN {n - 1 - pad} AND {n - 2}),
    {passes('fw', 'ex')},
    tu AS (SELECT signal_id, {size - 1} - j AS j, y AS v FROM fw WHERE j >= 0),
    {passes('bw', 'tu')}
    SELECT signal_id, ({size - 1 - pad} - j)::BIGINT AS i, round(y, 6) AS out FROM bw WHERE j BETWEEN {pad} AND {size - 1 - pad}"""


@query(_bandpass_sql(*kernels.butter_bandpass(1.0, 8.0, 32.0, 2), 64))
def bandpass(s, d):
    return spectral.bandpass(vector_signals(s, d), KEY, 1.0, 8.0, 32.0, 2).select("signal_id", "i", r6("out").alias("out"))


@query()
def resample_filtered(s, d):
    v = vector_signals(s, d).select("signal_id", (F.col("i") / 32.0).alias("t"), F.col("val").alias("s"))
    g = read(s, d, "embeddings").select(F.col("vec_id").alias("signal_id"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k")).select("signal_id", (F.col("k") / 16.0).alias("t_out"))
    return interp.resample(v, g, KEY, band=(0.5, 6.0), order=2).select("signal_id", "i", r6("out").alias("out"))


@query()
def repair_sequence(s, d):
    e = event_signals(s, d).withColumn("val", (F.col("us") / 3.6e9))
    return interp.repair_sequence(e, KEY, max_diff_rel=20.0).select("signal_id", "i", r6("out").alias("out"))


@query()
def repair_outliers(s, d):
    return interp.repair_outliers(event_signals(s, d), KEY).select("signal_id", "i", r6("out").alias("out"))


@query()
def valid_peaks(s, d):
    return detect.valid_peaks(vector_signals(s, d), KEY, 32.0, 32, (0.5, 12.0)).select("signal_id", F.col("seq_id").cast("long").alias("seq_id"), "det_idx")


# --- images and regions -----------------------------------------------------------------

_BOX = "b AS (SELECT s_suppkey AS k, s_suppkey * 7 % 200 AS x0, s_suppkey * 11 % 150 AS y0, s_suppkey * 7 % 200 + 41 + s_suppkey % 50 AS x1, s_suppkey * 11 % 150 + 60 + s_suppkey % 31 AS y1 FROM supplier), q AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b)"


def _boxes(s, d):
    k = F.col("s_suppkey")
    x0, y0 = k * 7 % 200, k * 11 % 150
    return read(s, d, "supplier").select(k.alias("k"), roi.box(x0, y0, x0 + 41 + k % 50, y0 + 60 + k % 31).alias("b"))


def _grown(l, t, r, b):
    return f"x0 - trunc({l} * w)::BIGINT AS x0, y0 - trunc({t} * h)::BIGINT AS y0, x1 + trunc({r} * w)::BIGINT AS x1, y1 + trunc({b} * h)::BIGINT AS y1"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_BOX} SELECT k, '{m}' AS method, {_grown(*c)} FROM q)" for m, c in (("face", (-0.2, -0.1, -0.2, -0.1)), ("forehead", (-0.35, -0.15, -0.35, -0.75)), ("det", (0, 0, 0, 0)), ("none", (0, 0, 0, 0)))))
def roi_from_det(s, d):
    b = _boxes(s, d)
    parts = [b.select("k", F.lit(m or "none").alias("method"), roi.roi_from_det(F.col("b"), m).alias("r")) for m in ("face", "forehead", "det", None)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("k", "method", "r.*")


@query(f"WITH {_BOX}, g AS (SELECT k, {_grown(0.2, 0.2, 0.2, 0.2)} FROM q), c AS (SELECT k, least(greatest(x0, 0), 220) AS x0, least(greatest(y0, 0), 160) AS y0, least(greatest(x1, 0), 220) AS x1, least(greatest(y1, 0), 160) AS y1 FROM g) SELECT k, x0, y0, x1 - (x1 - x0) % 2 AS x1, y1 - (y1 - y0) % 2 AS y1 FROM c")
def roi_clipped_even(s, d):
    return _boxes(s, d).select("k", roi.roi_from_det(F.col("b"), "meta", (220, 160), even=True).alias("r")).select("k", "r.*")


_BODY = [(False, v, c) for v, c in enumerate(roi.UPPER_BODY)] + [(True, v, c) for v, c in enumerate(roi.UPPER_BODY_CROPPED)]


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_BOX}, g AS (SELECT k, {_grown(*c)} FROM q) SELECT k, {str(cut).lower()} AS cropped, {v} AS version, least(greatest(x0, 0), 220) AS x0, least(greatest(y0, 0), 160) AS y0, least(greatest(x1, 0), 220) AS x1, least(greatest(y1, 0), 160) AS y1 FROM g)" for cut, v, c in _BODY))
def roi_upper_body(s, d):
    """All versions of the body's region, clipped to the frame."""
    each = [F.struct(F.lit(cut).alias("cropped"), F.lit(v).alias("version"), roi.roi_from_det(F.col("b"), "upper_body_cropped" if cut else "upper_body", (220, 160), version=v).alias("r")) for cut, v, _ in _BODY]
    return _boxes(s, d).select("k", F.explode(F.array(*each)).alias("e")).select("k", "e.cropped", "e.version", "e.r.*")


@query(f"WITH {FR} SELECT frame, y // 2 AS y, x // 2 AS x, (sum(p) // count(*))::INT AS p FROM fr GROUP BY ALL")
def box_resample(s, d):
    return image.box_resample(vector_frames(s, d), ["frame"], (8, 8), (4, 4))


@query(f"WITH {FR}, a AS (SELECT dd, least(greatest((dd + 0.5::DOUBLE) * (8::DOUBLE / 5) - 0.5::DOUBLE, 0), 7) AS pt FROM (SELECT unnest(range(0, 5)) AS dd)), w AS (SELECT dd, floor(pt)::INT AS s, 1 - (pt - floor(pt)) AS w FROM a UNION ALL SELECT dd, least(floor(pt) + 1, 7)::INT, pt - floor(pt) FROM a) SELECT frame, wy.dd::INT AS y, wx.dd::INT AS x, floor(sum(p * floor(wy.w * wx.w * 256)::BIGINT) / 256)::INT AS p FROM fr JOIN w wy ON wy.s = y JOIN w wx ON wx.s = x GROUP BY ALL")
def bilinear_resample(s, d):
    return image.bilinear_resample(vector_frames(s, d), ["frame"], (8, 8), (5, 5))


@query(f"WITH {FR} SELECT frame, round(avg(p)::FLOAT::DOUBLE, 4) AS out FROM fr WHERE x >= frame % 4 AND x < frame % 4 + 3 AND y >= frame % 3 AND y < frame % 3 + 4 GROUP BY frame")
def roi_mean(s, d):
    f = F.col("frame")
    rois = read(s, d, "embeddings").select(F.col("vec_id").alias("frame")).select("frame", (f % 4).alias("x0"), (f % 3).alias("y0"), (f % 4 + 3).alias("x1"), (f % 3 + 4).alias("y1"))
    return image.roi_mean(vector_frames(s, d), rois, ["frame"]).select("frame", F.round(F.col("out").cast("double"), 4).alias("out"))


@query(f"WITH {FR} SELECT frame, round(avg(p)::FLOAT::DOUBLE, 4) AS r, round(avg(p * 7 % 256)::FLOAT::DOUBLE, 4) AS g, round(avg(p * 13 % 256)::FLOAT::DOUBLE, 4) AS b FROM fr WHERE x >= frame % 4 AND x < frame % 4 + 3 AND y >= frame % 3 AND y < frame % 3 + 4 GROUP BY frame")
def roi_mean_rgb(s, d):
    f, p = F.col("frame"), F.col("p")
    rois = read(s, d, "embeddings").select(F.col("vec_id").alias("frame")).select("frame", (f % 4).alias("x0"), (f % 3).alias("y0"), (f % 4 + 3).alias("x1"), (f % 3 + 4).alias("y1"))
    rgb = vector_frames(s, d).select("frame", "y", "x", p.alias("r"), (p * 7 % 256).alias("g"), (p * 13 % 256).alias("b"))
    m = image.roi_mean(rgb, rois, ["frame"], ["r", "g", "b"], size=(8, 8))
    return m.select("frame", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in "rgb"])


@query(f"WITH {FR}, b AS (SELECT *, frame % 3 + 1 AS x0, frame % 2 + 2 AS y0, frame % 3 + 5 AS x1, frame % 2 + 5 AS y1 FROM fr) SELECT frame, (least(y1 + trunc(0.2 * (y1 - y0))::BIGINT, 8) - greatest(y0 - trunc(0.2 * (y1 - y0))::BIGINT, 0))::INT AS h, (least(x1 + trunc(0.2 * (x1 - x0))::BIGINT, 8) - greatest(x0 - trunc(0.2 * (x1 - x0))::BIGINT, 0))::INT AS w, string_agg(printf('%02X', p), '' ORDER BY y, x) AS data FROM b WHERE x >= x0 - trunc(0.2 * (x1 - x0))::BIGINT AND x < x1 + trunc(0.2 * (x1 - x0))::BIGINT AND y >= y0 - trunc(0.2 * (y1 - y0))::BIGINT AND y < y1 + trunc(0.2 * (y1 - y0))::BIGINT GROUP BY frame, x0, y0, x1, y1")
def crop_from_det(s, d):
    """Frames cut to the region around a detection."""
    k = F.col("frame")
    f = image.frames_of(vector_frames(s, d), ["frame"], 8, 8)
    out = image.crop_resize_from_det(f, roi.box(k % 3 + 1, k % 2 + 2, k % 3 + 5, k % 2 + 5), None, "meta")
    return out.select("frame", "h", "w", F.hex("data").alias("data"))


@query(f"WITH {FR} SELECT frame, 5 AS h, 6 AS w, string_agg(printf('%02X', p), '' ORDER BY y, x) AS data FROM fr WHERE frame >= 6 AND frame < 400 AND (frame - 6) % 4 = 0 AND x >= 1 AND x < 7 AND y >= 2 AND y < 7 GROUP BY frame")
def parse_image_inputs(s, d):
    f = image.frames_of(vector_frames(s, d), ["frame"], 8, 8)
    return media.parse_frames(f, fps=30.0, target_fps=7.5, trim=(6, 400), roi=(1, 2, 7, 7)).select("frame", "h", "w", F.hex("data").alias("data"))


@query(f"WITH {FR}, f AS (SELECT DISTINCT frame, frame % 5 AS path FROM fr), n AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY frame) - 1 AS frame FROM f) SELECT path, 25.0::DOUBLE AS fps, count(*) AS n_frames, 8 AS h, 8 AS w, 1 AS c, false AS issues FROM n GROUP BY path")
def probe_image_inputs(s, d):
    f = image.frames_of(vector_frames(s, d), ["frame"], 8, 8).withColumn("path", F.col("frame") % 5)
    f = f.withColumn("frame", F.row_number().over(W.partitionBy("path").orderBy("frame")) - 1)
    return media.probe_frames(f, 25.0)


@query(f"WITH {FR} SELECT frame, y - 2 AS y, x - 1 AS x, p FROM fr WHERE frame >= 10 AND frame < 200 AND (frame - 10) % 3 = 0 AND x >= 1 AND x < 6 AND y >= 2 AND y < 7")
def frame_trim_downsample_crop(s, d):
    f = media.select_frames(vector_frames(s, d), 10, 200, media.frame_step(30.0, 11.0))
    return image.crop(f, 1, 2, 6, 7).select("frame", "y", "x", "p")


@query(f"WITH {FR} SELECT frame, y, x, round((p - avg(p) OVER w) / greatest(stddev_pop(p) OVER w, 1 / sqrt(64)), 6) AS out FROM fr WINDOW w AS (PARTITION BY frame)")
def image_standardize(s, d):
    return elementwise.standardize_images(vector_frames(s, d), ["frame"]).select("frame", "y", "x", r6("out").alias("out"))


@query(f"WITH {FR}, v AS (SELECT frame, y, x, p / 255.0::DOUBLE AS v FROM fr), l AS (SELECT *, lag(v) OVER (PARTITION BY y, x ORDER BY frame) AS o FROM v) SELECT frame, y, x, round((v - o) / least(greatest(v + o, 1e-7), 2), 6) AS out FROM l WHERE o IS NOT NULL")
def image_diff(s, d):
    v = vector_frames(s, d).withColumn("v", F.col("p") / 255.0)
    return elementwise.image_diff(v, ["y", "x"]).select("frame", "y", "x", r6("out").alias("out"))


@query(f"WITH {FR} SELECT frame, y, x, round((p - min(p) OVER w) / nullif(max(p) OVER w - min(p) OVER w, 0)::DOUBLE, 6) AS out FROM fr WINDOW w AS (PARTITION BY frame)")
def display_scale(s, d):
    return elementwise.display_scale(vector_frames(s, d), ["frame"]).select("frame", "y", "x", r6("out").alias("out"))


@query()
def crop_slice_resize(s, d):
    f = image.frames_of(vector_frames(s, d), ["frame"], 8, 8)
    return image.crop_slice_resize(f, (5, 4), (1, 0, 8, 8), algorithm="bicubic").select("frame", "h", "w", F.hex("data").alias("data"))


# --- retention, probing ---------------------------------------------------------------------

_HIST = "h AS (SELECT o_orderpriority AS name, o_orderkey AS step, o_totalprice AS score FROM orders)"


def _history(s, d):
    return read(s, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("score"))


@query(f"WITH {_HIST} SELECT name, step, score, name || '_best_' || step AS file FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score, step) AS n FROM h) WHERE n <= 3")
def topk_best(s, d):
    return topk.keep_best(_history(s, d), ["name"], 3)


@query(f"WITH {_HIST} SELECT name, step, score, name || '_latest_' || step AS file FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step DESC) AS n FROM h) WHERE n <= 4")
def topk_latest(s, d):
    return topk.keep_latest(_history(s, d), ["name"], 4)


@query("WITH t AS (SELECT t1, t2, t3, abs(t1 - 240) + abs(t2 - 320) + abs(t3 - 10) AS delta FROM (SELECT unnest(range(235, 246)) AS t1), (SELECT unnest(range(315, 326)) AS t2), (SELECT unnest(range(7, 14)) AS t3) WHERE t1 * t2 * t3 = 242 * 318 * 11) SELECT delta, t1, t2, t3 FROM t ORDER BY delta, t1, t2, t3 LIMIT 1")
def factors_near(s, d):
    return media.factors_near(s, 242 * 318 * 11, (240, 320, 10), (5, 5, 3))


@query("SELECT n_nationkey, 30000.0::DOUBLE / 1001 AS fps, (n_nationkey * 10)::INT AS total_frames, (100 + n_nationkey)::INT AS width, 80::INT AS height, 'h264' AS codec, n_nationkey / 2.0::DOUBLE AS bitrate, CASE WHEN n_nationkey % 2 = 0 THEN 90 ELSE 0 END::INT AS rotation, abs(n_nationkey * 10 - floor(n_nationkey / 3.0::DOUBLE * (30000.0::DOUBLE / 1001))) > 1 AS issues FROM nation")
def probe_parse(s, d):
    k = F.col("n_nationkey")
    js = F.concat(F.lit('{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","avg_frame_rate":"30000/1001","height":80,"width":'), (100 + k).cast("string"), F.lit(',"nb_frames":"'), (k * 10).cast("string"), F.lit('","duration":"'), (k / 3.0).cast("string"), F.lit('","bit_rate":"'), (k * 500).cast("string"), F.lit('"'), F.when(k % 2 == 0, ',"tags":{"rotate":"90"}').otherwise(""), F.lit("}]}"))
    return read(s, d, "nation").select("n_nationkey", media.parse_probe(js).alias("p")).select("n_nationkey", "p.*")


@query("SELECT c_custkey, CASE WHEN abs(r) = 90 THEN h ELSE w END AS w, CASE WHEN abs(r) = 90 THEN w ELSE h END AS h, CASE WHEN abs(r) = 90 THEN 0 ELSE r END AS r FROM (SELECT c_custkey, c_custkey % 640 AS w, c_custkey % 480 AS h, (c_custkey % 4) * 90 - 90 AS r FROM customer)")
def rectify_rotation(s, d):
    k = F.col("c_custkey")
    return read(s, d, "customer").select("c_custkey", media.rectify(k % 640, k % 480, (k % 4) * 90 - 90).alias("x")).select("c_custkey", "x.*")


# --- augmentation, sequences, further parsing --------------------------------------------

_RGB = FR + ", rgb AS (SELECT frame, y, x, p / 255.0::DOUBLE AS r, (p * 7 % 256) / 255.0::DOUBLE AS g, (p * 13 % 256) / 255.0::DOUBLE AS b FROM fr)"


def _rgb(s, d):
    p = F.col("p")
    return vector_frames(s, d).select("frame", "y", "x", (p / 255.0).alias("r"), (p * 7 % 256 / 255.0).alias("g"), (p * 13 % 256 / 255.0).alias("b"))


def _drawn(kind: str) -> str:
    return f"(('0x' || substr(md5('distort-{kind}:' || frame), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _channel(n: int, old: str) -> str:
    k = f"(((turn + {n}) % 6 + 6) % 6)"
    return f"round(coalesce(v - span * greatest(0, least({k}, 4 - {k}, 1)), {old}), 6) AS {old}"


@query(
    f"WITH {_RGB}, f AS (SELECT DISTINCT frame FROM rgb), dr AS (SELECT frame, (2 * {_drawn('brightness')} - 1) * 0.4::DOUBLE AS db, 1 + (2 * {_drawn('contrast')} - 1) * 0.5::DOUBLE AS dc, 1 + (2 * {_drawn('saturation')} - 1) * 0.5::DOUBLE AS ds, (2 * {_drawn('hue')} - 1) * 0.1::DOUBLE AS dh FROM f), "
    + "c AS (SELECT frame, y, x, ds, dh, " + ", ".join(f"({c} - avg({c}) OVER w) * dc + avg({c}) OVER w + db AS {c}" for c in "rgb") + " FROM rgb JOIN dr USING (frame) WINDOW w AS (PARTITION BY frame)), "
    + "m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS ch FROM c), t AS (SELECT *, CASE WHEN v > 0 AND ch > 0 THEN CASE WHEN r = v THEN (g - b) / ch WHEN g = v THEN 2 + (b - r) / ch ELSE 4 + (r - g) / ch END + 6 * dh END AS turn, CASE WHEN v > 0 AND ch > 0 THEN least(ch * ds, v) END AS span FROM m) "
    + f"SELECT frame, y, x, {_channel(5, 'r')}, {_channel(3, 'g')}, {_channel(1, 'b')} FROM t"
)
def random_distortion(s, d):
    out = augment.random_distortion(_rgb(s, d), ["frame"])
    return out.select("frame", "y", "x", *[r6(c).alias(c) for c in "rgb"])


@query()
def random_resize(s, d):
    f = image.frames_of(vector_frames(s, d), ["frame"], 8, 8)
    return augment.random_resize(f, ["frame"], (5, 6)).select("frame", "method", "h", "w", F.hex("data").alias("data"))


@query(f"WITH {EM}, dt AS (SELECT signal_id, unnest([16, 32, 48]) AS det_idx FROM (SELECT DISTINCT signal_id FROM em)), x AS (SELECT dt.signal_id, dt.det_idx, e.i, row_number() OVER (PARTITION BY dt.signal_id, dt.det_idx ORDER BY e.val, e.i) AS n FROM dt JOIN em e ON e.signal_id = dt.signal_id AND e.i >= det_idx - 4 AND e.i < det_idx + 4) SELECT signal_id, det_idx, i AS refined FROM x WHERE n = 1")
def refine_feet(s, d):
    dets = read(s, d, "embeddings").select(F.col("vec_id").alias("signal_id"), F.explode(F.expr("array(16L, 32L, 48L)")).alias("det_idx"))
    return detect.refine(vector_signals(s, d), dets, KEY, 8, foot=True).select("signal_id", "det_idx", "refined")


_SEQ_HRV = f"WITH {EV}, g AS (SELECT signal_id, us, us / 1e6 / 7200000 AS t, CASE WHEN us - lag(us) OVER (PARTITION BY signal_id ORDER BY us) > 86400000000 THEN 1 ELSE 0 END AS n FROM ev), sq AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS seq_id FROM g), df AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id, seq_id ORDER BY us) AS d FROM sq)"


def _hrv_sequences(s, d):
    w = W.partitionBy("signal_id").orderBy("us")
    e = _detections(s, d).withColumn("n", F.coalesce((F.col("us") - F.lag("us").over(w) > 86_400_000_000).cast("int"), F.lit(0)))
    return e.select("signal_id", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("seq_id"), (F.col("us") / 1e6 / 7_200_000).alias("t"))


@query(_SEQ_HRV + ", q AS (SELECT signal_id, seq_id, CASE WHEN count(d) + 1 >= 4 AND max(t) - min(t) >= 0.001 THEN least(greatest(sqrt(var_pop(d)) * 1000, 1.0), 200.0) END AS v, max(t) - min(t) AS w FROM df GROUP BY ALL) SELECT signal_id, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 4) AS value FROM q GROUP BY signal_id")
def hrv_sdnn_sequences(s, d):
    v = physio.hrv_from_sequences(_hrv_sequences(s, d), KEY, "sdnn", min_dets=4, min_t=0.001)
    return v.select("signal_id", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


@query(_SEQ_HRV + ", x AS (SELECT *, d - last_value(d IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dd FROM df) SELECT signal_id, CASE WHEN count(d) + 1 >= 4 AND sum(d) >= 0.001 AND count(*) FILTER (d = 0) = 0 THEN round(least(greatest(sqrt(avg(dd * dd)) * 1000, 1.0), 200.0), 4) END AS value FROM x GROUP BY signal_id")
def hrv_rmssd_sequences_pooled(s, d):
    v = physio.hrv_from_sequences(_hrv_sequences(s, d), KEY, "rmssd", min_dets=4, min_t=0.001, weighted=False)
    return v.select("signal_id", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value"))


@query(f"WITH {EV} SELECT signal_id, i % 50 AS slot, arg_max(val, i) FILTER (i % 3 > 0) AS val FROM ev GROUP BY ALL HAVING count(*) FILTER (i % 3 > 0) > 0")
def overlay_sequences(s, d):
    e = event_signals(s, d).withColumn("val", F.when(F.col("i") % 3 > 0, F.col("val"))).withColumn("slot", F.col("i") % 50)
    return asof.overlay(e, ["signal_id", "slot"], "val", "i").select("signal_id", "slot", "val")


@query(f"WITH {PAIR}, h AS (SELECT signal_id, CASE WHEN i % 4 > 0 THEN y_true END AS t, y_pred AS p FROM pr) SELECT signal_id, round(avg(abs(t - p)), 6) AS mae, round(avg((t - p) ** 2), 6) AS mse, round(sqrt(avg((t - p) ** 2)), 6) AS rmse, round(corr(t, p), 6) AS cor FROM h GROUP BY signal_id")
def error_metrics_ignore_nan(s, d):
    t = F.when(F.col("i") % 4 > 0, F.col("y_true")).otherwise(F.lit(float("nan")))
    return vector_pairs(s, d).withColumn("t", t).groupBy("signal_id").agg(*[r6(fn(F.col("t"), F.col("y_pred"), True)).alias(n) for n, (fn, _) in metrics.METRICS.items()])


@query("SELECT n_nationkey, n_nationkey / 4.0::DOUBLE AS first, (n_nationkey / 4.0 + 0.5)::DOUBLE AS last, 2 AS n FROM nation")
def frame_times_parse(s, d):
    k = F.col("n_nationkey") / 4.0
    csv = F.concat(k.cast("string"), F.lit(",,\n\n"), (k + 0.5).cast("string"), F.lit(",\nN/A\n"))
    t = read(s, d, "nation").select("n_nationkey", media.parse_frame_times(csv).alias("t"))
    return t.select("n_nationkey", F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"), F.size("t").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 100 + n_nationkey END::INT AS w, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 80 END::INT AS h, CASE WHEN n_nationkey % 2 = 0 THEN -90 ELSE 0 END::INT AS r FROM nation")
def stream_properties(s, d):
    k = F.col("n_nationkey")
    size = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("  Stream #0:0: Video: rawvideo, rgb24, "), (100 + k).cast("string"), F.lit("x80, 25 fps\n")))
    log = F.concat(F.lit("Output #0\n"), size, F.when(k % 2 == 0, "  displaymatrix: rotation of -90.00 degrees\n").otherwise(""))
    return read(s, d, "nation").select("n_nationkey", media.stream_properties(log).alias("p")).select("n_nationkey", "p.*")


@query("WITH f AS (SELECT n_regionkey AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS frame, n_nationkey AS p FROM nation WHERE n_nationkey % 7 > 1), n AS (SELECT path, greatest(4 - count(*), 0) AS miss FROM f GROUP BY path), a AS (SELECT path, frame + miss AS frame, p FROM f JOIN n USING (path) UNION ALL SELECT path, unnest(range(0, miss)), p FROM f JOIN n USING (path) WHERE frame = 0) SELECT path, frame::INT AS frame, p FROM a WHERE frame < 4")
def pad_frames(s, d):
    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    f = read(s, d, "nation").where("n_nationkey % 7 > 1").select(F.col("n_regionkey").alias("path"), (F.row_number().over(w) - 1).cast("int").alias("frame"), F.col("n_nationkey").alias("p"))
    return media.pad_frames(f, 4)


@query(f"WITH {_HIST} SELECT name, step, score, name || '_keep_' || step AS file FROM h")
def topk_keep(s, d):
    return topk.keep_all(_history(s, d))


@query(f"WITH {_HIST} SELECT name, max(score) AS score FROM h GROUP BY name")
def best_score(s, d):
    return topk.best_score(_history(s, d), ["name"], higher=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_global(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship", "micros"]
