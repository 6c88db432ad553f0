"""Time series: trends, seasonality, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.catalog.aggregate_queries import LOG_SQL, query_log
from sparkscope.model import FLAT_SQL, SERIES_SQL, flat, series
from sparkscope.operators import anomalies as an, forecast as fc, series as ts

# Points with their position i and the series length n; x is the position around the middle.
P = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM ({SERIES_SQL})),
f AS (SELECT series, any_value(n) AS n, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, regr_r2(value, i) AS r2, avg(value) AS mean, stddev_pop(value) AS sd_pop,
  stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, arg_max(value, i) AS last, max(ts) AS last_ts FROM p GROUP BY series) """


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_DIR = "CASE WHEN slope > 0.01 THEN 'Increasing' WHEN slope < -0.01 THEN 'Decreasing' ELSE 'Stable' END"


@query(
    "series_extract",
    f"WITH rec AS ({FLAT_SQL}) SELECT event_type AS series, ts, coalesce(TRY_CAST(a_status AS DOUBLE), 0.0) AS value FROM rec",
)
def series_extract(spark, d):
    return ts.points(flat(spark, d), "ts", "a_status", F.col("event_type"))


@query("series_index", P + "SELECT series, id, i, n FROM p")
def series_index(spark, d):
    return ts.index(series(spark, d)).select("series", "id", "i", "n")


@query("ts_trend", P + f"SELECT series, round(slope, 8) AS slope, {_DIR} AS direction, round(r2, 8) AS strength, round(least(r2, 1.0), 8) AS confidence FROM f")
def ts_trend(spark, d):
    return rounded(ts.trend(series(spark, d)), "slope", "strength", "confidence", digits=8)


@query("ts_trend_simple", P + f"SELECT series, {_DIR} AS direction, round(abs(slope), 8) AS strength FROM f")
def ts_trend_simple(spark, d):
    return rounded(ts.simple_trend(series(spark, d)), "strength", digits=8)


_USER = "SELECT 'u' || CAST(user_id AS VARCHAR) AS series, ts, event_id AS id, value FROM events"
PU = P.replace(SERIES_SQL, _USER)


def user_series(spark, d):
    from sparkscope.model import table

    return table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series"), "ts", F.col("event_id").alias("id"), "value"
    )


@query(
    "ts_profile",
    PU
    + f"""SELECT series, n, round(mean, 6) AS mean, round(sd_pop, 6) AS std_dev, min, max, last, {_DIR} AS trend, round(abs(slope), 6) AS trend_strength,
      round(abs(last - mean) / sd_pop, 6) AS anomaly_score, abs(last - mean) / sd_pop > 2.0 AS is_anomaly FROM f""",
)
def ts_profile(spark, d):
    return rounded(ts.profile(user_series(spark, d)), "mean", "std_dev", "trend_strength", "anomaly_score")


@query("ts_recent_if_anomalous", PU + "SELECT p.series, p.ts, p.id, p.value, p.i FROM p JOIN f USING (series) WHERE abs(f.last - f.mean) / f.sd_pop > 2.0 AND p.i >= p.n - 5")
def ts_recent_if_anomalous(spark, d):
    return ts.recent_if_anomalous(user_series(spark, d)).select("series", "ts", "id", "value", "i")


@query(
    "ts_seasonality",
    P
    + """, a AS (SELECT x.series, y.i - x.i AS lag, avg(x.value * y.value) AS ac FROM p x JOIN p y ON x.series = y.series AND y.i > x.i AND y.i <= x.i + least(x.n // 2, 100) WHERE x.n >= 10 GROUP BY 1, 2),
    b AS (SELECT series, arg_max(lag, ac) AS lag, max(ac) AS ac FROM a GROUP BY series)
    SELECT series, lag, lag * 3600 AS period_secs, round(ac, 6) AS strength, round(least(ac, 1.0), 6) AS confidence FROM b WHERE ac > 0.3""",
)
def ts_seasonality(spark, d):
    return rounded(ts.seasonality(series(spark, d)), "strength", "confidence")


KINDS = ("click", "error", "purchase", "signup", "view")
PAIRS = [(a, b) for a in KINDS for b in KINDS if a < b]


@query(
    "ts_corr",
    f"""WITH m AS (SELECT series, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, avg(value) AS v FROM ({SERIES_SQL}) GROUP BY 1, 2)
    SELECT x.series AS "left", y.series AS "right", count(*) AS buckets, round(corr(x.v, y.v), 6) AS correlation FROM m x JOIN m y ON x.b = y.b AND x.series < y.series GROUP BY 1, 2""",
)
def ts_corr(spark, d):
    return rounded(ts.correlation(series(spark, d), PAIRS, 6 * 3600), "correlation")


@query("ts_regression", P + "SELECT series, n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r2, 8) AS r2 FROM f")
def ts_regression(spark, d):
    fit = ts.regression(ts.index(series(spark, d)))
    return rounded(rounded(fit, "slope", "r2", digits=8), "intercept")


# -- anomalies ---------------------------------------------------------------------

Z = "SELECT p.series, p.ts, p.id, p.i, p.value, abs(p.value - f.mean) / f.sd AS deviation FROM p JOIN f USING (series) WHERE f.sd > 0 AND abs(p.value - f.mean) / f.sd > {t}"
MA = """SELECT series, ts, id, i, value, abs(value - ma) / greatest(abs(ma), 1e-10) AS deviation FROM (SELECT *, avg(value) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ma FROM p)
    WHERE i >= 10 AND abs(value - ma) / greatest(abs(ma), 1e-10) > {t}"""
IQR = """SELECT p.series, p.ts, p.id, p.i, p.value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) - value ELSE value - (q3 + 1.5 * (q3 - q1)) END / (q3 - q1) AS deviation FROM p JOIN
    (SELECT series, max(CASE WHEN r = CAST(floor(n * 0.25) AS BIGINT) THEN value END) AS q1, max(CASE WHEN r = CAST(floor(n * 0.75) AS BIGINT) THEN value END) AS q3
     FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) - 1 AS r FROM p) WHERE n >= 4 GROUP BY series) q USING (series)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


def _shown(inner):
    return f"SELECT series, ts, id, i, value, round(deviation, 6) AS deviation FROM ({inner})"


@query("anom_zscore", P + _shown(Z.format(t=2.5)))
def anom_zscore(spark, d):
    return rounded(an.zscore(ts.index(series(spark, d)), 2.5), "deviation")


@query("anom_moving_avg", P + _shown(MA.format(t=1.5)))
def anom_moving_avg(spark, d):
    return rounded(an.moving_average(ts.index(series(spark, d)), 10, 1.5), "deviation")


@query("anom_iqr", P + _shown(IQR))
def anom_iqr(spark, d):
    return rounded(an.iqr(ts.index(series(spark, d))), "deviation")


@query(
    "anom_trend",
    P
    + _shown(
        """SELECT *, abs(value - e) / greatest(abs(e), 1e-10) AS deviation FROM (SELECT *, prev + slope AS e FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY i) AS prev,
        regr_slope(value, i) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS slope FROM p WHERE n >= 20)) WHERE i >= 10 AND abs(value - e) / greatest(abs(e), 1e-10) > 2.0"""
    ),
)
def anom_trend(spark, d):
    return rounded(an.trend(ts.index(series(spark, d)), 10, 2.0), "deviation")


@query(
    "anom_seasonal",
    P
    + _shown(
        """SELECT *, abs(value - v) / greatest(abs(v), 1e-10) AS deviation FROM (SELECT *, lag(value, 24) OVER (PARTITION BY series ORDER BY i) AS v FROM p WHERE n >= 48)
        WHERE i >= 24 AND abs(value - v) / greatest(abs(v), 1e-10) > 3.0"""
    ),
)
def anom_seasonal(spark, d):
    return rounded(an.seasonal(ts.index(series(spark, d)), 24, 3.0), "deviation")


ENSEMBLE = f"""SELECT series, ts, id, i, value, deviation, detector, anomaly_type, least(deviation / 3.0, 10) / 10 AS severity, 1 - deviation / (deviation + 1) AS confidence FROM (
    SELECT *, 'z_score_detector' AS detector, 'Point' AS anomaly_type FROM ({Z.format(t=3.0)}) UNION ALL SELECT *, 'moving_average_detector', 'Contextual' FROM ({MA.format(t=3.0)})
    UNION ALL SELECT *, 'iqr_detector', 'Point' FROM ({IQR}))"""


@query(
    "anom_ensemble",
    P + f"SELECT series, ts, id, i, value, detector, anomaly_type, round(deviation, 6) AS deviation, round(severity, 6) AS severity, round(confidence, 6) AS confidence FROM ({ENSEMBLE})",
)
def anom_ensemble(spark, d):
    return rounded(an.ensemble(series(spark, d)), "deviation", "severity", "confidence")


@query(
    "anom_latency_spike",
    f"""WITH l AS ({LOG_SQL}), e AS (SELECT query_id, query_type, CASE WHEN query_id % 200 = 0 THEN duration_ms * 5 ELSE duration_ms END AS duration_ms FROM l),
    s AS (SELECT *, (duration_ms - avg(duration_ms) OVER w) / stddev_pop(duration_ms) OVER w AS z, avg(duration_ms) OVER w AS m, stddev_pop(duration_ms) OVER w AS sd FROM e WINDOW w AS (PARTITION BY query_type))
    SELECT query_id, query_type, duration_ms, round(z, 6) AS deviation, CASE WHEN z > 5 THEN 'Critical' ELSE 'High' END AS severity, round(m - 2 * sd, 4) AS expected_low, round(m + 2 * sd, 4) AS expected_high FROM s WHERE abs(z) > 3""",
)
def anom_latency_spike(spark, d):
    slow = F.when(F.col("query_id") % 200 == 0, F.col("duration_ms") * 5).otherwise(F.col("duration_ms"))
    log = query_log(spark, d).select("query_id", "query_type", slow.alias("duration_ms"))
    out = an.latency_spikes(log, key="query_type")
    return rounded(rounded(out, "deviation"), "expected_low", "expected_high", digits=4)


# -- forecasts ---------------------------------------------------------------------

H = ", h AS (SELECT unnest(range(1, 8)) AS step) "
LEVELS = """, w AS (SELECT *, least(greatest(n // 4, 3), 20) AS win FROM p),
lv AS (SELECT series, CASE WHEN any_value(n) >= any_value(win) THEN avg(CASE WHEN i >= n - win THEN value END) ELSE arg_max(value, i) END AS sma, avg(CASE WHEN i >= n - 10 THEN value END) AS ma10,
  sum(value * CASE WHEN i = 0 THEN power(0.7, n - 1) ELSE 0.3 * power(0.7, n - 1 - i) END) AS ses FROM w GROUP BY series),
g AS (SELECT f.*, lv.sma, lv.ma10, lv.ses FROM f JOIN lv USING (series))"""


def _fc(model, predicted, low, high, confidence):
    return f"""SELECT series, '{model}' AS model, CAST(step AS INTEGER) AS step, last_ts + to_seconds(step) AS ts, round({predicted}, 5) AS predicted, round({low}, 5) AS lower, round({high}, 5) AS upper, round({confidence}, 6) AS confidence FROM g, h"""


def _out(df):
    return rounded(rounded(df, "predicted", "lower", "upper", digits=5), "confidence")


_LINE = "(slope * (n + step) + intercept)"


@query("fc_sma", P + LEVELS + H + _fc("SimpleMovingAverage", "sma", "sma * 0.9", "sma * 1.1", "0.7::DOUBLE"))
def fc_sma(spark, d):
    return _out(fc.moving_average(series(spark, d), 7))


@query(
    "fc_linear",
    P
    + LEVELS
    + H
    + _fc(
        "LinearRegression",
        _LINE,
        f"{_LINE} - greatest(1 - r2, 0.1) * abs{_LINE} * 0.2",
        f"{_LINE} + greatest(1 - r2, 0.1) * abs{_LINE} * 0.2",
        "greatest(r2, 0.5)",
    ),
)
def fc_linear(spark, d):
    return _out(fc.linear(series(spark, d), 7))


@query("fc_ses", P + LEVELS + H + _fc("ExponentialSmoothing", "ses", "ses * 0.85", "ses * 1.15", "0.75::DOUBLE"))
def fc_ses(spark, d):
    return _out(fc.smoothing(series(spark, d), 7))


DECOMPOSE = """, q AS (SELECT *, greatest(n // 4, 2) AS per FROM p),
t AS (SELECT *, CASE WHEN i <= n - per THEN sum(value) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS tail FROM q),
u AS (SELECT a.series, a.i, a.n, a.per, a.value, CASE WHEN a.i <= a.n - a.per THEN (a.tail - coalesce(b.tail2, 0)) / a.per ELSE a.value END AS trend FROM t a LEFT JOIN
  (SELECT series, i, sum(value) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail2 FROM q) b ON a.series = b.series AND b.i = a.i + a.per),
se AS (SELECT series, i % per AS s, sum(value - trend) / (any_value(n) // any_value(per)) AS seasonal FROM u GROUP BY 1, 2),
le AS (SELECT series, any_value(per) AS per, avg(CASE WHEN i >= n - per THEN value END) AS level FROM q GROUP BY series),
g AS (SELECT f.*, h.step, le.level * h.step + se.seasonal AS predicted FROM f JOIN le USING (series) CROSS JOIN h JOIN se ON se.series = f.series AND se.s = h.step % le.per)"""
_DEC = "SELECT series, '{m}' AS model, CAST(step AS INTEGER) AS step, last_ts + to_seconds(step) AS ts, round(predicted, 9) AS predicted, round(predicted * (1 - {w}), 9) AS lower, round(predicted * (1 + {w}), 9) AS upper, {c}::DOUBLE AS confidence FROM g"


@query("fc_decompose", P + H + DECOMPOSE + _DEC.format(m="ARIMA", w="0.2::DOUBLE", c=0.8) + " UNION ALL " + _DEC.format(m="Prophet", w="0.15::DOUBLE", c=0.85))
def fc_decompose(spark, d):
    s = series(spark, d)
    out = fc.decomposition(s, 7, "ARIMA").unionByName(fc.decomposition(s, 7, "Prophet"))
    return rounded(out, "predicted", "lower", "upper", digits=9)


_MIX = f"({_LINE} * 0.4 + ses * 0.4 + sma * 0.2)"
_MEAN = f"(({_LINE} + ses + sma) / 3)"


@query(
    "fc_ensemble",
    P
    + LEVELS
    + H
    + _fc(
        "Ensemble",
        _MIX,
        f"{_MIX} * 0.8",
        f"{_MIX} * 1.2",
        f"greatest(1 / (1 + (power({_LINE} - {_MEAN}, 2) + power(ses - {_MEAN}, 2) + power(sma - {_MEAN}, 2)) / 2), 0.6)",
    ),
)
def fc_ensemble(spark, d):
    return _out(fc.ensemble(series(spark, d), 7))


@query(
    "fc_naive_trend",
    PU + H + "SELECT series, CAST(step AS INTEGER) AS step, round(last + CASE WHEN slope > 0.01 THEN 1 WHEN slope < -0.01 THEN -1 ELSE 0 END * abs(slope) * step, 5) AS predicted FROM f, h",
)
def fc_naive_trend(spark, d):
    return rounded(fc.naive(user_series(spark, d), 7), "predicted", digits=5)


@query(
    "fc_differenced",
    P
    + H
    + """, d1 AS (SELECT series, i - 1 AS i, n - 1 AS n, value - lag(value) OVER (PARTITION BY series ORDER BY i) AS value FROM p QUALIFY i >= 0),
    d2 AS (SELECT series, i - 1 AS i, n - 1 AS n, value - lag(value) OVER (PARTITION BY series ORDER BY i) AS value FROM d1 QUALIFY i >= 0),
    l AS (SELECT series, 1 AS d, sum(value * CASE WHEN i = 0 THEN power(0.7, n - 1) ELSE 0.3 * power(0.7, n - 1 - i) END) AS ses FROM d1 GROUP BY series
      UNION ALL SELECT series, 2, sum(value * CASE WHEN i = 0 THEN power(0.7, n - 1) ELSE 0.3 * power(0.7, n - 1 - i) END) FROM d2 GROUP BY series)
    SELECT series, CAST(step AS INTEGER) AS step, d, round(ses, 5) AS predicted FROM l, h""",
)
def fc_differenced(spark, d):
    s = series(spark, d)
    out = fc.differenced(s, 7, 1).withColumn("d", F.lit(1)).unionByName(fc.differenced(s, 7, 2).withColumn("d", F.lit(2)))
    return rounded(out, "predicted", digits=5)


_MM = "((ma10 + slope * (n + step - 1) + intercept + ses) / 3)"


@query(
    "fc_model_mean",
    P + LEVELS + H + f"SELECT series, CAST(step AS INTEGER) AS step, round({_MM}, 5) AS predicted, round({_MM} - 1.96 * sd, 5) AS lower, round({_MM} + 1.96 * sd, 5) AS upper FROM g, h",
)
def fc_model_mean(spark, d):
    return rounded(fc.model_mean(series(spark, d), 7), "predicted", "lower", "upper", digits=5)
