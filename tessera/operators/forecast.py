"""Monthly trend and forecasting.

The scale step is the raw-rows -> monthly-sum aggregation (partial aggregate on
every partition, one shuffle of at most #months rows per partition). All later
steps run on the monthly frame, which holds one row per present month: an
unpartitioned window over it is fine, and must never be used on raw rows.

Per-series forms (``by=[keys]``) partition every window by the keys, so many
series are fitted in parallel, one key group per task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col, month_str
from tessera.functions.nulls import normalize_nulls
from tessera.operators.clean import time_col


def _check_periods(periods: int) -> None:
    if int(periods) != periods or periods < 1:
        raise ValueError("periods must be a whole number of at least 1")


def monthly_totals(df: DataFrame, date_col: str, value_col: str,
                   by: list[str] | None = None) -> DataFrame:
    """Sum of ``value_col`` per present calendar month (gaps are not filled).

    Rows missing the date or the value are skipped, and so are dates given as
    text that do not parse. Columns: *by, period, value.
    """
    by = by or []
    d = normalize_nulls(df.select(*[col(b) for b in by], time_col(df, date_col).alias("_d"),
                                  col(value_col).cast("double").alias("_v")))
    d = d.where(F.col("_d").isNotNull() & F.col("_v").isNotNull())
    for b in by:  # pandas groupby drops NULL keys
        d = d.where(col(b).isNotNull())
    return d.groupBy(*by, month_str(F.col("_d")).alias("period")).agg(F.sum("_v").alias("value"))


def monthly_indexed(df: DataFrame, date_col: str, value_col: str,
                    by: list[str] | None = None) -> DataFrame:
    """Monthly totals with ``idx`` = rank of the present month, 0-based."""
    by = by or []
    m = monthly_totals(df, date_col, value_col, by)
    w = Window.partitionBy(*by).orderBy("period") if by else Window.orderBy("period")
    return m.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def _linear_fit(indexed: DataFrame, by: list[str]) -> DataFrame:
    fit = indexed.groupBy(*by).agg(
        F.regr_slope("value", "idx").alias("_b"),
        F.regr_intercept("value", "idx").alias("_a"),
        F.max("idx").alias("_last"),
        F.avg("value").alias("_ybar"),
    )
    fitted = indexed.join(fit, by) if by else indexed.crossJoin(F.broadcast(fit))
    fitted = fitted.withColumn("_pred", F.col("_a") + F.col("_b") * F.col("idx"))
    return fitted


def _metrics(fitted: DataFrame, by: list[str], r2_digits: int = 4) -> DataFrame:
    e = F.col("value") - F.col("_pred")
    return fitted.groupBy(*by).agg(
        F.round(F.avg(F.abs(e)), 2).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col("value") - F.col("_ybar")) ** 2)),
                r2_digits).alias("r2"),
        F.stddev_pop(e).alias("_resid_std"),
        F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("_last").alias("_last"),
    )


def forecast_linear(df: DataFrame, date_col: str, value_col: str, periods: int = 3,
                    by: list[str] | None = None) -> DataFrame:
    """OLS trend on the month index; ``periods`` steps ahead labelled 'Month +i'
    with a ±1.96·σ band, σ the population std of the in-sample residuals."""
    by = by or []
    _check_periods(periods)
    m = _metrics(_linear_fit(monthly_indexed(df, date_col, value_col, by), by), by)
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    f = m.select(*by, "_a", "_b", "_last", "_resid_std", steps)
    yhat = F.col("_a") + F.col("_b") * (F.col("_last") + F.col("step"))
    band = 1.96 * F.col("_resid_std")
    return f.select(
        *by,
        F.col("step").cast("long").alias("step"),
        F.concat(F.lit("Month +"), F.col("step").cast("string")).alias("period"),
        F.round(yhat, 2).alias("forecast"),
        F.round(yhat - band, 2).alias("lower"),
        F.round(yhat + band, 2).alias("upper"),
    )


def forecast_linear_metrics(df: DataFrame, date_col: str, value_col: str,
                            by: list[str] | None = None) -> DataFrame:
    """In-sample MAE, RMSE (2 dp) and R² (4 dp) of the linear trend."""
    by = by or []
    m = _metrics(_linear_fit(monthly_indexed(df, date_col, value_col, by), by), by)
    return m.select(*by, F.lit("Linear Trend").alias("method"), "mae", "rmse", "r2")


def _ma_frame(ix: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Monthly frame + rolling mean over ``k = min(window, n)`` months.

    The frame holds the last ``window`` rows; a value is kept only when it
    saw ``k`` rows. When n < window the frame already spans the whole series,
    so only the final row qualifies — the pandas ``rolling(k)`` result.
    The in-sample prediction falls back to the first value of the series.
    """
    n = ix.groupBy(*by).agg(F.count("*").alias("_n"))
    ix = ix.join(n, by) if by else ix.crossJoin(F.broadcast(n))
    w_order = Window.partitionBy(*by).orderBy("idx")
    roll = w_order.rowsBetween(-(window - 1), 0)
    k = F.least(F.lit(window), F.col("_n"))
    ma = F.when(F.count("value").over(roll) >= k, F.avg("value").over(roll))
    first_v = F.first("value").over(w_order.rowsBetween(Window.unboundedPreceding, 0))
    out = ix.withColumn("ma", ma).withColumn("_pred", F.coalesce(F.col("ma"), first_v))
    return out.withColumn("_ybar", F.avg("value").over(Window.partitionBy(*by)))


def moving_average(df: DataFrame, date_col: str, value_col: str,
                   window: int = 3, by: list[str] | None = None) -> DataFrame:
    """Rolling mean per month (``ma``, NULL for incomplete windows) and the
    in-sample prediction (``fitted``)."""
    by = by or []
    f = _ma_frame(monthly_indexed(df, date_col, value_col, by), window, by)
    return f.select(*by, "period", "idx", F.round("value", 2).alias("value"),
                    F.round("ma", 4).alias("ma"), F.round("_pred", 4).alias("fitted"))


def forecast_ma(df: DataFrame, date_col: str, value_col: str, periods: int = 3,
                window: int = 3, by: list[str] | None = None) -> DataFrame:
    """Flat forecast = mean of the last ``min(window, n)`` months, band ±1.96·s
    with s the sample std (ddof 1) of that tail."""
    by = by or []
    _check_periods(periods)
    ix = monthly_indexed(df, date_col, value_col, by)
    w_desc = Window.partitionBy(*by).orderBy(F.col("idx").desc())
    tail = ix.withColumn("_rk", F.row_number().over(w_desc)).where(F.col("_rk") <= window)
    t = tail.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    f = t.select(*by, "_m", "_s", steps)
    return f.select(
        *by,
        F.col("step").cast("long").alias("step"),
        F.concat(F.lit("Month +"), F.col("step").cast("string")).alias("period"),
        F.round("_m", 2).alias("forecast"),
        F.round(F.col("_m") - 1.96 * F.col("_s"), 2).alias("lower"),
        F.round(F.col("_m") + 1.96 * F.col("_s"), 2).alias("upper"),
    )


def forecast_ma_metrics(df: DataFrame, date_col: str, value_col: str,
                        window: int = 3, by: list[str] | None = None) -> DataFrame:
    by = by or []
    p = _ma_frame(monthly_indexed(df, date_col, value_col, by), window, by)
    e = F.col("value") - F.col("_pred")
    return p.groupBy(*by).agg(
        F.lit("Moving Average").alias("method"),
        F.round(F.avg(F.abs(e)), 2).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col("value") - F.col("_ybar")) ** 2)),
                4).alias("r2"),
    )


def history_forecast_union(df: DataFrame, date_col: str, value_col: str,
                           periods: int = 3) -> DataFrame:
    """History and forecast in one frame with a ``kind`` tag (for plotting)."""
    hist = monthly_totals(df, date_col, value_col).select(
        "period", F.round("value", 2).alias("value"), F.lit("History").alias("kind"))
    fc = forecast_linear(df, date_col, value_col, periods).select(
        "period", F.col("forecast").alias("value"), F.lit("Forecast").alias("kind"))
    return hist.unionByName(fc)


# --- Random forest on the month index -----------------------------------------
# With one feature and unlimited depth, a tree ends with one leaf per sampled month
# and cuts half-way between neighbours: it predicts the value of the nearest sampled
# month, of two equally near ones the earlier. So the forest is its samples, exactly.

TREES = 100
_PRIME = 2147483647


def bootstrap(n: int, trees: int, seed: int) -> np.ndarray:
    """(trees, n) places drawn with replacement, by integer arithmetic that SQL can repeat. They depend on the length of a
    series alone, so a series has the same forest beside others as by itself."""
    tree, draw = np.arange(trees, dtype=np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    s = (seed * 7919 + tree * 104729 + draw * 1299709 + 1) % _PRIME
    for _ in range(3):
        s = (s ^ (s >> 15)) * 48271 % _PRIME
    return s % n


def forest_values(value: np.ndarray, at: np.ndarray, trees: int = TREES, seed: int = 42) -> np.ndarray:
    """Forest trained on ``value`` at places 0, 1, ...; its predictions at the places ``at``, to six digits after the point
    (the mean of 100 amounts often lies half-way between two cents, where the order of adding would decide)."""
    total = np.zeros(len(at))
    for sample in bootstrap(len(value), trees, seed):
        s = np.unique(sample)
        total += value[s[np.searchsorted((s[1:] + s[:-1]) / 2, at, side="left")]]
    return np.round(total / trees, 6)


def _forest(ix: DataFrame, by: list[str], periods: int, trees: int, seed: int, test_frac: float = 0.0, least: int = 1) -> DataFrame:
    """Months and ``periods`` steps beyond (value NULL) of every series with ``least`` months: *by, idx, value, is_test,
    _pred. The last ceil(test_frac * n) months are not trained on. A task holds one series: its months."""
    keep = [ix.schema[b] for b in by]
    schema = T.StructType(keep + [T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType()),
                                  T.StructField("is_test", T.BooleanType()), T.StructField("_pred", T.DoubleType())])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        value, n = pdf["value"].to_numpy(float), len(pdf)
        train = n - math.ceil(n * test_frac)
        if n < least or train < 1:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        at = np.arange(n + periods)
        out = pd.DataFrame({b: pd.Series([pdf[b].iloc[0]] * len(at), index=at, dtype=object) for b in by}, index=at)
        out["idx"], out["value"] = at, np.append(value, np.full(periods, np.nan))
        out["is_test"], out["_pred"] = (at >= train) & (at < n), forest_values(value[:train], at, trees, seed)
        return out

    grown = ix.select(*by, "idx", "value").groupBy(*by).applyInPandas(grow, schema)
    return grown.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _fit_quality(rows: DataFrame, by: list[str]) -> list:
    """Aggregates mae, rmse and r2 of value against _pred; rows must carry the mean as _ybar."""
    e = F.col("value") - F.col("_pred")
    return [F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
            F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col("value") - F.col("_ybar")) ** 2)), 4).alias("r2")]


def _steps(rows: DataFrame, by: list[str], last: str) -> DataFrame:
    """The rows beyond the last month as step and period."""
    step = (F.col("idx") - F.col(last)).cast("long")
    return rows.where(F.col("idx") > F.col(last)).withColumn("step", step).withColumn("period", F.concat(F.lit("Month +"), F.col("step").cast("string")))


def forecast_rf(df: DataFrame, date_col: str, value_col: str, periods: int = 3, seed: int = 42, by: list[str] | None = None,
                trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Random forest of fully grown trees on the month index, per series of ``by``; flat beyond the last month. Returns
    (forecast rows with a ±1.96·σ band of the in-sample residuals, in-sample metrics)."""
    by = by or []
    _check_periods(periods)
    rows = _forest(monthly_indexed(df, date_col, value_col, by), by, periods, trees, seed)
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_ybar", F.avg("value").over(w)).withColumn("_sd", F.stddev_pop(F.col("value") - F.col("_pred")).over(w)) \
        .withColumn("_last", F.max(F.when(F.col("value").isNotNull(), F.col("idx"))).over(w))
    met = rows.where(F.col("value").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *_fit_quality(rows, by)) \
        .where(F.col("_n") > 0).select(*by, F.lit("Random Forest").alias("method"), "mae", "rmse", "r2")
    band = 1.96 * F.col("_sd")
    out = _steps(rows, by, "_last").select(*by, "step", "period", F.round("_pred", 2).alias("forecast"), F.round(F.col("_pred") - band, 2).alias("lower"),
                                           F.round(F.col("_pred") + band, 2).alias("upper"))
    return out, met


def forecast_holdout_rf(df: DataFrame, date_col: str, value_col: str, test_frac: float = 0.2, periods: int = 3, by: list[str] | None = None,
                        seed: int = 42, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """``forecast_holdout`` with the random forest, per series of ``by``: (metrics, forecast)."""
    by = by or []
    _check_periods(periods)
    rows = _forest(monthly_indexed(df, date_col, value_col, by), by, periods, trees, seed, test_frac, least=4)
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_last", F.max(F.when(F.col("value").isNotNull(), F.col("idx"))).over(w)) \
        .withColumn("n_train", F.count_if(F.col("value").isNotNull() & ~F.col("is_test")).over(w).cast("long")) \
        .withColumn("_ybar", F.avg(F.when(F.col("is_test"), F.col("value"))).over(w))
    mae, _, r2 = _fit_quality(rows, by)
    met = rows.where("is_test").groupBy(*by).agg(F.first("n_train").alias("n_train"), F.count(F.lit(1)).cast("long").alias("n_test"), mae, r2).where(F.col("n_test") > 0)
    return met, _steps(rows, by, "_last").select(*by, "step", "period", F.round("_pred", 2).alias("forecast"))


def forecast_holdout(df: DataFrame, date_col: str, value_col: str, test_frac: float = 0.2,
                     periods: int = 3) -> tuple[DataFrame, DataFrame]:
    """v1 hold-out evaluation of the linear trend on monthly totals: needs at
    least 4 months (else both frames are empty); trains on the first
    n − ceil(test_frac·n) months, reports MAE (2 dp) and R² (4 dp) on the
    rest, and forecasts ``periods`` months past the last one with the
    train-fitted line. Returns (metrics, forecast)."""
    ix = monthly_indexed(df, date_col, value_col)
    n = ix.agg(F.count(F.lit(1)).alias("_n"))
    s = ix.crossJoin(F.broadcast(n)).where(F.col("_n") >= 4)
    s = s.withColumn("is_test", F.col("idx") >= F.col("_n") - F.ceil(F.col("_n") * test_frac))
    fit = s.where(~F.col("is_test")).agg(F.regr_slope("value", "idx").alias("_b"),
                                          F.regr_intercept("value", "idx").alias("_a"),
                                          F.count(F.lit(1)).alias("n_train"))
    t = s.where("is_test").crossJoin(F.broadcast(fit)).withColumn("_p", F.col("_a") + F.col("_b") * F.col("idx"))
    tbar = t.agg(F.avg("value").alias("_tbar"))
    t = t.crossJoin(F.broadcast(tbar))
    e = F.col("value") - F.col("_p")
    met = t.groupBy().agg(F.first("n_train").cast("long").alias("n_train"), F.count(F.lit(1)).cast("long").alias("n_test"),
                          F.round(F.avg(F.abs(e)), 2).alias("mae"),
                          F.round(1 - F.try_divide(F.sum(e * e), F.sum((F.col("value") - F.col("_tbar")) ** 2)), 4)
                          .alias("r2")).where(F.col("n_test") > 0)
    last = s.agg(F.max("idx").alias("_last"))
    fut = fit.crossJoin(last).where(F.col("_last").isNotNull()).select(
        "_a", "_b", "_last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    fc = fut.select(F.col("step").cast("long").alias("step"),
                    F.concat(F.lit("Month +"), F.col("step").cast("string")).alias("period"),
                    F.round(F.col("_a") + F.col("_b") * (F.col("_last") + F.col("step")), 2).alias("forecast"))
    return met, fc
