"""Bucketed time series: windows, velocity and change points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def bucket_start(ts: Column, hours: int) -> Column:
    """Start of the bucket: the day for 24 hours or more, else hours counted from midnight."""
    day = F.date_trunc("day", ts.cast("timestamp")).cast("timestamp_ntz")
    if hours >= 24:
        return day
    return day + F.make_dt_interval(F.lit(0), (F.floor(F.hour(ts) / hours) * hours).cast("int"), F.lit(0), F.lit(0))


def buckets(df: DataFrame, keys: list[str], ts: str, hours: int, measures: dict[str, Column]) -> DataFrame:
    """A row for each group and bucket that has rows: window_start, window_end, doc_count, rate, measures."""
    start = bucket_start(F.col(ts), hours)
    out = df.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("doc_count"), *[m.alias(n) for n, m in measures.items()])
    end = F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))
    return out.withColumn("window_end", end).withColumn("rate", F.round(F.col("doc_count") / hours, 6))


def momentum(series: DataFrame, keys: list[str], now: Column, hours: int = 24, baseline_days: int = 14) -> DataFrame:
    """Rates of the current, previous and baseline windows, and how they differ.

    The current window has no upper bound; the baseline is averaged over the buckets that exist."""

    def since(h: int) -> Column:
        return now - F.make_dt_interval(F.lit(0), F.lit(h), F.lit(0), F.lit(0))

    end, n = F.col("window_end"), F.col("doc_count")
    base = (end >= since(24 * baseline_days)) & (end < since(hours))
    sums = series.groupBy(*keys).agg(
        F.sum(F.when(end >= since(hours), n).otherwise(0)).alias("cur"),
        F.sum(F.when((end >= since(2 * hours)) & (end < since(hours)), n).otherwise(0)).alias("prev"),
        F.sum(F.when(base, n).otherwise(0)).alias("base"),
        F.count_if(base).alias("base_rows"),
    )
    rates = sums.select(
        *keys,
        F.round(F.col("cur") / hours, 6).alias("current_rate"),
        F.round(F.col("prev") / hours, 6).alias("previous_rate"),
        F.round(F.col("base") / F.greatest(F.col("base_rows") * hours, F.lit(hours)), 6).alias("baseline_rate"),
    )
    return rates.withColumn("velocity", F.round(F.col("current_rate") - F.col("baseline_rate"), 6)).withColumn(
        "acceleration", F.round(F.col("current_rate") - F.col("previous_rate"), 6)
    )


def jumps(series: DataFrame, keys: list[str], value: str = "doc_count", order: str = "window_start", factor: float = 1.5) -> DataFrame:
    """Rows whose step from the row before is at least ``factor`` times the group's mean step, and 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    return (
        series.withColumn("step", step)
        .withColumn("limit", F.greatest(factor * F.avg("step").over(whole), F.lit(1.0)))
        .withColumn("strength", F.col("step") / F.greatest(F.max(value).over(whole), F.lit(1)))
        .filter(F.col("step") >= F.col("limit"))
    )


def merge_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Several entities' series as one: counts add up, averages are averaged, freshness is the best."""
    return series.groupBy(*keys, "window_start", "window_end").agg(
        F.sum("doc_count").alias("doc_count"), F.avg("avg_value").alias("avg_value"), F.max("last_at").alias("last_at")
    )


def counter_increase(samples: DataFrame, labels: list[str], ts: str, value: str) -> DataFrame:
    """Growth of counters that may restart from zero: after a fall, the new value is the growth."""
    w = Window.partitionBy(*labels).orderBy(ts)
    before = F.lag(value).over(w)
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("_g", grown).groupBy(*labels).agg(F.sum("_g").alias("increase"))


def pelt(x: np.ndarray, least: int, penalty: float) -> list[int]:
    """Places where the mean of ``x`` changes, by pruned exact search with squared error."""
    n = len(x)
    s, q = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(np.square(x)))

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        return q[b] - q[a] - np.square(s[b] - s[a]) / (b - a)

    total = np.full(n + 1, np.inf)
    total[0] = -penalty
    last = np.zeros(n + 1, int)
    until = {0: n + 1}  # the time from which a start can no longer be best: one shortest segment after it fell behind
    for t in range(least, n + 1):
        until = {a: x for a, x in until.items() if x > t}
        starts = np.array([a for a in until if t - a >= least])
        found = total[starts] + cost(starts, t) + penalty
        best = int(found.argmin())
        total[t], last[t] = found[best], starts[best]
        for a in starts[found - penalty > total[t]].tolist():
            until[a] = min(until[a], t + least)
        until[t] = n + 1
    out, t = [], n
    while t > 0:
        t = int(last[t])
        if t > 0:
            out.append(t)
    return out[::-1]


def change_points(series: DataFrame, key: str, value: str = "doc_count", order: str = "window_start", least: int = 2) -> DataFrame:
    """``(key, breakpoints, strength)`` of each entity's series; a series of few buckets has none.

    An entity has one row for each bucket, so a group is as long as the time it covers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        found = pelt(x, least, max(float(np.sqrt(len(x))), 2.0)) if len(x) >= max(2 * least, 4) else []
        top = max(x.max(), 1.0)
        strength = abs(x[found[-1]] - x[found[-1] - 1]) / top if found else abs(x[-1] - x[0]) / top
        return pd.DataFrame({key: [pdf[key].iloc[0]], "breakpoints": [found], "strength": [round(float(strength), 6)]})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, breakpoints array<int>, strength double")


def window_changes(series: DataFrame, keys: list[str], value: str = "doc_count", order: str = "window_start", half: int = 2, apart: int = 1) -> DataFrame:
    """``(keys, order, n, discrepancy)``: change points by two sliding windows, without Python.

    The discrepancy at a bucket is what a split there saves of the squared errors of the ``half`` buckets before it and the ``half`` from it
    on: half of ``half`` times the squared difference of their means. A change point is a peak of it, greater than all within
    ``apart`` buckets to both sides, above the root of the series' length (2 at least). Buckets without so many to both sides
    have none. An entity has one row for each bucket, so a window's partition is as long as the time it covers."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.avg(value).over(w.rowsBetween(-half, -1)), F.avg(value).over(w.rowsBetween(0, half - 1))
    rows = series.select(*keys, order, F.col(value).cast("double").alias(value))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_i", F.row_number().over(w) - 1)
    inside = (F.col("_i") >= half) & (F.col("_i") <= F.col("n") - half)
    rows = rows.withColumn("discrepancy", F.when(inside, half / 2 * F.pow(before - after, F.lit(2))))
    around = [F.coalesce(F.max("discrepancy").over(w.rowsBetween(*span)), F.lit(-1.0)) for span in ((-apart, -1), (1, apart))]
    peak = (F.col("discrepancy") > around[0]) & (F.col("discrepancy") > around[1]) & (F.col("discrepancy") > F.greatest(F.sqrt("n"), F.lit(2.0)))
    return rows.withColumn("_peak", peak).filter("_peak").select(*keys, order, "n", "discrepancy")


__all__ = ["bucket_start", "buckets", "change_points", "counter_increase", "jumps", "merge_series", "momentum", "pelt", "window_changes"]
