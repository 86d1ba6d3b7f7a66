"""Service and collection metrics over log tables, and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import fixed_values as fv
from newsloom.operators.ranking import attach
from newsloom.session import cut


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("n"))


def latency_histogram(log: DataFrame, buckets=fv.LATENCY_BUCKETS_MS) -> DataFrame:
    """(method, path, le, n, total, sum_ms): cumulative counts per bound. One
    aggregate makes all bounds; they become rows afterwards."""
    bounds = [(str(b), F.count_if(F.col("duration_ms") <= b)) for b in buckets] + [("+Inf", F.count("*"))]
    wide = log.groupBy("method", "path").agg(
        F.count("*").alias("total"), F.sum("duration_ms").alias("sum_ms"),
        *[n.alias(f"_b{i}") for i, (_, n) in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("n")) for i, (le, _) in enumerate(bounds)])
    return wide.select("method", "path", "total", "sum_ms", F.inline(rows))


def exact_quantile(rows: DataFrame, keys: list[str], value: str, q: float, cells: int = 1024, rounds: int = 2) -> DataFrame:
    """(keys…, quantile): the least value of each group that a share of at least q
    of its values does not exceed, without holding a group's values together.

    A round counts the group's values in `cells` cells between its bounds, finds the
    cell that holds the wanted rank, and makes its least and greatest value the next
    bounds. Values of the last cell are counted one by one."""
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    state = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn(
        "_want", F.greatest(F.ceil(F.col("_n") * q), F.lit(1)))
    order = Window.partitionBy(*keys)
    for step in range(rounds + 1):
        inside = rows.join(state, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        width = (F.col("_hi") - F.col("_lo")) / cells
        cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(cells - 1))).otherwise(F.lit(0))
        last = step == rounds
        counted = inside.groupBy(*keys, (F.col("_v") if last else cell).alias("_cell")).agg(
            F.count("*").alias("_c"), F.first("_want").alias("_want"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(order.orderBy("_cell"))
        found = counted.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want")))
        state = cut(found.select(*keys, "_lo", "_hi", (F.col("_want") - (F.col("_upto") - F.col("_c"))).alias("_want")))
    return state.select(*keys, F.col("_lo").alias("quantile"))


def latency_quantile(log: DataFrame, q: float = 0.95) -> DataFrame:
    """The exact quantile of every method and path."""
    return exact_quantile(log, ["method", "path"], "duration_ms", q).withColumnRenamed("quantile", "latency")


def latency_sketches(log: DataFrame, window: str = "1 hour", k: int = 800) -> DataFrame:
    """(window, method, path, n, sketch): a mergeable KLL sketch of the durations of
    every window. Its size depends on k, not on the events."""
    return log.groupBy(F.window("ts", window).alias("window"), "method", "path").agg(
        F.count("duration_ms").alias("n"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(k)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, q: float = 0.95, *keys: str) -> DataFrame:
    """(keys…, n, latency) over all windows of the given sketches: they are merged,
    and events are not read again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias("latency"))


def crawl_article_counts(log: DataFrame) -> DataFrame:
    return log.filter("ok").groupBy("source").agg(F.count("*").alias("n"))


def crawl_error_counts(log: DataFrame) -> DataFrame:
    return log.filter("not ok").groupBy("source", "error_type").agg(F.count("*").alias("n"))


def call_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("operation", "model").agg(F.count("*").alias("n"))


def last_values(gauges: DataFrame) -> DataFrame:
    """Latest value of every gauge from samples (name, ts, value)."""
    return gauges.groupBy("name").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


# --- alert rules -------------------------------------------------------------
# Events are first counted per minute, so what the windows below sort is one row
# per series and minute, whatever the number of events.

def minute_counts(log: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    """(keys…, minute, counts…) without gaps between the log's first and last
    minute; `minute` is the end of the counted minute in epoch minutes."""
    minute = F.floor(F.unix_seconds("ts") / 60) + 1
    counts = log.groupBy(*keys, minute.alias("minute")).agg(*[F.count_if(f).alias(n) for n, f in flags.items()])
    span = log.agg(F.min(minute).alias("_lo"), F.max(minute).alias("_hi"))
    series = attach(log.select(*keys).distinct(), span) if keys else span
    grid = series.filter("_lo is not null").select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("minute"))
    return grid.join(counts, [*keys, "minute"], "left").na.fill(0, list(flags))


def over_last(value: str, keys: list[str], minutes: int) -> Column:
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return F.sum(value).over(window.orderBy("minute").rangeBetween(-(minutes - 1), 0))


def sustained(df: DataFrame, condition: Column, keys: list[str], minutes: int) -> DataFrame:
    """Minutes at which the condition has held at every evaluation of the last
    `minutes`, the present one included."""
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("minute").rangeBetween(-minutes, 0)
    marked = df.withColumn("_c", F.coalesce(condition, F.lit(False)).cast("int"))
    return marked.withColumn("_all", F.min("_c").over(window)).withColumn("_n", F.count("_c").over(window)).filter(
        (F.col("_all") == 1) & (F.col("_n") == minutes + 1)).drop("_c", "_all", "_n")


def crawl_failure_alerts(log: DataFrame, ratio: float = 0.3, window: int = 15, hold: int = 10) -> DataFrame:
    """Sources whose errors per collected article stay above the ratio."""
    counts = minute_counts(log, ["source"], errors=~F.col("ok"), articles=F.col("ok"))
    rates = counts.select("source", "minute", over_last("errors", ["source"], window).alias("errors"),
                          over_last("articles", ["source"], window).alias("articles"))
    condition = (F.col("errors") > 0) & (F.col("articles") > 0) & (F.col("errors") > ratio * F.col("articles"))
    return sustained(rates, condition, ["source"], hold)


def error_rate_alerts(log: DataFrame, per_second: float = 0.05, window: int = 5, hold: int = 5, as_ratio: bool = False) -> DataFrame:
    """Times at which server errors stay above a rate per second, or above a
    share of all requests."""
    counts = minute_counts(log, [], errors=F.col("status").between(500, 599), requests=F.lit(True))
    rates = counts.select("minute", over_last("errors", [], window).alias("errors"),
                          over_last("requests", [], window).alias("requests"))
    limit = per_second * (F.col("requests") if as_ratio else F.lit(window * 60))
    return sustained(rates, F.col("errors") > limit, [], hold)


def call_rate_alerts(log: DataFrame, per_second: float = 200, window: int = 60, hold: int = 15) -> DataFrame:
    counts = minute_counts(log, [], calls=F.lit(True))
    rates = counts.select("minute", over_last("calls", [], window).alias("calls"))
    return sustained(rates, F.col("calls") > per_second * window * 60, [], hold)


def gauge_alerts(samples: DataFrame, condition: Column, hold: int, keys: list[str] | None = None) -> DataFrame:
    """Gauge samples (keys…, ts, value), last value per minute, for which the
    condition on `value` has held; minutes without a sample break the run."""
    keys = keys or []
    minute = F.floor(F.unix_seconds("ts") / 60) + 1
    last = samples.groupBy(*keys, minute.alias("minute")).agg(F.max_by("value", "ts").alias("value"))
    return sustained(last, condition, keys, hold)


def lag_alerts(samples: DataFrame, limit: float = 100, hold: int = 30) -> DataFrame:
    return gauge_alerts(samples, F.col("value") > limit, hold)


def down_alerts(samples: DataFrame, hold: int = 1) -> DataFrame:
    return gauge_alerts(samples, F.col("value") == 0, hold)
