"""Audit of calls against per-minute and per-day limits.

Counted by calendar minute and UTC day. A live limiter opens its window at the
first call instead, so the two can differ at window edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calls that a user may make in a day for each key in use (fixed value).
DAILY_QUOTA = 25
MINUTE_KEYS = ["window_start", "model", "key", "user_id"]


def calls_per_window(calls: DataFrame, keys: list[str], width: str, delay: str = "1 day") -> DataFrame:
    """Calls per key and tumbling window; works on a stream and on a table."""
    timed = calls.withWatermark("at", delay) if calls.isStreaming else calls
    return timed.groupBy(F.window("at", width).alias("w"), *keys).agg(F.count("*").alias("calls")).select(
        *keys, F.col("w.start").alias("window_start"), "calls")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over", F.greatest(F.col("calls") - limit, F.lit(0)))


def usage_by_minute(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """(window_start, model, key, user_id, requests, tokens): the one pass over the calls, streamed or not.

    Every limit's window is a sum of these rows.
    """
    timed = calls.withWatermark("at", delay) if calls.isStreaming else calls
    return timed.groupBy(F.window("at", "1 minute").alias("w"), "model", "key", "user_id").agg(
        F.count("*").alias("requests"), F.sum("tokens").cast("long").alias("tokens")).select(
        F.col("w.start").alias("window_start"), "model", "key", "user_id", "requests", "tokens")


def in_force(limits: DataFrame) -> DataFrame:
    """Adds `valid_to`: a limit holds until the model's next one; the table has a few rows for each model."""
    return limits.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("model").orderBy("valid_from")))


def against_limits(minutes: DataFrame, limits: DataFrame, keys: DataFrame, user_quota: int | None = None) -> DataFrame:
    """(scope, model, key, user_id, window_start, used, ceiling, over) of every window that was used.

    `limits` are (model, rpm, rpd, tpm, valid_from): a window is held against the row in force when it began, so a
    quota can change while calls come in; without a row in force there is no ceiling and `over` is null. `keys` are the pool's (key, active_from). A user's
    day allows DAILY_QUOTA calls for each key active when it began, one at least, or `user_quota` if it is given.
    """
    day = F.date_trunc("day", "window_start")
    per_minute = minutes.groupBy("window_start", "model", "key").agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))
    per_day = per_minute.groupBy(day.alias("window_start"), "model", "key").agg(F.sum("requests").alias("requests"))
    per_user = minutes.groupBy(day.alias("window_start"), "user_id").agg(F.sum("requests").alias("used"))

    def held(windows: DataFrame, *measures: tuple[str, str, str]) -> DataFrame:
        in_use = in_force(limits).withColumnRenamed("model", "of")
        joined = windows.join(in_use, (F.col("model") == F.col("of")) & (F.col("window_start") >= F.col("valid_from"))
                              & (F.col("valid_to").isNull() | (F.col("window_start") < F.col("valid_to"))), "left")
        each = F.explode(F.array(*[F.struct(F.lit(scope).alias("scope"), F.col(used).alias("used"), F.col(ceiling).cast("long").alias("ceiling"))
                                   for scope, used, ceiling in measures])).alias("m")
        return joined.select("model", "key", "window_start", each).select(
            "m.scope", "model", "key", F.lit(None).cast("bigint").alias("user_id"), "window_start", "m.used", "m.ceiling")

    days = per_user.select("window_start").distinct()
    # calendar days by keys of the pool, both short lists
    pool = days.join(keys, F.col("active_from") <= F.col("window_start"), "left").groupBy("window_start").agg(
        F.count_distinct("key").alias("active"))
    allowed: Column = F.lit(user_quota).cast("long") if user_quota is not None else DAILY_QUOTA * F.greatest(F.lit(1), F.col("active"))
    users = per_user.join(pool, "window_start").select(
        F.lit("user_day").alias("scope"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("key"),
        F.col("user_id").cast("bigint").alias("user_id"), "window_start", "used", allowed.cast("long").alias("ceiling"))
    windows = (held(per_minute, ("rpm", "requests", "rpm"), ("tpm", "tokens", "tpm")).unionByName(held(per_day, ("rpd", "requests", "rpd")))
               .unionByName(users))
    return windows.withColumn("over", F.when(F.col("ceiling").isNotNull(), F.greatest(F.col("used") - F.col("ceiling"), F.lit(0))))
