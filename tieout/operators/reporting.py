"""Forecasts, summaries, lists and lookups over a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.money import rupees
from tieout.operators.ordering import with_ordinals
from tieout.vocab import FORECAST_DAYS, MAX_LISTED_ROWS

# The figures of a comparison (fixed values).
COMPARABLE = ("auto_rate", "assist_rate", "open_rate", "precision", "recall", "false_matches", "records",
              "open_exceptions", "amount_at_risk", "throughput_rps", "llm_requests", "llm_tokens")


def cash_forecast(settlements: DataFrame, groups: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Fourteen days from the first settlement: payout recognised, and payout still blocked."""
    recognised = groups.filter("settlement_id is not null").select(F.col("settlement_id").alias("id")).distinct()
    blocked = exceptions.filter("kind = 'settlement'").select(F.col("record_id").alias("id")).distinct()
    start = settlements.agg(F.min("settled_at").alias("start")).filter("start is not null")
    days = start.select(F.explode(F.sequence("start", F.date_add("start", FORECAST_DAYS - 1))).alias("date"))
    per_id = (settlements.select("id", "settled_at", "payout").join(days, F.col("settled_at") == F.col("date"))
              .join(recognised.withColumn("r", F.lit(True)), "id", "left")
              .join(blocked.withColumn("b", F.lit(True)), "id", "left"))
    totals = per_id.groupBy("date").agg(
        F.sum(F.when(F.col("r"), F.col("payout"))).alias("recognised"),
        F.sum(F.when(F.col("r").isNull() & F.col("b"), F.col("payout"))).alias("blocked"))
    return days.join(totals, "date", "left").select(
        "date", F.coalesce("recognised", F.lit(0)).alias("recognised"),
        F.coalesce("blocked", F.lit(0)).alias("blocked"))


def unrecognised_cash(bank_lines: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Credit on lines that no settlement explains."""
    lines = exceptions.filter("code = 'UNIDENTIFIED_CREDIT' and kind = 'bank_line'").select(
        F.col("record_id").alias("id"))
    return bank_lines.join(lines, "id", "left_semi").agg(
        F.coalesce(F.sum("credit"), F.lit(0)).cast("long").alias("unrecognised_cash"))


def exception_summary(exceptions: DataFrame) -> DataFrame:
    """Per code: count, exposure and the first three ids in filing order; grand totals alongside.

    The three examples come from a row-number limit, which Spark cuts down inside
    each partition before anything is shuffled.
    """
    totals = exceptions.groupBy("code").agg(
        F.count("*").alias("count"), F.sum("amount_at_risk").cast("long").alias("amount_at_risk"))
    first = Window.partitionBy("code").orderBy("stage", "ord", "id")
    examples = (exceptions.select("code", "stage", "ord", "id").withColumn("rn", F.row_number().over(first))
                .filter("rn <= 3").groupBy("code")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda r: r["id"]),
                                  ",").alias("example_ids")))
    # At most one row per code from here on.
    whole = Window.partitionBy()
    return totals.join(examples, "code").select(
        "code", "count", "amount_at_risk", "example_ids",
        F.sum("count").over(whole).alias("total_exceptions"),
        F.sum("amount_at_risk").over(whole).alias("total_amount_at_risk"))


def capped(rows: DataFrame, *order: Column, limit: int = MAX_LISTED_ROWS) -> DataFrame:
    """The first rows in an order, with the true total and whether the list was cut."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("total", total).withColumn("truncated", F.col("total") > limit)


def list_exceptions(exceptions: DataFrame, code: str | None = None, limit: int = MAX_LISTED_ROWS) -> DataFrame:
    """Largest exposure first."""
    kept = exceptions if code is None else exceptions.filter(F.col("code") == code)
    return capped(kept, F.desc("amount_at_risk"), F.asc("stage"), F.asc("ord"), F.asc("id"), limit=limit)


def list_groups(groups: DataFrame, status: str | None = None, pass_id: str | None = None,
                limit: int = MAX_LISTED_ROWS) -> DataFrame:
    kept = groups if status is None else groups.filter(F.col("status") == status)
    kept = kept if pass_id is None else kept.filter(F.col("pass_id") == pass_id)
    return capped(kept, F.asc("ord"), F.asc("id"), limit=limit)


def report_order(exceptions: DataFrame, limit: int | None = None) -> DataFrame:
    """Severity first, then exposure."""
    ordered = exceptions.orderBy(F.desc("severity"), F.desc("amount_at_risk"), F.asc("stage"), F.asc("ord"))
    return ordered if limit is None else ordered.limit(limit)


def locate_records(wanted: DataFrame, groups: DataFrame, members: DataFrame, exceptions: DataFrame) -> DataFrame:
    """For each (kind, id): the group that holds it, else its exception, else not found."""
    held = members.groupBy("kind", "id").agg(F.min("group_id").alias("group_id"))
    filed = exceptions.groupBy("kind", F.col("record_id").alias("id")).agg(
        F.min_by("code", F.struct("stage", "ord")).alias("code"), F.min("id").alias("exception_id"))
    found = wanted.join(held, ["kind", "id"], "left").join(filed, ["kind", "id"], "left")
    place = (F.when(F.col("group_id").isNotNull(), "matched_group")
             .when(F.col("exception_id").isNotNull(), "exception").otherwise("not_found"))
    loose = F.col("group_id").isNull()
    return found.select("kind", "id", place.alias("found_in"), "group_id",
                        F.when(loose, F.col("exception_id")).alias("exception_id"),
                        F.when(loose, F.col("code")).alias("code"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per (run, exception): the last one wins."""
    values = [c for c in decisions.columns if c not in ("run_id", "exception_id")]
    return decisions.groupBy("run_id", "exception_id").agg(
        F.max_by(F.struct(*values), "created_at").alias("last")).select(
        "run_id", "exception_id", *[F.col(f"last.{c}").alias(c) for c in values])


def decision_overlay(exceptions: DataFrame, decisions: DataFrame, run_id: str) -> DataFrame:
    latest = latest_decisions(decisions.filter(F.col("run_id") == run_id)).drop("run_id")
    joined = exceptions.join(latest.withColumnRenamed("exception_id", "id"), "id", "left")
    return joined.withColumn("decision", F.coalesce("decision", F.lit("open")))


def compare_runs(metrics: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """All comparable figures of two runs side by side, and right minus left; `metrics` has a column for each."""
    figures = list(COMPARABLE)
    both = metrics.filter(F.col("run_id").isin(left_id, right_id)).select(
        "run_id", *[F.col(c).cast("double").alias(c) for c in figures])
    long_form = both.unpivot("run_id", figures, "metric", "value")
    side = long_form.groupBy("metric").agg(
        F.max(F.when(F.col("run_id") == left_id, F.col("value"))).alias("a"),
        F.max(F.when(F.col("run_id") == right_id, F.col("value"))).alias("b"))
    return side.withColumn("delta_b_minus_a", F.col("b") - F.col("a"))


def search_groups(groups: DataFrame, members: DataFrame, needle: str) -> DataFrame:
    """(id) of groups with the text in an id or in their evidence."""
    text = needle.strip().lower()
    quoted = groups.filter(F.exists("evidence", lambda e: F.contains(
        F.lower(e["value"]), F.lit(text)))).select("id")
    by_member = members.filter(F.contains(F.lower("id"), F.lit(text))).select(F.col("group_id").alias("id"))
    own = groups.filter(F.contains(F.lower("id"), F.lit(text))).select("id")
    return quoted.unionByName(by_member).unionByName(own).distinct()


def search_exceptions(exceptions: DataFrame, needle: str) -> DataFrame:
    text = F.lit(needle.strip().lower())
    fields = ("id", "record_id", "code", "explanation", "suggested_action")
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.contains(F.lower(field), text), F.lit(False))
    return exceptions.filter(hit)


def search_records(groups: DataFrame, members: DataFrame, exceptions: DataFrame, needle: str) -> DataFrame:
    """Matching groups and exceptions as two capped lists, each with its own total."""
    in_groups = capped(search_groups(groups, members, needle), F.asc("id"))
    in_exceptions = capped(search_exceptions(exceptions, needle).select("id", "stage", "ord"),
                           F.asc("stage"), F.asc("ord"), F.asc("id")).drop("stage", "ord")
    return in_groups.withColumn("found_in", F.lit("matched_group")).unionByName(
        in_exceptions.withColumn("found_in", F.lit("exception")))


def nonzero_days(forecast: DataFrame) -> DataFrame:
    """The forecast as a report prints it: days on which something moves."""
    return forecast.filter("recognised <> 0 or blocked <> 0").select(
        "date", rupees(F.col("recognised")).alias("recognised"), rupees(F.col("blocked")).alias("blocked"))


def report_positions(exceptions: DataFrame) -> DataFrame:
    """Place of every exception in the report: severity first, then exposure."""
    keyed = exceptions.withColumn("__severity", -F.col("severity")).withColumn("__amount", -F.col("amount_at_risk"))
    return with_ordinals(keyed, ["__severity", "__amount", "stage", "ord"], "position").drop("__severity", "__amount")
