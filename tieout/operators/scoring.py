"""Run rates, accuracy against an answer key, and what a run was worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.money import duration_text
from tieout.model import AMOUNT_OF, AnswerKey, Books
from tieout.operators.ordering import with_ordinals
from tieout.session import materialize
from tieout.vocab import KINDS, SECONDS_PER_MANUAL_MATCH, UNMATCHABLE


def exact_groups(groups: DataFrame, members: DataFrame, key: AnswerKey) -> DataFrame:
    """(group_id) of the groups whose invoices and payments equal the answer key's.

    Set equality without building the sets: both sides are tagged, a record must
    come from both, and a group is exact when none of its records is one-sided.
    """
    known = key.groups.select(F.col("settlement_id").alias("group_id"))
    ours = members.filter(F.col("kind").isin("invoice", "payment")).select("group_id", "kind", "id")
    theirs = key.members.select("group_id", "kind", "id")
    tagged = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(2)))
    records = tagged.groupBy("group_id", "kind", "id").agg(F.expr("bit_or(side)").alias("sides"))
    wrong = records.filter("sides <> 3").select("group_id").distinct()
    return (groups.select(F.col("id").alias("group_id")).join(known, "group_id", "left_semi")
            .join(wrong, "group_id", "left_anti"))


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def run_metrics(books: Books, groups: DataFrame, members: DataFrame, exceptions: DataFrame,
                key: AnswerKey | None = None) -> DataFrame:
    """One row of rates and totals; accuracy columns are null without an answer key.

    Each table is counted where it lies, in one pass for all its figures, and gives one row; the
    rows meet in a union, so that no record passes through an aggregate of all figures.
    """
    count = F.count("*")
    parts = [books.records(kind).agg(*[count.alias(n) for n in (
        ("records", "payments_total") if kind == "payment" else ("records",))]) for kind in KINDS]
    status = members.filter("kind = 'payment'").join(
        groups.select(F.col("id").alias("group_id"), "status"), "group_id").select("id", "status").distinct()
    parts.append(status.agg(F.count_if(F.col("status") == "auto").alias("payments_auto"),
                            F.count_if(F.col("status") == "assisted").alias("payments_assisted")))
    # a row for each payment that is open, and one for all other records
    paid = F.coalesce(F.col("kind") == "payment", F.lit(False))
    open_rows = exceptions.groupBy(paid.alias("paid"), F.when(paid, F.col("record_id")).alias("record_id")).agg(
        count.alias("n"), F.sum(F.col("amount_at_risk").cast("decimal(38,0)")).alias("at_risk"))
    parts.append(open_rows.agg(F.count_if("paid").alias("payments_open"), F.sum("n").alias("open_exceptions"),
                               F.sum("at_risk").alias("amount_at_risk")))
    parts.append(groups.agg(F.sum(F.col("payout").cast("decimal(38,0)")).alias("amount_cleared"), count.alias("groups")))
    if key is not None:
        parts += [exact_groups(groups, members, key).agg(count.alias("exact_groups")),
                  key.groups.agg(count.alias("truth_groups"))]
    names = ["records", "payments_total", "payments_auto", "payments_assisted", "payments_open", "open_exceptions",
             "amount_at_risk", "amount_cleared", "groups", "exact_groups", "truth_groups"]
    parts = [p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast("decimal(38,0)").alias(n) for n in names]) for p in parts]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    row = union.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])

    def rate(name: str) -> Column:
        return _ratio(F.col(name), F.col("payments_total"), 0.0)

    scored = key is not None
    precision = _ratio(F.col("exact_groups"), F.col("groups"), 1.0) if scored else F.lit(None).cast("double")
    recall = _ratio(F.col("exact_groups"), F.col("truth_groups"), 1.0) if scored else F.lit(None).cast("double")
    false = (F.col("groups") - F.col("exact_groups")) if scored else F.lit(None).cast("long")
    return row.select(
        rate("payments_auto").alias("auto_rate"), rate("payments_assisted").alias("assist_rate"),
        rate("payments_open").alias("open_rate"), precision.alias("precision"), recall.alias("recall"),
        false.alias("false_matches"), "records", "open_exceptions", "amount_at_risk", "payments_total",
        "payments_auto", "payments_assisted", "amount_cleared")


def class_recall(groups: DataFrame, members: DataFrame, key: AnswerKey) -> DataFrame:
    """Per difficulty class: how many records, and the share with the right outcome."""
    exact = exact_groups(groups, members, key)
    held = members.filter(F.col("kind").isin("invoice", "bank_line")).select("group_id", "kind", "id")
    held = held.join(exact.distinct().withColumn("right", F.lit(True)), "group_id", "left")
    # One row per record that a group holds, with whether an exact group does.
    grouped = held.groupBy("kind", "id").agg(F.lit(True).alias("grouped"), F.bool_or("right").alias("exact"))
    records = key.records.filter(F.col("kind").isin("invoice", "bank_line")).join(grouped, ["kind", "id"], "left")
    good = F.when(F.col("kind") == "bank_line", F.col("grouped")).otherwise(F.col("exact"))
    correct = F.when(F.col("group_id") == UNMATCHABLE, F.col("grouped").isNull()).otherwise(
        F.coalesce(good, F.lit(False)))
    return records.groupBy(F.col("difficulty").alias("class")).agg(
        F.count("*").alias("count"), F.count_if(correct).alias("correct")).select(
        "class", "count", (F.col("correct") / F.col("count")).alias("recall"))


def class_counts(key: AnswerKey) -> DataFrame:
    """Invoices by class, and the bank lines that are unrelated credits."""
    kept = key.records.filter("kind = 'invoice' or (kind = 'bank_line' and difficulty = 'unrelated_credit')")
    return kept.groupBy(F.col("difficulty").alias("class")).agg(F.count("*").alias("count"))


def chain_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct records tied per kind, and groups closed."""
    per_kind = members.select("kind", "id").distinct().groupBy("kind").agg(F.count("*").alias("tied"))
    closed = groups.filter(F.col("status").isin("auto", "assisted")).agg(F.count("*").alias("tied"))
    return per_kind.unionByName(closed.select(F.lit("group").alias("kind"), "tied"))


def accounting(books: Books, members: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Per kind: every record matched or excepted, never both, and the amounts add up."""
    matched = members.select("kind", "id").distinct().withColumn("m", F.lit(1))
    open_rows = exceptions.select("kind", F.col("record_id").alias("id")).distinct().withColumn("e", F.lit(1))
    parts = [books.indexed(k).select(F.lit(k).alias("kind"), "id", F.col(a).alias("amount"))
             for k, a in AMOUNT_OF.items()]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    flagged = records.join(matched, ["kind", "id"], "left").join(open_rows, ["kind", "id"], "left")
    m, e = F.coalesce("m", F.lit(0)), F.coalesce("e", F.lit(0))
    amount = F.col("amount").cast("decimal(38,0)")
    return flagged.groupBy("kind").agg(
        F.count("*").alias("records"), F.sum(m).alias("matched"), F.sum(e).alias("excepted"),
        F.count_if(m + e == 0).alias("unaccounted"), F.count_if(m + e == 2).alias("in_both"),
        F.sum(amount * m).cast("long").alias("matched_amount"), F.sum(amount * e).cast("long").alias("open_amount"),
        F.sum(amount).cast("long").alias("total_amount"))


def run_impact(metrics: DataFrame) -> DataFrame:
    """What the run saved, at a fixed number of seconds per chain closed by hand."""
    closed = F.col("payments_auto") + F.col("payments_assisted")
    seconds = closed * SECONDS_PER_MANUAL_MATCH
    return metrics.filter(closed.isNotNull() & F.col("payments_total").isNotNull()).select(
        closed.alias("cleared_without_a_human"), "payments_total",
        F.col("open_exceptions").alias("still_needs_a_human"),
        F.coalesce("amount_cleared", F.lit(0)).alias("amount_cleared"), "amount_at_risk",
        seconds.alias("seconds_saved"), duration_text(seconds).alias("time_saved"))


TOTAL = "all"


def exact_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) of the values that are there.

    Rows are put into one global order by key and value, in ranges, so a key that holds nearly all of them is spread over many
    tasks; the one or two rows in the middle of each key's places are then picked by number.
    """
    held = rows.select(key, value).filter(F.col(value).isNotNull()).withColumn("__tie", F.monotonically_increasing_id())
    placed = materialize(with_ordinals(held, [key, value, "__tie"], "place"), "placed")
    spans = placed.groupBy(F.col(key).alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # a key's one or two middle places, asked of the numbers
    middle = spans.select(F.explode(F.array_distinct(F.array(F.expr("first + (n - 1) div 2"), F.expr("first + n div 2")))).alias("place"))
    return placed.join(middle, "place").groupBy(key).agg(F.avg(value).alias("median"))


def sweep_summary(history: DataFrame) -> DataFrame:
    """Metrics history by label, and over all labels: sums, means and the exact median throughput.

    `position` is the order of the report: labels by name, the total last.
    """
    both = history.withColumn("label", F.explode(F.array("label", F.lit(TOTAL))))
    totals = both.groupBy("label").agg(
        F.count("*").alias("runs"), F.sum("records").alias("records"),
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"),
        F.coalesce(F.sum("false_matches"), F.lit(0)).alias("false_matches_total"),
        F.coalesce(F.max("false_matches"), F.lit(0)).alias("false_matches_worst"),
        F.round(F.avg("auto_rate"), 4).alias("auto_rate"),
        F.round(F.avg("open_exceptions"), 1).alias("open_exceptions_mean"))
    medians = exact_medians(both, "label", "throughput_rps").select(F.col("label").alias("of"), "median")
    joined = totals.join(medians, totals["label"].eqNullSafe(F.col("of")), "left").drop("of")
    # a row for each label
    order = Window.orderBy(F.col("label").eqNullSafe(TOTAL), F.col("label").asc_nulls_first())
    return joined.withColumn("throughput_rps_median", F.round("median", 1)).withColumn(
        "position", F.row_number().over(order)).drop("median")


def multiset_hash(leaves: DataFrame, by: list[str], leaf: str) -> DataFrame:
    """(by, hash): one sha256 over the multiset of sha256 texts in `leaf`, for each value of `by`.

    A tree: leaves that share their first four digits are sorted and hashed, then nodes that share two, then all. A node holds at most
    a 65,536th of the leaves, or 256 nodes, and two multisets with one hash would be a collision of sha256.
    """
    nodes = leaves.select(*by, F.col(leaf).alias("node"), F.col(leaf).alias("spot"))
    for digits in (4, 2, 0):
        nodes = nodes.select(*by, F.concat("spot", "node").alias("node"), F.substring("spot", 1, digits).alias("spot")).groupBy(*by, "spot").agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("node")), ""), 256).alias("node"))
    return nodes.select(*by, F.col("node").alias("hash"))


def output_hash(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One sha256 for a result, whatever order or partitioning it arrives in.

    Each group's members are hashed as a multiset, and the groups with these hashes as another, so
    equal results give equal hashes and no group or run is ever one long string.
    """
    held = members.filter(F.col("kind").isin("invoice", "payment")).select(
        F.col("group_id").alias("id"), F.sha2(F.concat_ws(":", "kind", F.col("id")), 256).alias("leaf"))
    per_group = multiset_hash(held, ["id"], "leaf").withColumnRenamed("hash", "members")
    line = F.concat_ws("|", "id", F.coalesce(F.col("members"), F.lit("")), "settlement_id",
                       "bank_line_id", "status", "pass_id", F.format_string("%.4f", F.col("confidence")),
                       F.col("residual").cast("string"))
    lines = groups.join(per_group, "id", "left").select(F.lit(0).alias("run"), F.sha2(line, 256).alias("leaf"))
    root = multiset_hash(lines, ["run"], "leaf")
    both = groups.agg(F.count("*").alias("groups")).select("groups", F.lit(None).cast("string").alias("hash")).unionByName(
        root.select(F.lit(None).cast("bigint").alias("groups"), "hash"))
    return both.agg(F.max("groups").alias("groups"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("output_hash"))
