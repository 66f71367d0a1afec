"""Queries over the catalog of runs, datasets, their files and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.text import request_key
from tieout.operators.constraints import Disjoint, Listed, Unique
from tieout.operators.joins import spread_nulls
from tieout.vocab import ROLES, RUN_STATES, TERMINAL_STATES

MAX_PAGE = 200

# What must hold over the catalog's tables.
RULES = (
    Unique("dataset name of a user", "datasets", ("user_id", "name")), Unique("role of a dataset", "files", ("dataset_id", "role")),
    Unique("exception of a run", "exceptions", ("run_id", "exception_id")), Unique("request key of a user", "runs", ("user_id", "idempotency_key")),
    Disjoint("held-out seeds", ("golden", "seed"), ("held_out", "seed")), Listed("known role", "files", "role", tuple(ROLES)))


def for_user(rows: DataFrame, user_id) -> DataFrame:
    """Only the user's own rows; someone else's row and no row look the same."""
    return rows.filter(F.col("user_id") == user_id)


def newest_per_user(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Each user's newest rows; the limit is applied inside partitions before the shuffle."""
    if not 0 < limit <= 50:
        raise ValueError(f"a list shows 1 to 50 rows, not {limit}")
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def newest(rows: DataFrame, user_id, limit: int = 50) -> DataFrame:
    return for_user(rows, user_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def page(records: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page in input order, with the total."""
    limit = min(max(limit, 1), MAX_PAGE)
    total = records.agg(F.count("*")).scalar()
    return records.orderBy("ord").offset(max(offset, 0)).limit(limit).withColumn("total", total)


def file_readiness(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Ready when all four roles have at least one valid row."""
    usable = files.filter("valid_count > 0").groupBy("dataset_id").agg(F.countDistinct("role").alias("roles_ready"))
    joined = datasets.join(usable, datasets.id == usable.dataset_id, "left")
    ready = F.coalesce("roles_ready", F.lit(0))
    return joined.select(*[c for c in datasets.columns if c != "status"], ready.alias("roles_ready"),
                         F.when(ready == len(ROLES), "ready").otherwise("draft").alias("status"))


def ready_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter("status = 'ready'")


def runs_per_dataset(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    counts = runs.filter("dataset_id is not null").groupBy("dataset_id").agg(F.count("*").alias("n"))
    return datasets.select(F.col("id").alias("dataset_id")).join(counts, "dataset_id", "left").select(
        "dataset_id", F.coalesce("n", F.lit(0)).alias("runs"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once; rows with a null in the key do not count."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return rows.filter(present).groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def idempotent_rows(requests: DataFrame) -> DataFrame:
    """First request per (user, key); requests without a key all stand."""
    values = [c for c in requests.columns if c not in ("user_id", "idempotency_key")]
    keyed = requests.filter("idempotency_key is not null").groupBy("user_id", "idempotency_key").agg(
        F.min_by(F.struct(*values), F.struct("created_at", "id")).alias("first"))
    keyed = keyed.select("user_id", "idempotency_key", *[F.col(f"first.{c}").alias(c) for c in values])
    return keyed.select(requests.columns).unionByName(requests.filter("idempotency_key is null"))


def upsert_files(current: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row per (dataset, role): the last upload replaces what was there."""
    values = [c for c in current.columns if c not in ("dataset_id", "role")]
    both = current.withColumn("__new", F.lit(0)).unionByName(uploads.withColumn("__new", F.lit(1)))
    return both.groupBy("dataset_id", "role").agg(
        F.max_by(F.struct(*values), F.struct("__new", "uploaded_at")).alias("last")).select(
        "dataset_id", "role", *[F.col(f"last.{c}").alias(c) for c in values])


def write_files(files: DataFrame, path: str) -> None:
    """Replace only the (dataset, role) partitions present in `files`."""
    (files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("role", "dataset_id").parquet(path))


def delete_datasets(doomed: DataFrame, datasets: DataFrame, files: DataFrame, runs: DataFrame):
    """The three tables without the datasets, and per dataset what went with it."""
    ids = doomed.select(F.col("id").alias("dataset_id")).distinct()
    gone_files = files.join(ids, "dataset_id", "left_semi").groupBy("dataset_id").agg(F.count("*").alias("files"))
    gone_runs = runs.join(ids, "dataset_id", "left_semi").groupBy("dataset_id").agg(F.count("*").alias("runs"))
    report = ids.join(gone_files, "dataset_id", "left").join(gone_runs, "dataset_id", "left").fillna(
        0, ["files", "runs"])
    return (datasets.join(ids, datasets.id == ids.dataset_id, "left_anti"),
            files.join(ids, "dataset_id", "left_anti"), runs.join(ids, "dataset_id", "left_anti"), report)


def remove_file(datasets: DataFrame, files: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets and files after some (dataset_id, role) files went; runs are kept."""
    left = files.join(removed.select("dataset_id", "role"), ["dataset_id", "role"], "left_anti")
    return file_readiness(datasets, left), left


def dataset_of_run(runs: DataFrame, datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Per run and file: the dataset behind it, and whether it has an answer key.

    A run without a dataset came from a seed and always has one.
    """
    sets = datasets.select(F.col("id").alias("dataset_id"), "name", F.col("status").alias("dataset_status"), "has_truth")
    kept = files.select("dataset_id", "role", "row_count", "valid_count")
    own = runs.select(F.col("id").alias("run_id"), F.col("dataset_id").alias("named"),
                      spread_nulls(F.col("dataset_id"), "id").alias("dataset_id"))
    joined = own.join(sets, "dataset_id", "left").join(kept, "dataset_id", "left")
    return (joined.withColumn("has_truth_file", F.coalesce("has_truth", F.col("named").isNull())).drop("has_truth")
            .withColumn("dataset_id", F.col("named")).drop("named"))


def stage_order() -> Column:
    pairs = [F.lit(x) for i, s in enumerate(RUN_STATES) for x in (s, min(i, len(RUN_STATES) - 2))]
    return F.element_at(F.create_map(*pairs), F.col("state"))


def first_seen(trace: DataFrame) -> DataFrame:
    """(run_id, state, at): each state once, at its first sighting."""
    return trace.groupBy("run_id", "state").agg(F.min("at").alias("at"))


def latest_state(trace: DataFrame) -> DataFrame:
    """Where each run stands; a terminal state, once reached, is never left."""
    done = F.col("state").isin(*TERMINAL_STATES)
    return trace.groupBy("run_id").agg(
        F.min_by(F.when(done, F.col("state")), F.when(done, F.col("at"))).alias("ended"),
        F.max_by("state", F.struct("at", "event_id")).alias("latest"),
        F.min("at").alias("created_at"), F.max("at").alias("updated_at")).select(
        "run_id", F.coalesce("ended", "latest").alias("state"), "created_at", "updated_at")


def sweep_orphans(runs: DataFrame) -> DataFrame:
    """Every run that has not ended is marked failed."""
    ended = F.col("state").isin(*TERMINAL_STATES)
    return runs.withColumn("swept", ~ended).withColumn("state", F.when(ended, F.col("state")).otherwise("failed"))


def stage_durations(trace: DataFrame) -> DataFrame:
    """How long each stage ran: until the next stage seen began, in milliseconds.

    The queue is never announced; it starts with the run where normalising bounds it.
    """
    seen = first_seen(trace)
    starts = trace.groupBy("run_id").agg(
        F.min("at").alias("at"),
        F.bool_or(F.col("state") == "normalising").alias("bounded"),
        F.bool_or(F.col("state") == "queued").alias("announced"))
    queued = starts.filter("bounded and not announced").select("run_id", F.lit("queued").alias("state"), "at")
    # A run has at most eight rows here, so the window stays tiny.
    order = Window.partitionBy("run_id").orderBy("stage")
    staged = seen.unionByName(queued).withColumn("stage", stage_order())
    return staged.withColumn("next_at", F.lead("at").over(order)).filter(
        ~F.col("state").isin(*TERMINAL_STATES)).select(
        "run_id", "state", (F.unix_millis(F.col("next_at").cast("timestamp"))
                            - F.unix_millis(F.col("at").cast("timestamp"))).alias("millis"))


def total_duration(runs: DataFrame) -> DataFrame:
    """Total per run where the timestamps are in order."""
    millis = F.unix_millis(F.col("updated_at").cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp"))
    return runs.select("run_id", F.when(millis >= 0, millis).alias("millis"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Requests and tokens per run; degraded when any call was."""
    return calls.groupBy("run_id").agg(
        F.count("*").alias("requests"), F.sum("tokens").cast("long").alias("tokens"),
        F.bool_or("degraded").alias("degraded"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per identical request, with how many runs wait for its answer."""
    keyed = requests.withColumn("request_key", request_key(F.col("model"), F.col("schema"), F.col("prompt")))
    return keyed.groupBy("request_key").agg(F.count("*").alias("askers"), F.min("prompt").alias("prompt"))
