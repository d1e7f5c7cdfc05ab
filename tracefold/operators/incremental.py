"""Complete reads of a source reconciled with stored rows, clocks of sources, and a work queue.

Each operator is a pure function of the stored table, the read and the moment; the streaming package runs them by micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.dates import backoff_minutes

ARCHIVE_GAP_MINUTES = 30
SUCCESS_WAIT_MINUTES = 55
EMPTY_CONFIRM_MINUTES = 10


def minutes(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def apply_read(stored: DataFrame, read: DataFrame, as_of: Column, keys: tuple[str, ...] = ("source_id", "external_id"), absence: bool = True) -> DataFrame:
    """The stored rows after a complete read, with what became of each as `action`.

    A row that is read again is updated, or reopened if it was hidden; one that is found under its address, with no match of
    its id, is adopted; a posting that is new is added; a row of a source that was read, and that is not in it, is hidden,
    and archived if it was hidden for ARCHIVE_GAP_MINUTES. Columns beside those named here come from the read where it has
    the row.

    stored: keys, url, title, status, first_seen_at, last_confirmed_at, status_changed_at, absent_reads.
    read: keys, url, title. Of postings with one id or one address the first by id counts.
    """
    source, ext = keys
    once = read.withColumn("__n", F.row_number().over(Window.partitionBy(source, "url").orderBy(ext))).where("__n = 1").drop("__n")
    once = once.dropDuplicates([source, ext]).select(F.col(source).alias("r_source"), F.col(ext).alias("r_ext"), F.col("url").alias("r_url"), F.col("title").alias("r_title"))
    mine = ["r_source", "r_ext"]
    s = stored.withColumn("__id", F.concat_ws("\x01", source, ext))
    by_id = s.join(once, (F.col(source) == F.col("r_source")) & (F.col(ext) == F.col("r_ext")), "left")
    matched = by_id.where("r_ext IS NOT NULL").withColumn("how", F.lit("id"))
    rest = by_id.where("r_ext IS NULL").drop("r_source", "r_ext", "r_url", "r_title")
    free = once.join(matched.select(mine), mine, "left_anti")
    # the second key, among what the first has left: one stored row for an address
    pick = rest.withColumn("__n", F.row_number().over(Window.partitionBy(source, "url").orderBy("__id")))
    by_url = pick.join(free, (F.col(source) == F.col("r_source")) & (F.col("url") == F.col("r_url")) & (F.col("__n") == 1), "left").drop("__n")
    by_url = by_url.withColumn("how", F.when(F.col("r_ext").isNotNull(), "url"))
    added = free.join(by_url.where("how = 'url'").select(mine), mine, "left_anti")
    was_read = read.select(source).distinct().withColumn("was_read", F.lit(True))
    both = matched.unionByName(by_url).join(was_read, source, "left")
    seen = F.col("how").isNotNull()
    gone = ~seen & F.coalesce("was_read", F.lit(False)) & F.lit(absence)
    waited = F.col("status_changed_at") + minutes(ARCHIVE_GAP_MINUTES) <= as_of
    action = (
        F.when(seen & (F.col("status") != "open"), "reopened")
        .when(F.col("how") == "url", "adopted")
        .when(seen, "updated")
        .when(gone & (F.col("status") == "open"), "hidden")
        .when(gone & (F.col("status") == "hidden") & waited, "archived")
        .otherwise("kept")
    )
    both = both.withColumn("action", action)
    changed = F.col("action").isin("reopened", "hidden", "archived")
    status = F.when(seen, "open").when(F.col("action") == "hidden", "hidden").when(F.col("action") == "archived", "archived").otherwise(F.col("status"))
    kept = both.select(
        source,
        F.coalesce("r_ext", ext).alias(ext),
        F.coalesce("r_url", "url").alias("url"),
        F.coalesce("r_title", "title").alias("title"),
        status.alias("status"),
        "first_seen_at",
        F.when(seen, as_of).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"),
        F.when(changed, as_of).otherwise(F.col("status_changed_at")).alias("status_changed_at"),
        F.when(seen, 0).when(F.col("action") == "hidden", 1).when(F.col("action") == "archived", 2).otherwise(F.col("absent_reads")).cast("int").alias("absent_reads"),
        "action",
    )
    new = added.select(
        F.col("r_source").alias(source), F.col("r_ext").alias(ext), F.col("r_url").alias("url"), F.col("r_title").alias("title"), F.lit("open").alias("status"),
        as_of.alias("first_seen_at"), as_of.alias("last_confirmed_at"), as_of.alias("status_changed_at"), F.lit(0).alias("absent_reads"), F.lit("added").alias("action"),
    )
    return kept.unionByName(new)


def note_outcomes(clocks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The clocks of sources after one outcome each.

    clocks: source_id, last_success_at, next_attempt_at, consecutive_failures, empty_reads, empty_first_at.
    outcomes: source_id, at, ok, rows, held, transient, retry_after_seconds. A success waits SUCCESS_WAIT_MINUTES, a failure
    by the ladder. A success without rows, where rows are held, counts only once EMPTY_CONFIRM_MINUTES lie between two such.
    """
    j = clocks.join(outcomes, "source_id", "full")
    empty = F.col("ok") & (F.col("rows") == 0) & (F.col("held") > 0)
    confirmed = empty & F.coalesce(F.col("empty_first_at") + minutes(EMPTY_CONFIRM_MINUTES) <= F.col("at"), F.lit(False))
    accepted = F.col("ok") & (~empty | confirmed)
    failures = F.coalesce("consecutive_failures", F.lit(0))
    failed = ~F.col("ok")
    wait = backoff_minutes(failures + 1, F.coalesce("transient", F.lit(True)), F.col("retry_after_seconds"))
    return j.select(
        "source_id",
        F.when(accepted, F.col("at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(F.col("at").isNull(), F.col("next_attempt_at"))
        .when(failed, F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), wait.cast("int")))
        .when(accepted, F.col("at") + minutes(SUCCESS_WAIT_MINUTES))
        .otherwise(F.col("at") + minutes(EMPTY_CONFIRM_MINUTES))
        .alias("next_attempt_at"),
        F.when(F.col("at").isNull(), failures).when(failed, failures + 1).otherwise(0).cast("int").alias("consecutive_failures"),
        F.when(empty & ~confirmed, F.coalesce("empty_reads", F.lit(0)) + 1).when(F.col("at").isNull() | failed, F.coalesce("empty_reads", F.lit(0))).otherwise(0).cast("int").alias("empty_reads"),
        F.when(empty & ~confirmed, F.coalesce("empty_first_at", "at")).when(F.col("at").isNull() | failed, F.col("empty_first_at")).alias("empty_first_at"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )


def needs_attention(failures: Column) -> Column:
    return failures >= 3


def winning_order(id_col: str, posted: str, first_seen: str) -> Column:
    """The least of a group wins."""
    return F.struct(F.when(F.col(posted).isNotNull(), 0).otherwise(1).alias("a"), F.coalesce(first_seen, F.lit("9999-12-31").cast("timestamp")).alias("b"), F.col(id_col).alias("c"))


def dedupe_roles(rows: DataFrame, key: list[str], source: str, id_col: str, posted: str, first_seen: str) -> DataFrame:
    """`rows` with duplicate_of: in a group of equal roles from several sources, all but the winner's own source are duplicates.

    The winner has a posting date, was seen first, and has the smallest id, in this order.
    """
    order = winning_order(id_col, posted, first_seen)
    # a source that differs from the winner's is a second one, so sources need not be counted
    best = rows.groupBy(*key).agg(F.min_by(F.struct(F.col(id_col).alias("wid"), F.col(source).alias("wsource")), order).alias("w"))
    j = rows.join(best, key)
    return j.withColumn("duplicate_of", F.when(F.col(source) != F.col("w.wsource"), F.col("w.wid"))).drop("w")


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group by `order`, without a window: each task keeps one row of a group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b")).select(*by, "__b.*")


def diff(before: DataFrame, after: DataFrame, id_col: str, compare: list[str]) -> DataFrame:
    """(id, change): added, removed, changed or same."""
    b = before.select(F.col(id_col).alias("b_id"), F.struct(*compare).alias("b"))
    a = after.select(F.col(id_col).alias("a_id"), F.struct(*compare).alias("a"))
    j = b.join(a, F.col("b_id") == F.col("a_id"), "full")
    change = F.when(F.col("b_id").isNull(), "added").when(F.col("a_id").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return j.select(F.coalesce("a_id", "b_id").alias(id_col), change.alias("change"))


def append_only_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a log that a later version no longer has as they were."""
    return before.exceptAll(after)


def streaks(log: DataFrame, by: list[str], at: str, value: str, tie: str) -> DataFrame:
    """(by, value, run_start, run_end, length): runs of one value in the order of a log."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(tie).over(w).isNotNull(), 0).otherwise(1)
    run = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = log.withColumn("__c", changed).withColumn("__run", run)
    return runs.groupBy(*by, "__run", value).agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count(F.lit(1)).alias("length")).drop("__run")


def illegal_moves(history: DataFrame, id_col: str, order: str, status: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Steps of a history that its rules do not allow."""
    before = F.lag(status).over(Window.partitionBy(id_col).orderBy(order))
    steps = history.withColumn("from_status", before).where("from_status IS NOT NULL")
    ok = F.lit(False)
    for a, bs in legal.items():
        ok = ok | ((F.col("from_status") == a) & F.col(status).isin(*bs))
    return steps.where(~ok).select(id_col, order, "from_status", F.col(status).alias("to_status"))


# The queue's limits and waits.
MAX_ATTEMPTS, LEASE_MINUTES, RETRY_MINUTES = 3, 15, (10, 60, 360)


def expire_leases(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Running tasks whose lease is over fail once: queued again after a wait, or failed for good at the last attempt."""
    over = (F.col("status") == "running") & (F.col("lease_until") <= as_of)
    attempts = F.col("attempts") + 1
    again = over & (attempts < MAX_ATTEMPTS)
    wait = F.element_at(F.array(*map(F.lit, RETRY_MINUTES)), F.least(attempts, F.lit(len(RETRY_MINUTES))).cast("int"))
    return tasks.withColumns(
        {
            "status": F.when(again, "queued").when(over, "failed").otherwise(F.col("status")),
            "not_before": F.when(again, as_of + F.make_dt_interval(F.lit(0), F.lit(0), wait)).when(over, F.lit(None)).otherwise(F.col("not_before")),
            "attempts": F.when(over, attempts).otherwise(F.col("attempts")),
            "lease_until": F.when(~over, F.col("lease_until")),
        }
    )


def claim_next(tasks: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """The next tasks: highest priority, then oldest, then smallest id."""
    ready = tasks.where((F.col("status") == "queued") & (F.col("not_before").isNull() | (F.col("not_before") <= as_of)))
    return ready.orderBy(F.desc("priority"), "created_at", "id").limit(n)


def enqueue(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """Tasks after some are asked for: one that waits for the same target takes the higher priority and all that is wanted."""
    active = tasks.where(F.col("status").isin("queued", "running"))
    one = asked.groupBy("target_id").agg(F.max("priority").alias("p"), F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("w"), F.min("created_at").alias("c"))
    merged = tasks.join(one, "target_id", "left").withColumn("__hit", F.col("status").isin("queued", "running") & F.col("p").isNotNull())
    merged = merged.withColumns({"priority": F.when(F.col("__hit"), F.greatest("priority", "p")).otherwise(F.col("priority")), "wanted": F.when(F.col("__hit"), F.array_union("wanted", "w")).otherwise(F.col("wanted"))}).select(tasks.columns)
    fresh = one.join(active, "target_id", "left_anti").select("target_id", F.col("p").alias("priority"), F.col("w").alias("wanted"), F.col("c").alias("created_at"))
    had = tasks.groupBy("target_id").agg(F.count(F.lit(1)).alias("k"))
    fresh = fresh.join(had, "target_id", "left").withColumns({"id": F.concat_ws("-", F.lit("enq"), "target_id", (F.coalesce("k", F.lit(0)) + 1).cast("string")), "status": F.lit("queued")}).drop("k")
    return merged.unionByName(fresh, allowMissingColumns=True)


def due_plan(clocks: DataFrame, as_of: Column, target: str, importance: str, base_days: str, next_at: str, limit: int) -> DataFrame:
    """(target, facets, score): what is due, one task a target, the most pressing first."""
    overdue = (F.unix_timestamp(as_of) - F.unix_timestamp(next_at)) / 86400.0
    score = F.col(importance) * 100 + F.when(F.col(next_at).isNull(), 1000.0).otherwise(F.least(overdue / F.col(base_days), F.lit(10.0)) * 50)
    due = clocks.where(F.col(next_at).isNull() | (F.col(next_at) <= as_of)).withColumn("__s", score)
    return due.groupBy(target).agg(F.count(F.lit(1)).alias("facets"), F.round(F.max("__s"), 4).alias("score")).orderBy(F.desc("score"), target).limit(limit)


