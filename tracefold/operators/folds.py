"""Logs of what people do, folded to the state that they leave: posts, likes, reports, decisions, introductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.slices import slices

#: Distinct open reports that hide a post by themselves.
HIDE_AT = 3
PENDING_MOST, COOL_DOWN_DAYS = 8, 30


def posts(log: DataFrame) -> DataFrame:
    """(post_id, text, status, likes, reporters) from a log of post_id, actor, action, text, at, seq.

    Actions: create, edit, delete, like, unlike, report, restore. The last text stands; a like counts while it is not taken
    back; a post with HIDE_AT different reporters since it was last restored is hidden; a deleted one stays deleted.
    """
    order = F.struct("at", "seq")
    # of each person's likes the last word counts
    taste = log.where(F.col("action").isin("like", "unlike")).groupBy("post_id", "actor").agg((F.max_by("action", order) == "like").alias("on"))
    likes = taste.groupBy("post_id").agg(F.count_if("on").alias("likes"))
    restored = log.where("action = 'restore'").groupBy("post_id").agg(F.max(order).alias("since"))
    reports = log.where("action = 'report'").join(restored, "post_id", "left").where(F.col("since").isNull() | (order > F.col("since")))
    reporters = reports.groupBy("post_id").agg(F.countDistinct("actor").alias("reporters"))
    texts = log.where(F.col("action").isin("create", "edit")).groupBy("post_id").agg(F.max_by("text", order).alias("text"))
    gone = log.where("action = 'delete'").select("post_id").distinct().withColumn("gone", F.lit(True))
    j = texts.join(likes, "post_id", "left").join(reporters, "post_id", "left").join(gone, "post_id", "left")
    status = F.when(F.col("gone"), "deleted").when(F.col("reporters") >= HIDE_AT, "hidden").otherwise("visible")
    return j.select("post_id", "text", status.alias("status"), F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("reporters", F.lit(0)).alias("reporters"))


def threads(posts_: DataFrame, thread: str, author: str, pos: str, authors: dict[str, str]) -> DataFrame:
    """(thread, turns, one count for each of `authors` (name -> value), last_turn, last_role): what each thread holds."""
    counts = [F.count_if(F.col(author) == v).alias(k) for k, v in authors.items()]
    return posts_.groupBy(thread).agg(F.count(F.lit(1)).alias("turns"), *counts, F.max(pos).alias("last_turn"), F.max_by(author, pos).alias("last_role"))


def reported(reports: DataFrame, item: list[str], reporter: str, least: int = HIDE_AT) -> DataFrame:
    """(item, reporters): what so many different people have reported."""
    return reports.groupBy(*item).agg(F.countDistinct(reporter).alias("reporters")).where(F.col("reporters") >= least)


def visible_to(rows: DataFrame, viewer: Column) -> DataFrame:
    """What somebody may see: all that is visible, and their own that is hidden."""
    return rows.where((F.col("status") == "visible") | ((F.col("status") == "hidden") & (F.col("author") == viewer)))


def decide(log: DataFrame, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """(id, status, applied, refused): the state after all decisions in order; a move that is not allowed changes nothing.

    log: id, action, at, seq. A slice of a history becomes the state and counts that it leads to from each state that there is.
    """
    states = sorted({start, *(state for state, _ in moves), *moves.values()})

    def step(ends: list, action: str | None) -> None:
        for i, (status, applied, refused) in enumerate(zip(*ends, strict=True)):
            to = moves.get((status, action))
            ends[0][i], ends[1][i], ends[2][i] = to or status, applied + (to is not None), refused + (to is None)

    first = lambda: [list(states), [0] * len(states), [0] * len(states)]
    kind = T.StructType().add("status", T.ArrayType(T.StringType())).add("applied", T.ArrayType(T.IntegerType())).add("refused", T.ArrayType(T.IntegerType()))
    parts = slices(log, "id", ["at", "seq", "action"], ["action"], first, step, kind)

    def then(a: Column, x: Column) -> Column:
        i = F.array_position(F.array(*map(F.lit, states)), a["status"]).cast("int")
        return F.struct(F.element_at(x["status"], i).alias("status"), (a["applied"] + F.element_at(x["applied"], i)).alias("applied"), (a["refused"] + F.element_at(x["refused"], i)).alias("refused"))

    begin = F.struct(F.lit(start).alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))
    return parts.select("id", F.aggregate("parts", begin, then).alias("s")).select("id", "s.*")


# The moves of a candidate.
CANDIDATE_MOVES = {
    ("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("pending", "merge"): "merged", ("rejected", "reopen"): "pending",
    ("approved", "publish"): "published", ("approved", "reject"): "rejected", ("approved", "reopen"): "pending",
}


def may_introduce(requests: DataFrame, as_of: Column) -> DataFrame:
    """(from, to, allowed, reason) for the newest request between two people.

    requests: id, from, to, status (pending, accepted or declined), at. Nobody has more than PENDING_MOST waiting; a pair in
    which one has declined rests for COOL_DOWN_DAYS.
    """
    pair = F.array_sort(F.array("from", "to"))
    r = requests.withColumn("pair", pair)
    waiting = r.where("status = 'pending'").groupBy("from").agg(F.count(F.lit(1)).alias("waiting"))
    last = r.groupBy("pair").agg(F.max_by(F.struct("from", "to", "status", "at"), F.struct("at", "id")).alias("l")).select("l.*")
    j = last.join(waiting, "from", "left")
    reason = (
        F.when(F.col("status") == "pending", "already asked")
        .when(F.col("status") == "accepted", "already introduced")
        .when(F.col("at") > as_of - F.make_dt_interval(F.lit(COOL_DOWN_DAYS)), "declined lately")
        .when(F.coalesce("waiting", F.lit(0)) >= PENDING_MOST, "too many waiting")
    )
    return j.select("from", "to", reason.isNull().alias("allowed"), reason.alias("reason"))


def saved(local: DataFrame, stored: DataFrame, most: int = 500) -> DataFrame:
    """(owner, key, at): two lists of saved things as one, each thing once with its first moment, the newest `most`."""
    one = stored.unionByName(local).groupBy("owner", "key").agg(F.min("at").alias("at"))
    w = Window.partitionBy("owner").orderBy(F.desc("at"), "key")
    return one.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
