"""A discovery run: leads in order, each held against stored companies, stored candidates and the candidates that earlier
leads of the same run became. The first of equals becomes the candidate, later ones join it.

Leads of one identity form a class, and classes are compared, not leads: a company that a third of all leads speak of costs
one comparison with each of its rivals. Who comes first is settled by rounds over the pairs of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators import resolve
from tracefold.operators.graph import greedy_first
from tracefold.shared import swept

#: Columns of an identity, as `resolve` takes them.
IDENTITY = ["names", "domains", "abn", "acn", "city", "state", "address", "people"]
SHORTEST_NAME, LONGEST_NAME = 2, 80


def usable_name(name: Column, key: Column) -> Column:
    """A name of 2 to 80 characters, blanks squeezed, that leaves a key."""
    plain = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.length(plain).between(SHORTEST_NAME, LONGEST_NAME) & (F.coalesce(key, F.lit("")) != "")


def _rank(outcome: str = "outcome") -> Column:
    rank = F.lit(0)
    for o, n in resolve.RANK.items():
        rank = F.when(F.col(outcome) == o, n).otherwise(rank)
    return rank


def run(leads: DataFrame, companies: DataFrame, candidates: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(lead_id, state, target_kind, target_id, outcome, score): what becomes of each lead.

    leads: id, pos (unique, the order of the run), source_id, key, name and the columns of an identity; companies and
    candidates: id and the columns of an identity; seen: (source_id, key) of what candidates were discovered by.

    skipped: no usable name. seen: its source and key are known, or stand for an earlier lead of the run. matched: the very
    same as one stored company. attached: the very same as a candidate, stored or of this run, and not as one company; the
    best by score, stored ones and then earlier ones first among equals. review: a new candidate that resembles something.
    new: a new candidate like nothing else. Two companies that are both the very same count as likely only. A candidate is
    compared as it was when it was made: what leads add to it counts from the next run on.
    """
    usable = usable_name(F.col("name"), F.when(F.size("names") > 0, F.element_at("names", 1)["key"]))
    leads = swept(leads.withColumn("usable", F.coalesce(usable, F.lit(False))), "told")
    once = leads.where("usable").groupBy("source_id", "key").agg(F.min("pos").alias("pos"))
    if seen is not None:
        once = once.join(seen.select("source_id", "key").distinct().hint("merge"), ["source_id", "key"], "left_anti")
    fresh = leads.join(once.select("pos").hint("merge"), "pos", "left_semi")
    # the signature of an identity: all that comparisons look at; a class is known by the position of its first lead
    signed = fresh.withColumn("signature", F.sha2(F.to_json(F.struct(*IDENTITY)), 256)).select("id", "pos", "signature", *IDENTITY)
    first = F.struct("pos", F.struct("id", *IDENTITY).alias("v"))
    classes = signed.groupBy("signature").agg(F.min(first).alias("f"), F.max("pos").alias("last_pos"))
    classes = swept(classes.select("signature", F.col("f.pos").alias("class"), "last_pos", F.col("f.v.id").alias("first_id"), *[F.col(f"f.v.{c}").alias(c) for c in IDENTITY]), "classes")
    signed = swept(signed.select("id", "pos", "signature").join(classes.select("signature", "class").hint("merge"), "signature").drop("signature"), "leads")
    pos = signed.schema["pos"].dataType
    classes = classes.drop("signature").withColumn("pos", F.col("class"))
    known = companies.select(F.concat(F.lit("0"), F.col("id").cast("string")).alias("id"), *IDENTITY)
    if candidates is not None:
        known = known.unionByName(candidates.select(F.concat(F.lit("1"), F.col("id").cast("string")).alias("id"), *IDENTITY))
    asked = classes.withColumnRenamed("class", "id").select("id", *IDENTITY)
    # all that a lead may be: stored records and the classes of the run, compared in one go
    records = swept(known.unionByName(asked.withColumn("id", F.concat(F.lit("2"), F.col("id").cast("string")))), "records")
    # of the classes of the run a lead knows those before it; the last lead of a class knows most
    kind = F.expr("substr(record_id, 1, 1)")
    target = F.when(kind == "2", F.expr("substr(record_id, 2)").try_cast(pos))
    ends = classes.select(F.col("class").alias("lead_id"), "last_pos").hint("merge")
    before = (kind != "2") | (target == F.col("lead_id")) | (target < F.col("last_pos"))
    pairs = swept(resolve.pairs(asked, records), "pairs").join(ends, "lead_id").where(before).drop("last_pos")
    every = resolve.compare(pairs, asked, records)
    every = swept(every.select(F.col("lead_id").alias("class"), F.col("record_id").substr(1, 1).alias("kind"), F.expr("substr(record_id, 2)").alias("target"), "outcome", "score"), "compared")
    stored = every.where("kind <> '2'")
    exact_companies = stored.where("kind = '0' AND outcome = 'EXACT_MATCH'").groupBy("class").agg(F.count(F.lit(1)).alias("claims"))
    stored = stored.join(exact_companies.hint("merge"), "class", "left")
    twice = (F.col("kind") == "0") & (F.col("outcome") == "EXACT_MATCH") & (F.col("claims") > 1)
    stored = swept(stored.withColumn("outcome", F.when(twice, "LIKELY_MATCH").otherwise(F.col("outcome"))).drop("claims"), "stored")
    matched = stored.where("kind = '0' AND outcome = 'EXACT_MATCH'").select("class").distinct()
    joined = stored.where("kind = '1' AND outcome = 'EXACT_MATCH'").select("class").distinct().join(matched.hint("merge"), "class", "left_anti")

    among = every.where("kind = '2'").select("class", F.col("target").try_cast(pos).alias("other"), "outcome", "score")
    same = among.where("outcome = 'EXACT_MATCH' AND other < class")
    # what matches a company is a candidate whatever comes before it; what matches a stored candidate never is one
    rivals = same.select(F.col("class").alias("late"), F.col("other").alias("early")).join(matched.withColumnRenamed("class", "late").hint("merge"), "late", "left_anti")
    for end in ("late", "early"):
        rivals = rivals.join(joined.withColumnRenamed("class", end).hint("merge"), end, "left_anti")
    never = swept(greedy_first(rivals).withColumnRenamed("id", "class").unionByName(joined), "never")

    alone = among.where("outcome = 'EXACT_MATCH' AND class = other").select("class").join(matched.hint("merge"), "class", "left_anti")
    # of a class that is the very same as itself only the first lead can be a candidate
    j = signed
    for name, table in (("is_matched", matched), ("is_never", never), ("is_alone", alone)):
        j = j.join(table.distinct().withColumn(name, F.lit(True)).hint("merge"), "class", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    attached = ~is_(F.col("is_matched")) & (is_(F.col("is_never")) | (is_(F.col("is_alone")) & (F.col("pos") > F.col("class"))))
    j = swept(j.select("id", "pos", "class", is_(F.col("is_matched")).alias("is_matched"), attached.alias("attached")), "states")

    roots = classes.join(never.hint("merge"), "class", "left_anti").select(F.col("class").alias("other"), F.col("first_id").cast("string").alias("target"))
    in_run = j.join(among.hint("merge"), "class").where("other < pos").join(roots.hint("merge"), "other").select("id", "attached", "is_matched", F.lit("2").alias("kind"), "target", F.col("other").alias("other_pos"), "outcome", "score")
    with_stored = j.join(stored.hint("merge"), "class").select("id", "attached", "is_matched", "kind", "target", F.lit(-1).cast(pos).alias("other_pos"), "outcome", "score")
    both = with_stored.unionByName(in_run).where("NOT attached OR outcome = 'EXACT_MATCH' AND kind <> '0'")
    company_first = F.when(F.col("kind") == "0", 1).otherwise(0)
    # the best: outcome, companies first, score, stored before this run, the earlier, the smaller id
    best = both.groupBy("id").agg(F.min_by(F.struct("kind", "target", "outcome", "score"), F.struct((-_rank()).alias("a"), (-company_first).alias("b"), (-F.col("score")).alias("c"), F.col("other_pos").alias("d"), F.col("target").alias("e"))).alias("best"))
    settled = j.join(best.hint("merge"), "id", "left")
    state = F.when(F.col("attached"), "attached").when(F.col("is_matched"), "matched").when(F.col("best").isNotNull(), "review").otherwise("new")
    kind = F.when(F.col("best.kind") == "0", "company").when(F.col("best.kind").isNotNull(), "candidate")
    settled = settled.select("id", "pos", state.alias("state"), kind.alias("target_kind"), F.col("best.target").alias("target_id"), F.col("best.outcome").alias("outcome"), F.col("best.score").alias("score"))
    out = leads.select("id", "pos", "usable").join(settled.drop("id").hint("merge"), "pos", "left")
    state = F.when(~F.col("usable"), "skipped").when(F.col("state").isNull(), "seen").otherwise(F.col("state"))
    return out.select(F.col("id").alias("lead_id"), state.alias("state"), "target_kind", "target_id", "outcome", "score")
