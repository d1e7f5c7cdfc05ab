"""robots.txt as a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, agent, kind, path): each allow, disallow and crawl-delay with the agents it is for.

    Agent lines in a row share the rules behind them; a rule with an empty path says nothing.
    """
    lines = files.select(host, F.posexplode(F.split(body, r"\r?\n")).alias("at", "line"))
    lines = lines.select(host, "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where(F.instr("line", ":") > 0)
    pairs = lines.select(host, "at", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("kind"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    per = pairs.where(F.col("kind").isin("user-agent", "allow", "disallow", "crawl-delay")).groupBy(host).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "value"))).alias("ls"))
    # the lines of one file: a fold over them keeps the agents in force
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,kind:string,path:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        agent = x["kind"] == "user-agent"
        agents = F.when(agent & a["open"], F.concat(a["agents"], F.array(F.lower(x["value"])))).when(agent, F.array(F.lower(x["value"]))).otherwise(a["agents"])
        made = F.transform(a["agents"], lambda g: F.struct(g.alias("agent"), x["kind"].alias("kind"), x["value"].alias("path")))
        return F.struct(agents.alias("agents"), agent.alias("open"), F.when(agent | (x["value"] == ""), a["out"]).otherwise(F.concat(a["out"], made)).alias("out"))

    return per.select(host, F.explode(F.aggregate("ls", start, step)["out"]).alias("r")).select(host, "r.agent", "r.kind", "r.path")


def pattern_of(path: Column) -> Column:
    """A rule's path as a regular expression: * is anything, a final $ the end."""
    quoted = F.regexp_replace(path, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")))


def allowed(urls: DataFrame, table: DataFrame, agent: str, host: str = "host", path: str = "path") -> DataFrame:
    """`urls` with `allowed`: by the longest rule that fits, of the agent's own group if it has one; allow wins a tie."""
    own = table.where(F.col("agent") == agent.lower()).select(host).distinct().withColumn("own", F.lit(True))
    t = table.join(own, host, "left").where((F.col("agent") == F.when(F.col("own"), F.lit(agent.lower())).otherwise("*")) & F.col("kind").isin("allow", "disallow"))
    mine = t.select(host, F.struct(F.length("path").alias("n"), (F.col("kind") == "allow").alias("ok"), pattern_of(F.col("path")).alias("p")).alias("r"))
    grouped = mine.groupBy(host).agg(F.collect_list("r").alias("rs"))  # as many as a robots.txt has lines
    j = urls.join(grouped, host, "left")
    best = F.array_max(F.transform(F.filter("rs", lambda r: F.regexp_like(F.col(path), r["p"])), lambda r: F.struct(r["n"], r["ok"])))
    return j.withColumn("allowed", F.coalesce(best["ok"], F.lit(True))).drop("rs")
