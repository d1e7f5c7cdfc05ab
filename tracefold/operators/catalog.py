"""The read side of a directory: select, order, page, facets, summary, areas, suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.names import tight

#: The shortest query that is also compared without spacing and punctuation.
TIGHT_LEAST = 5

# Funding stages from early to late; unknown labels come after them, no label last.
STAGES = (
    "Pre-seed", "Seed", "Early", "Series A", "Series B", "Series B+", "Series C", "Series C+",
    "Series D", "Series D+", "Series E", "Growth", "Unicorn", "Acquired", "Subsidiary", "Other Equity",
)
# Sizes of teams.
TEAM_SIZES = (("1-9", 1, 9), ("10-29", 10, 29), ("30-99", 30, 99), ("100plus", 100, None))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class Fields:
    """How a table's columns play the parts that filters know. None: the table has no such part."""

    name: str = "name"
    sector: str | None = None
    sector_group: str | None = None
    city: str | None = None
    metro: str | None = None
    search: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)
    member: dict[str, str] = field(default_factory=dict)
    flag: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Filters:
    """A set of conditions, all of which hold; the values of one are alternatives. Empty: no condition.

    equal: a column's value is one of these. member: an array column holds one of these. flag: yes or no, anything else is
    no condition. sector and city match the own label or the wider one (the group, the metropolitan area).
    """

    search: str = ""
    sector: tuple[str, ...] = ()
    city: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    equal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    member: dict[str, tuple[str, ...]] = field(default_factory=dict)
    flag: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, query: dict[str, str | list[str]], fields: Fields) -> Filters:
        """From a query string's keys: repeated values are joined by commas, but names stay a list."""
        text = {k: ",".join(v) if isinstance(v, list) else v for k, v in query.items() if k != "name"}
        split = lambda k: tuple(x for x in text.get(k, "").split(",") if x)
        names = query.get("name", [])
        return cls(
            search=text.get("search", ""),
            sector=split("sector"),
            city=split("city"),
            names=tuple(names if isinstance(names, list) else [names]),
            equal={k: split(k) for k in fields.equal if split(k)},
            member={k: split(k) for k in fields.member if split(k)},
            flag={k: text[k] for k in fields.flag if text.get(k) in ("yes", "no")},
        )


def condition(f: Filters, t: Fields) -> Column:
    """The filters as one expression, so that what can be pushed to the scan is pushed."""
    out = []
    if f.search:
        # one haystack with a line for each field; a query never spans two
        q = f.search.lower().replace("\n", " ")
        hay = F.lower(F.concat_ws("\n", *[F.col(c) for c in (t.search or (t.name,))]))
        hit = F.contains(hay, F.lit(q))
        squeezed = "".join(c for c in q if c.isascii() and c.isalnum())
        out.append(hit | F.contains(tight(F.col(t.name)), F.lit(squeezed)) if len(squeezed) >= TIGHT_LEAST else hit)
    for values, own, wide in ((f.sector, t.sector, t.sector_group), (f.city, t.city, t.metro)):
        if values:
            out.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c in (own, wide) if c]))
    if f.names:
        out.append(F.col(t.name).isin(*f.names))
    out += [F.col(t.equal[k]).isin(*v) for k, v in f.equal.items() if v]
    out += [F.arrays_overlap(F.col(t.member[k]), F.array(*map(F.lit, v))) for k, v in f.member.items() if v]
    out += [F.coalesce(F.col(t.flag[k]), F.lit(False)) == F.lit(v == "yes") for k, v in f.flag.items() if v in ("yes", "no")]
    return all_of(out)


def select(rows: DataFrame, f: Filters, t: Fields) -> DataFrame:
    return rows.where(condition(f, t))


def batch_counts(rows: DataFrame, sets: dict[str, Filters], t: Fields) -> DataFrame:
    """(set, count) for many filter sets in one pass over the table."""
    counted = rows.agg(*[F.count_if(F.coalesce(condition(f, t), F.lit(False))).alias(k) for k, f in sets.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("set"), F.col(k).alias("count")) for k in sets])).alias("r")).select("r.*")


def explain_selection(rows: DataFrame, f: Filters, t: Fields) -> DataFrame:
    """(examined, matched): rows of the table, and rows that the filters keep."""
    return rows.agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.coalesce(condition(f, t), F.lit(False))).alias("matched"))


def stage_rank(stage: Column) -> Column:
    """The place of a stage, unknown labels after all known ones, none or 'Unknown' last."""
    known = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return F.when(stage.isNull() | (stage == "Unknown"), len(STAGES) + 1).when(known == 0, len(STAGES)).otherwise(known - 1).cast("int")


def team_bucket(size: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, low, high in reversed(TEAM_SIZES):
        out = F.when((size >= low) & (size <= high) if high else size >= low, code).otherwise(out)
    return out


def order_by(rows: DataFrame, keys: list[Column], name: str, pos: str) -> DataFrame:
    """Rows by some keys, then by name as people sort it, then by their place in the file."""
    return rows.orderBy(*keys, F.collate(F.col(name), "UNICODE"), pos)


def page(ordered: DataFrame, offset: int, limit: int) -> DataFrame:
    return ordered.offset(offset).limit(limit)


def page_after(rows: DataFrame, key: str, id_col: str, after: tuple | None, limit: int) -> DataFrame:
    """The next page by (key, id), after a row: no earlier row is read past."""
    if after:
        k, i = after
        rows = rows.where((F.col(key) > F.lit(k)) | ((F.col(key) == F.lit(k)) & (F.col(id_col) > F.lit(i))))
    return rows.orderBy(key, id_col).limit(limit)


def facets(rows: DataFrame, columns: dict[str, str], top: int = 100) -> DataFrame:
    """(facet, value, count, distinct) for several columns in one pass; array columns count each member.

    Values of a facet by count, then value; null and empty values do not count.
    """
    kinds = dict(rows.dtypes)
    as_array = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    each = F.array(*[F.struct(F.lit(name).alias("facet"), as_array(c).alias("values")) for name, c in columns.items()])
    flat = rows.select(F.explode(each).alias("f")).select("f.facet", F.explode("f.values").alias("value")).where("value IS NOT NULL AND value <> ''")
    counts = flat.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    by = Window.partitionBy("facet")
    ranked = counts.withColumn("distinct", F.count(F.lit(1)).over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), "value")))
    return ranked.where(F.col("rank") <= top).drop("rank")


def summary(rows: DataFrame, flags: dict[str, Column], distinct: dict[str, str], newest: dict[str, str]) -> DataFrame:
    """One row: the rows, those of each flag, the distinct values (members of array columns too) and the newest values."""
    kinds = dict(rows.dtypes)
    out = [F.count(F.lit(1)).alias("count")]
    out += [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()]
    out += [F.max(c).alias(k) for k, c in newest.items()]
    out += [F.countDistinct(c).alias(k) for k, c in distinct.items() if not kinds[c].startswith("array")]
    parts = [rows.agg(*out)]
    # members are counted by a shuffle of their own, and the single rows put together
    parts += [rows.select(F.explode(c).alias("m")).agg(F.countDistinct("m").alias(k)) for k, c in distinct.items() if kinds[c].startswith("array")]
    if len(parts) == 1:
        return parts[0]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def facet_sets(rows: DataFrame, columns: list[str], marked: str) -> DataFrame:
    """Counts of each column's values, one grouping set a column, in one pass; `marked` has the grouping flag of the first column."""
    return rows.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("count"), F.grouping(columns[0]).cast("long").alias(marked))


def vocabulary(rows: DataFrame, ranges: dict[str, tuple[str, str]], counted: dict[str, str], listed: dict[str, str]) -> DataFrame:
    """One row of what a filter panel offers: least and most of some columns, how many values others have, and the values of closed vocabularies in order.

    ranges: column -> names of its least and most; counted and listed: name -> column. Only columns of few values are to be listed.
    """
    out = [f(c).alias(n) for c, names in ranges.items() for f, n in zip((F.min, F.max), names, strict=True)]
    out += [F.countDistinct(c).alias(k) for k, c in counted.items()]
    out += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(k) for k, c in listed.items()]
    return rows.agg(*out)


def areas(rows: DataFrame, keys: list[str], name: str, id_col: str, sample: int = 12) -> DataFrame:
    """Rows of each area with a sample of the first by lower-cased name.

    The sample is ranked before it is collected, so that a large area holds no more than a small one.
    """
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, F.lower(name).alias("__k"), name, id_col).withColumn("__n", F.row_number().over(w.orderBy("__k", id_col)))
    first = ranked.where(F.col("__n") <= sample).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", name))), lambda s: s[name]).alias("sample"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).join(first, keys)


def suggest(rows: DataFrame, text: str, name: str, id_col: str, limit: int = 5) -> DataFrame:
    """Names for what somebody types: those that start so, then at a word, then anywhere, then without spacing."""
    q = text.strip().lower()
    low = F.lower(F.col(name))
    squeezed = "".join(c for c in q if c.isascii() and c.isalnum())
    tier = F.when(low.startswith(q), 0).when(F.contains(low, F.lit(" " + q)), 1).when(F.contains(low, F.lit(q)), 2)
    if len(squeezed) >= TIGHT_LEAST:
        tier = tier.when(F.contains(tight(F.col(name)), F.lit(squeezed)), 3)
    # the first tier is in order of name, the others in order of the file
    found = rows.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(q != ""))
    return found.orderBy("tier", F.when(F.col("tier") == 0, low), id_col).limit(limit).select(id_col, name, "tier")


def pin_stacks(rows: DataFrame, lat: str, lng: str, top: int = 5) -> DataFrame:
    """Points that several rows share, the fullest first."""
    return rows.where(F.col(lat).isNotNull()).groupBy(lat, lng).agg(F.count(F.lit(1)).alias("count")).where("count > 1").orderBy(F.desc("count"), lat, lng).limit(top)


def csv_cell(c: Column) -> Column:
    """A cell of a CSV export: quoted where it must be, and no spreadsheet takes it for a formula."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(rows: DataFrame, columns: dict[str, Column], keys: list[str]) -> DataFrame:
    """`keys` and the line of each row in a CSV export."""
    return rows.select(*keys, F.concat_ws(",", *[csv_cell(c) for c in columns.values()]).alias("line"))
