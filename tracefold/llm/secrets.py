"""Secret scans (1): a trigram inverted index in front of the regexes.

Each rule's regex yields a Boolean query over the trigrams that any of its matches must hold. The index keeps, for the
trigrams that some rule asks for, which documents hold them; intersecting and uniting these postings gives the candidates
of each rule, and only those are matched against its regex. A rule without a mandatory trigram scans every text.

Only DataFrame functions touch the documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import match_spans, scratch

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret. value_group: the group whose length counts, 0 for the whole match; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    value_group: int = 0


#: The rules of the result contract, in its order.
BASE_RULES = (Rule("assign", ASSIGN, 12, 2), Rule("access", r"AKIA[A-Z0-9]+", 18), Rule("hex", r"[0-9a-f]{16,}", 16))
#: Rules that add spans: public token formats with a fixed mark.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple
#: Exact string sets beyond this size are turned into a query instead of being multiplied further.
MOST_EXACT = 48


def _join(kind: str, parts: list[Query]) -> Query:
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and True in flat:
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    if kind == "or":  # a & b & c adds nothing beside a & b
        sets = {p: frozenset([p] if isinstance(p, str) else p[1]) for p in flat if isinstance(p, str) or p[0] == "and"}
        flat = [p for p in flat if p not in sets or not any(sets[q] < sets[p] for q in sets)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _holds(text: str) -> Query:
    """What a document that holds `text` must hold."""
    return _join("and", [text[i : i + 3] for i in range(len(text) - 2)])


def _chars(items: list) -> set[str] | None:
    """The characters of a small class, lower-cased; None for a large or negated one."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The exact set of lower-cased strings that a pattern matches, if small, else None with a query that its matches meet."""
    exact: set[str] = {""}
    broken, query = False, []

    def flush() -> None:
        nonlocal exact, broken
        query.append(_join("or", [_holds(x) for x in sorted(exact)]))
        exact, broken = {""}, True

    for kind, value in tree:
        own: set[str] | None = None
        own_query: Query = True
        if kind is op.LITERAL:
            own = {chr(value).lower()}
        elif kind is op.IN:
            own = _chars(value)
        elif kind is op.SUBPATTERN:
            own, own_query = _walk(value[-1])
        elif kind is op.BRANCH:
            parts = [_walk(b) for b in value[1]]
            if all(e is not None for e, _ in parts):
                own = set().union(*(e for e, _ in parts))
            own_query = _join("or", [q if e is None else _join("or", [_holds(x) for x in sorted(e)]) for e, q in parts])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            part, part_query = _walk(body)
            if part is not None and most == 1:
                own = part | {""} if least == 0 else part
            elif part is not None and least == most and len(part) ** int(least) <= MOST_EXACT:
                own = {"".join(x) for x in product(sorted(part), repeat=int(least))}
            elif least:
                own_query = part_query if part is None else _join("or", [_holds(x) for x in sorted(part)])
        elif kind is op.AT:
            continue
        if own is not None and len(exact) * len(own) <= MOST_EXACT:
            exact = {a + b for a in exact for b in own}
        elif own is not None and len(own) <= MOST_EXACT:
            flush()
            exact = own
        else:
            flush()
            query.append(own_query)
    if not broken:
        return exact, True
    flush()
    return None, _join("and", query)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match of `pattern` meets; True if there is none."""
    exact, query = _walk(regex_parser.parse(pattern))
    return query if exact is None else _join("or", [_holds(x) for x in sorted(exact)])


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _met(query: Query, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_met(q, have) for q in query[1]])


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc), sorted by trigram and document, written to the shared folder.

    The salt deals a trigram that many documents hold to many tasks.
    """
    low = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col)).alias("low")).where(F.col("low").isNotNull())
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select(F.explode(held).alias("trigram"), "doc")
    path = scratch(docs.sparkSession, "trigrams")
    postings.repartition("trigram", F.pmod(F.xxhash64("doc"), F.lit(32))).sortWithinPartitions("trigram", "doc").write.parquet(path)
    return docs.sparkSession.read.schema(postings.schema).parquet(path)


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc, rules): for each document that meets the query of some rule, these rules."""
    needed = sorted(set().union(*map(trigrams_of, queries.values())))
    have = postings.where(F.col("trigram").isin(needed)).groupBy("doc").agg(F.collect_set("trigram").alias("have"))
    rules = F.array_compact(F.array(*[F.when(_met(q, F.col("have")), F.lit(k)) for k, q in queries.items()]))
    return have.select("doc", rules.alias("rules")).where(F.size("rules") > 0)


def spans_of(rule: Rule, text: Column, order: int) -> Column:
    """array<struct<start, ord, kind, end, hit>> of a rule's matches that are long enough."""
    found = match_spans(text, rule.pattern)
    width = lambda s: F.length(F.regexp_extract(s["hit"], rule.pattern, rule.value_group) if rule.value_group else s["hit"])
    return F.transform(
        F.filter(found, lambda s: width(s) >= rule.least),
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (s["start"] + F.length(s["hit"])).alias("end"), s["hit"].alias("hit")),
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the column secrets: array<struct<start,ord,kind,end,hit>> by start, then rule order.

    Starts and ends are code points, ends exclusive. Null and empty texts have no spans. Rows that share an id share
    candidates, and each is matched on its own text; a null id counts as an id. Other columns pass through (a column named
    secrets is replaced); an empty table gives an empty table.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    columns = docs.drop("secrets").columns
    # names that no column of the caller has
    docs = docs.drop("secrets").toDF(*[f"c{i}" for i in range(len(columns))])
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    if indexed:
        postings = build_index(docs, sorted(set().union(*map(trigrams_of, indexed.values()))), id_col, text_col)
        cand = candidates(postings, indexed).toDF("__doc", "__rules").hint("shuffle_hash")
        own = docs.join(cand, docs[id_col].eqNullSafe(cand["__doc"]), "left").drop("__doc")
    else:
        own = docs.withColumn("__rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,hit:string>>")
    cols = {}
    for i, r in enumerate(rules):
        spans = spans_of(r, text, i)
        if r.kind in indexed:
            spans = F.when(F.array_contains("__rules", r.kind), spans)
        else:
            spans = F.when(text.rlike(r.pattern), spans)
        cols[f"__s{i}"] = F.coalesce(spans, none)
    own = own.withColumns(cols)
    return own.select(*docs.columns, F.array_sort(F.concat(*cols)).alias("secrets")).toDF(*columns, "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE_RULES))
    found = found.select("doc_id", "secrets", base.alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


def brute_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, int]]:
    """(start, kind, end) by scanning a text with every rule: what tests hold the operator against."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.value_group]) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]
