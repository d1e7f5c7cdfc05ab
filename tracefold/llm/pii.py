"""Personal data (3): candidate gradient boosting.

Generators of high recall propose spans, which may overlap; boosted trees score each from its format and its context; a
threshold for each kind, set on held-out candidates, selects. Spans of the base kinds that pass their format test are
always redacted; the trees decide on all other candidates: local phone numbers, identity numbers, bank accounts, veiled
addresses, and card numbers inside longer runs of digits.

The trees are trained on the driver, from generated examples of fixed number; their sum becomes a SQL expression, so the
documents meet DataFrame functions only.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import boost
from tracefold.llm.common import match_spans

#: Base kinds in the order of the result contract. The guards and possessive repeats only spare a long run of letters or
#: digits from being tried at each of its places; \G allows a start right after the last match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@dataclass(frozen=True)
class Generator:
    """A kind of candidate. cheap: a condition that any text with a candidate meets."""

    kind: str
    pattern: str
    cheap: str
    base: bool = False


GENERATORS = (
    Generator("email", EMAIL, "@", True),
    Generator("ip", IP, "[0-9]", True),
    Generator("card", CARD, "[0-9]", True),
    Generator("phone", PHONE, r"\+", True),
    Generator("cardlike", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])", "[0-9]"),
    Generator("localphone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", "[0-9]"),
    Generator("idnumber", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-"),
    Generator("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Z0-9])", "[A-Z]{2}[0-9]{2}"),
    Generator("veiled", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]++)++", r"[(\[]at[)\]]"),
)
KINDS = [g.kind for g in GENERATORS]
BASE = [g.kind for g in GENERATORS if g.base]
#: Code points before and after a span that the trees see.
AROUND = 24

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """True for digits whose Luhn sum is a multiple of ten."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.when((n >= 1) & (n <= 30), F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def format_ok(kind: str, hit: Column) -> Column:
    """The format test of a base kind."""
    n = F.length(digits_of(hit))
    if kind == "ip":
        return hit.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(13, 19), luhn_ok(digits_of(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def iban_ok(hit: Column) -> Column:
    """The ISO 13616 check: the first four characters moved to the end, letters as 10 to 35, remainder 1 modulo 97."""
    s = F.regexp_replace(hit, " ", "")
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) >= 65, (a * 100 + code(i) - 55) % 97).otherwise((a * 10 + code(i) - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


#: Words that speak for personal data, and words that speak against it, in the context before a span.
FOR = r"(?i)\b(?:tel|phone|call|mobile|cell|fax|mail|contact|card|visa|iban|account|ssn|social|write|reach|whatsapp)\b"
AGAINST = r"(?i)\b(?:order|invoice|version|ver|isbn|serial|ref|part|model|page|chapter|id|no|sku|build|case|tracking)\b"


def features(text: Column, start: Column, hit: Column, kind: int) -> dict[str, Column]:
    """The features of a candidate, all numbers."""
    before = F.substring(text, F.greatest(start - AROUND + 1, F.lit(1)), F.least(start, F.lit(AROUND)))
    after = F.substring(text, start + F.length(hit) + 1, F.lit(AROUND))
    d = digits_of(hit)
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {
        "f_kind": F.lit(float(kind)),
        "f_len": num(F.length(hit)),
        "f_digits": num(F.length(d)),
        "f_letters": num(F.length(F.regexp_replace(hit, "[^A-Za-z]", ""))),
        "f_marks": num(F.length(F.regexp_replace(hit, r"[^().+\x20-]", ""))),
        "f_variety": num(F.size(F.array_distinct(F.split(d, "")))),
        "f_check": num(luhn_ok(d) if KINDS[kind] in ("card", "cardlike") else iban_ok(hit) if KINDS[kind] == "iban" else F.lit(True)),
        "f_for": num(before.rlike(FOR)),
        "f_against": num(before.rlike(AGAINST)),
        "f_glued_left": num(before.rlike(r"[A-Za-z0-9_#/$=-]$")),
        "f_glued_right": num(after.rlike(r"^[A-Za-z0-9_/%=-]")),
        "f_lead_zero": num(d.rlike("^(?:0|19|20)")),
    }


FEATURES = [
    "f_kind", "f_len", "f_digits", "f_letters", "f_marks", "f_variety", "f_check", "f_for", "f_against", "f_glued_left", "f_glued_right", "f_lead_zero",
]


def candidates(text: Column, i: int) -> Column:
    """array<struct<start,hit,f_...>>: the candidates of a generator with their features."""
    g = GENERATORS[i]
    found = F.when(text.rlike(g.cheap), match_spans(text, g.pattern))
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), s["hit"].alias("hit"), *[c.alias(n) for n, c in features(text, s["start"], s["hit"], i).items()])
    )


@dataclass(frozen=True)
class Model:
    trees: list
    a: float
    b: float
    #: The least calibrated probability that selects a candidate, by kind.
    least: dict[str, float]


#: Generated examples for each kind, half of them true; a third of all is held out for calibration and thresholds.
EXAMPLES = 160
PRECISION = 0.98


def examples(seed: int = 7, each: int = EXAMPLES) -> list[tuple[str, str, int]]:
    """(text, kind, truth): candidates of the kinds that the trees decide on, in contexts for and against."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 8)))
    words = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    good = ["tel", "call me", "phone:", "my mobile", "contact", "reach us at", "card", "account", "iban", "ssn", "write to", "fax"]
    bad = ["order", "invoice no", "version", "isbn", "serial", "ref", "part", "model", "tracking id", "build", "case no", "sku"]

    def luhn(n: int, ok: bool) -> str:
        head = r.choice("3456") + digit(n - 2)
        total = sum(int(c) if k % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(head)))
        return head + str((10 - total % 10 + (0 if ok else r.randint(1, 9))) % 10)

    def iban(ok: bool) -> str:
        head, body = r.choice(["DE", "FR", "GB", "ES"]), digit(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        return head + f"{check if ok else (check + r.randint(1, 60)) % 90 + 2:02d}" + body

    def quads(s: str, sep: str) -> str:
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    made = []
    for k in range(each):
        true = k % 2 == 0
        sep = r.choice(["", " ", "-"])
        hits = {
            "cardlike": quads(luhn(16, true), sep),
            "localphone": r.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"{digit(2)} {digit(4)} {digit(4)}"]),
            "idnumber": f"{digit(3)}-{digit(2)}-{digit(4)}",
            "iban": quads(iban(true), r.choice(["", " "])),
            "veiled": f"{word()}.{word()} {r.choice(['(at)', '[at]'])} {word()}{r.choice([' (dot) ', '[dot]', '.'])}{r.choice(['com', 'org', 'de'])}",
        }
        for kind, hit in hits.items():
            checked = kind in ("cardlike", "iban")
            context = r.choice(good if (true or checked and r.random() < 0.5) and r.random() < 0.9 else bad if not true else ["", word()])
            if kind == "veiled" and not true:
                hit = f"{word()} (at) {word()}.{word()}{word()}"
            if not true and not checked and context in good:
                context = r.choice(bad)
            glue = "" if true else r.choice(["", "", "#", "$"])
            made.append((f"{words()} {context} {glue}{hit} {words()}", kind, int(true)))
    return made


@lru_cache(maxsize=1)
def _trained(seed: int, rows: tuple) -> Model:
    data = np.array([r[2:] for r in rows], dtype=float)
    y, kinds = np.array([r[1] for r in rows], dtype=float), np.array([r[0] for r in rows])
    held = np.arange(len(rows)) % 3 == 0
    trees = boost.train(data[~held], y[~held])
    z = boost.log_odds(trees, data)
    a, b = boost.platt(z[held], y[held])
    p = 1 / (1 + np.exp(-(a * z + b)))
    least = {}
    for k in KINDS:
        mine = held & (kinds == k)
        order = np.argsort(-p[mine])
        right, score = y[mine][order], p[mine][order]
        precision = np.cumsum(right) / np.arange(1, len(right) + 1)
        fit = np.flatnonzero(precision >= PRECISION)
        # halfway between the last score that keeps the precision and the next one
        least[k] = max(0.5, float(score[fit[-1]] + (score[fit[-1] + 1] if fit[-1] + 1 < len(score) else 0)) / 2) if fit.size else 2.0
    return Model(trees, a, b, least)


def train(spark: SparkSession, seed: int = 7) -> Model:
    """The model, from `examples` run through the same generators and features as the documents."""
    rows = examples(seed)
    df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, text string, kind string, truth int")
    parts = []
    for i, g in enumerate(GENERATORS):
        if not g.base:
            got = df.where(F.col("kind") == g.kind).select("n", "kind", "truth", F.explode(candidates(F.col("text"), i)).alias("c"))
            parts.append(got.select("n", "kind", "truth", *[F.col(f"c.{f}") for f in FEATURES]))
    table = reduce(DataFrame.unionByName, parts).orderBy("n")
    return _trained(seed, tuple(tuple(r)[1:] for r in table.collect()))


def _span(s: Column, i: int, score: Column) -> Column:
    end = s["start"] + F.length(s["hit"])
    return F.struct(F.lit(i).alias("ord"), s["start"].alias("start"), end.alias("end"), F.lit(KINDS[i]).alias("kind"), s["hit"].alias("hit"), score.alias("score"))


def _valid(text: Column, i: int) -> Column:
    """The spans of a base kind."""
    g = GENERATORS[i]
    found = F.when(text.rlike(g.cheap), F.filter(match_spans(text, g.pattern), lambda s: format_ok(g.kind, s["hit"])))
    return F.transform(found, lambda s: _span(s, i, F.lit(None).cast("double")))


def _selected(candidate: Column, i: int, model: Model) -> Column:
    """The candidates of a kind that the trees select."""
    z = boost.as_sql(model.trees, [f"c.{f}" for f in FEATURES])
    scores = F.expr(f"transform(__c{i}, c -> 1D / (1D + exp(-({model.a:.6f}D * ({z}) + {model.b:.6f}D))))")
    return F.filter(F.zip_with(candidate, scores, lambda s, p: _span(s, i, p)), lambda s: s["score"] >= model.least[KINDS[i]])


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the column pii: array<struct<ord,start,end,kind,hit,score>> by kind, then start.

    Starts and ends are code points, ends exclusive; score is null for base spans, which need none. Spans of different
    kinds may overlap, but a candidate inside a base span adds nothing and goes. Null and empty texts have no spans. Each row is matched on its own text, whatever its id; other
    columns pass through (a column named pii is replaced); an empty table gives an empty table.
    """
    columns = docs.drop("pii").columns
    # names that no column of the caller has
    docs = docs.drop("pii").toDF(*[f"a{i}" for i in range(len(columns))])
    text = F.coalesce(F.col(f"a{columns.index(text_col)}"), F.lit(""))
    scored_kinds = [i for i, g in enumerate(GENERATORS) if not g.base and model.least.get(g.kind, 2.0) <= 1]
    out = docs.withColumns({f"__c{i}": candidates(text, i) for i in scored_kinds})
    spans = {f"__s{i}": _valid(text, i) for i, g in enumerate(GENERATORS) if g.base} | {f"__s{i}": _selected(F.col(f"__c{i}"), i, model) for i in scored_kinds}
    none = F.array().cast("array<struct<ord:int,start:int,end:int,kind:string,hit:string,score:double>>")
    out = out.withColumns({k: F.coalesce(c, none) for k, c in spans.items()})
    base = F.concat(*[f"__s{i}" for i, g in enumerate(GENERATORS) if g.base])
    more = F.concat(none, *[f"__s{i}" for i in scored_kinds])
    out = out.withColumn("__base", base).withColumn("__more", more)
    inside = lambda s: F.exists("__base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return out.select(*docs.columns, F.array_sort(F.concat("__base", F.filter("__more", lambda s: ~inside(s)))).alias("pii")).toDF(*columns, "pii")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with every selected span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    found = find_pii(docs, model, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(
            (-s["to"]).alias("at"),
            F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"),
        )
    )
    done = F.aggregate(spans, start, step)
    tail = F.substring(text, done["at"] + 1, F.length(text))
    return found.withColumn("redacted", F.concat(F.array_join(done["parts"], ""), tail))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document."""
    found = find_pii(docs.select("doc_id", "text"), train(docs.sparkSession))
    found = found.select("doc_id", "pii", F.filter("pii", lambda s: s["ord"] < len(BASE)).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def brute_base(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by the plain patterns of the result contract: what tests hold the operator against."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind: str, hit: str) -> bool:
        d = [int(c) for c in hit if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
        return 9 <= len(d) <= 15 if kind == "phone" else True

    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(plain[k], text or "") if ok(k, m[0])]
