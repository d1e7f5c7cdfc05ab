"""What the pages of a site say of the company behind it: structured data, numbers and names in running text, and of all that
the strongest reading of each value."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import names as N
from tracefold.functions import pages as P
from tracefold.functions.addresses import SHORT_FORMS, STATES, STREET_TYPES
from tracefold.functions.registry_numbers import digits, is_abn, is_acn

# Types of nodes that stand for the organisation itself.
ORGANISATIONS = ("organization", "corporation", "localbusiness", "ngo", "softwareapplication", "brand")
# Words that label a contact block and so are no part of a company's name.
LABELS = (
    "privacy", "officer", "contact", "director", "manager", "email", "phone", "fax", "attention", "address", "terms", "policy", "copyright",
    "rights", "reserved", "registered", "trading", "operated", "owned", "welcome", "about",
)
# What a page says that does not show its own content, and titles that name a kind of page.
GATE = (
    r"(?i)\b(?:unsupported (?:client|browser)|enable javascript|javascript is (?:disabled|required)|access denied|attention required|just a moment|"
    r"checking your browser|request blocked|you have been blocked|page not found|404 not found|403 forbidden|under construction|coming soon|"
    r"domain (?:is )?for sale|this domain (?:is|may be))\b"
)
KIND_OF_PAGE = r"(?i)^(?:home|homepage|welcome|index|untitled|official (?:web)?site|main page|log ?in|sign ?in|dashboard)\b"

_LABEL = "|".join(LABELS)
_NAME = rf"(?!(?i:{_LABEL})\b)(?:[A-Z]|\d+[A-Za-z])[\w&'’-]*(?:\.[\w&'’-]+)*"
LEGAL_NAME = rf"({_NAME}(?:\s+(?:{_NAME}|of|and|the|for|&)){{0,6}})\s+(Pty\.?\s+Ltd|Pty\.?\s+Limited|Proprietary\s+Limited)(?![A-Za-z])"
_STREETS = "|".join(sorted({w.capitalize() for w in (*STREET_TYPES, *SHORT_FORMS)}))
ADDRESS = (
    rf"\b(\d{{1,5}}[A-Za-z]?(?:\.\d{{1,4}})?(?:\s?[-–/]\s?\d{{1,5}})?\s+[A-Z][A-Za-z'’.-]*(?:\s+[A-Za-z'’.-]+){{0,3}}?\s+(?:{_STREETS})\b)"
    rf"\.?,?(\s+[A-Za-z'’ .-]{{2,40}}?)?,?\s+({'|'.join(STATES)})\s+(\d{{4}})\b"
)
FOUNDED = r"(?i)\b(?:founded|established|est\.?)\s+(?:in\s+)?((?:19|20)\d{2})\b"
_PART = r"[A-Z](?:[a-z]+|['’][A-Z][a-z]+)(?:['’-][A-Z]?[a-z]+)*"
_PERSON = rf"(?:(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Sir|Dame)\.?\s+)?{_PART}(?:\s+{_PART}){{1,2}}"
_TITLE = r"(?:,?\s*(?:CEO|CTO|COO|CFO|CPO|[Cc]o-?[Ff]ounder|[Ff]ounder))?"
_AND = r"\s*(?:,\s*(?:and\b|&)|,|\band\b|&)\s*"
FOUNDED_BY = rf"\b(?:[Cc]o-?[Ff]ounded|[Ff]ounded|[Ss]tarted)\s+by\s+({_PERSON}{_TITLE}(?:{_AND}{_PERSON}{_TITLE})*)"
NO_PERSON = r"(?i)\b(?:capital|ventures?|group|holdings|labs?|pty|ltd|limited|inc|university|institute|foundation|partners|studio|studios|sourcing)\b"
# Words that a run of capitals may run on into.
NO_SURNAME = (
    "One", "The", "This", "Our", "We", "They", "He", "She", "It", "In", "At", "On", "Since", "After", "And", "But", "With", "As", "From", "Who", "Is",
    "Was", "To", "For", "Of", "By", "An", "Today", "Now", "Co",
)


def nodes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, pos, node): the JSON-LD objects of each page in order, lists and graphs opened however deep they lie.

    One pass opens P.LEVELS levels of all pages; another follows only while some page has deeper ones.
    """
    t = pages.select(F.col(page).alias("page"), P.opened(P.ld_blocks(F.col(html))).alias("nodes"))
    deep = t.where(P.still_closed(F.col("nodes")))
    while not deep.isEmpty():
        t = t.withColumn("nodes", P.opened(F.col("nodes")))
        deep = t.where(P.still_closed(F.col("nodes")))
    return t.select("page", F.posexplode(F.filter("nodes", P.is_object)).alias("pos", "node"))


def types(node: Column) -> Column:
    """array<string>: the @type of a node, one or a list."""
    many = F.try_variant_get(node, "$['@type']", "array<string>")
    one = F.try_variant_get(node, "$['@type']", "string")
    return F.transform(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), F.lower)


def each(node: Column, key: str) -> Column:
    """array<variant>: what a node says under a key, one value or a list."""
    v = F.try_variant_get(node, f"$.{key}", "variant")
    return F.coalesce(F.try_variant_get(node, f"$.{key}", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def _text(v: Column, path: str = "$") -> Column:
    """A string that says something; numbers, objects and blanks are none."""
    s = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.when(F.trim(s) != "", s)


def _either(v: Column, key: str) -> Column:
    """A string, or the `key` of an object."""
    return F.coalesce(_text(v), _text(v, f"$.{key}"))


def organisation_facts(found: DataFrame) -> DataFrame:
    """(page, field, value, confidence, pos): what the nodes (page, pos, node) that stand for an organisation state.

    The first description, founding year and address of a page count; names and founders all do.
    """
    n = F.col("node")
    orgs = found.where(F.arrays_overlap(types(n), F.array(*map(F.lit, ORGANISATIONS))))
    place = F.get(F.filter(each(n, "address"), P.is_object), F.lit(0))
    part = lambda k: _text(place, f"$.{k}")
    country = F.coalesce(_either(F.try_variant_get(place, "$.addressCountry", "variant"), "name"), F.lit("AU"))
    postcode = F.trim(F.try_variant_get(place, "$.postalCode", "string"))
    local = country.rlike("(?i)^(?:au|aus|australia)$") & F.coalesce(part("addressRegion"), F.lit("")).isin(*STATES) & postcode.rlike(r"^\d{4}$")
    address = F.when(local, F.trim(F.concat_ws(" ", F.concat_ws(", ", part("streetAddress"), part("addressLocality")), part("addressRegion"), postcode)))
    year = F.regexp_extract(F.coalesce(F.try_variant_get(n, "$.foundingDate", "string"), F.lit("")), r"\b((?:19|20)\d{2})\b", 1)
    people = F.filter(F.transform(F.concat(each(n, "founder"), F.when(F.size(each(n, "founder")) == 0, each(n, "founders")).otherwise(F.array().cast("array<variant>"))), lambda v: F.trim(_either(v, "name"))), lambda s: s.rlike(r"\S\s+\S"))
    row = lambda field, value, confidence, once: F.transform(value, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(confidence).alias("confidence"), F.lit(once).alias("once")))
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    rows = F.concat(
        row("name", F.filter(F.transform(F.concat(each(n, "name"), each(n, "alternateName")), lambda v: F.trim(_text(v))), lambda s: s.isNotNull()), "high", False),
        row("legal_name", some(_text(n, "$.legalName")), "high", False),
        row("description", some(_text(n, "$.description")), "medium", True),
        row("founded_year", some(F.when(year != "", year)), "high", True),
        row("founders", people, "medium", False),
        row("address", some(address), "high", True),
        row("state", some(F.when(local, part("addressRegion"))), "high", True),
    )
    out = orgs.select("page", "pos", F.posexplode(rows).alias("k", "r")).select("page", "pos", "k", "r.*")
    many = out.where("NOT once").select("page", "field", "value", "confidence", F.struct("pos", "k").alias("at"))
    one = out.where("once").groupBy("page", "field").agg(F.min_by(F.struct("value", "confidence", F.struct("pos", "k").alias("at")), F.struct("pos", "k")).alias("r"))
    return many.unionByName(one.select("page", "field", "r.*")).select("page", "field", "value", "confidence", F.col("at.pos").alias("pos"))


def text_facts(pages: DataFrame, page: str = "page_id", html: str = "html", fields: Collection[str] | None = None) -> DataFrame:
    """(page, field, value, confidence, pos): what stands in running text: registry numbers that check, legal names, addresses, a founding year, founders.

    fields: those that are asked for (None: all); nothing else is sought in the text.
    """
    body = F.regexp_extract(F.col(html), r"(?is)<body\b[^>]*>(.*)</body>", 1)
    t = pages.select(F.col(page).alias("page"), P.strip_tags(F.when(body != "", body).otherwise(F.regexp_replace(F.col(html), r"(?is)<head\b.*?</head>", " "))).alias("t"))
    x = F.col("t")
    hits = lambda pattern, g=0: F.regexp_extract_all(x, F.lit(pattern), F.lit(g))
    numbers = lambda word, n, ok: F.filter(F.transform(hits(rf"(?i)\b{word}[\s:.-]*((?:\d\s?){{{n}}})(?!\d)", 1), digits), ok)
    form = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"Pty\. ?", "Pty "), r"Ltd\.$", "Ltd")
    legal = F.filter(F.transform(hits(LEGAL_NAME), form), lambda s: F.length(s) <= 80)
    lines = F.transform(hits(ADDRESS), lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\s*,?\s+((?:" + "|".join(STATES) + r") \d{4})$", " $1"))
    spoken = F.flatten(F.transform(hits(FOUNDED_BY, 1), lambda s: F.split(s, r"\s*(?:,|\band\b|&)\s*")))
    person = lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.trim(s), r"^(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Sir|Dame)\.?\s+", "")), rf"^(\S+\s+\S+(?:\s+\S+)*?)(?:\s+(?:{'|'.join(NO_SURNAME)}))+$", "$1")
    people = F.filter(F.transform(spoken, person), lambda s: s.rlike(r"^\S+\s+\S+") & ~s.rlike(NO_PERSON))
    year = F.regexp_extract(x, FOUNDED, 1)
    kinds = {
        "abn": (numbers("ABN", 11, is_abn), "medium"), "acn": (numbers("ACN", 9, is_acn), "medium"), "legal_name": (legal, "medium"),
        "address": (F.slice(lines, 1, 1), "medium"), "state": (F.transform(F.slice(lines, 1, 1), lambda s: F.regexp_extract(s, r"(\w+) \d{4}$", 1)), "medium"),
        "founded_year": (F.filter(F.array(year), lambda y: y != ""), "medium"), "founders": (people, "medium"),
    }
    row = lambda f, v, c: F.transform(F.array_distinct(v), lambda y: F.struct(F.lit(f).alias("field"), y.alias("value"), F.lit(c).alias("confidence")))
    asked = [row(f, v, c) for f, (v, c) in kinds.items() if fields is None or f in fields]
    rows = F.concat(*asked) if asked else F.slice(row("", F.array(F.lit("")), ""), 1, 0)
    return t.select("page", F.posexplode(rows).alias("pos", "r")).select("page", "r.field", "r.value", "r.confidence", (F.col("pos") + 1_000_000).alias("pos"))


def site_names(pages: DataFrame, page: str = "page_id", html: str = "html", fields: Collection[str] | None = None) -> DataFrame:
    """(page, field, value, confidence, pos): og:site_name, the description of the page, and the head of its title; of these `fields`, if given."""
    h = F.col(html)
    title = P.title(h)
    said = {"site_name": P.meta(h, "og:site_name"), "description": F.coalesce(P.meta(h, "description"), P.meta(h, "og:description")), "title": title}
    row = lambda f, v: F.struct(F.lit(f).alias("field"), P.redact_contacts(v).alias("value"))
    asked = [row(f, v) for f, v in said.items() if fields is None or f in fields]
    rows = F.array(*asked) if asked else F.slice(F.array(row("", F.lit(""))), 1, 0)
    return pages.select(F.col(page).alias("page"), F.posexplode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("pos", "r")).select("page", "r.field", "r.value", F.lit("medium").alias("confidence"), (F.col("pos") + 2_000_000).alias("pos"))


def page_facts(pages: DataFrame, page: str = "page_id", html: str = "html", fields: Collection[str] | None = None) -> DataFrame:
    """(page, field, value, confidence, pos): all that each page states, structured data before text.

    fields: those that are asked for (None: all). A filter on the result would come after every pattern has been sought.
    """
    stated = organisation_facts(nodes(pages, page, html))
    if fields is not None:
        stated = stated.where(F.col("field").isin(*fields))
    return reduce(DataFrame.unionByName, [stated, text_facts(pages, page, html, fields), site_names(pages, page, html, fields)])


RANK = {"high": 3, "medium": 2, "low": 1}


def strongest(facts: DataFrame, subject: list[str], order: list[str]) -> DataFrame:
    """One row for each (subject, field, value): the reading of most confidence, the first in `order` among equals, and how many pages say it."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence")), F.lit(0))
    best = F.min_by(F.struct("confidence", *order), F.struct((-rank).alias("__r"), *order))
    return facts.groupBy(*subject, "field", "value").agg(best.alias("__b"), F.countDistinct("page").alias("pages")).select(*subject, "field", "value", "__b.*", "pages")


def looks_like_name(s: Column) -> Column:
    """Four words at most, a capital or digit first, no comma, colon or semicolon, and not a kind of page."""
    return F.coalesce((F.size(F.split(F.trim(s), r"\s+")) <= 4) & ~s.rlike("[,:;]") & F.trim(s).rlike("^[A-Z0-9]") & ~F.trim(s).rlike(KIND_OF_PAGE), F.lit(False))


def names_alike(a: Column, b: Column) -> Column:
    """Keys of two names that may be one company's: equal, one begins with the other (of four at least), or similar by 0.8 (of five)."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 4) & long.startswith(short)) | ((F.length(short) >= 5) & (N.similarity(a, b) >= 0.8)))


#: The fields that a verdict looks at.
VERDICT_FIELDS = ("title", "name", "site_name", "legal_name")


def site_verdicts(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, verdict, says): whether the pages of a site are about the company they are read for.

    facts: site, page, field, value, of VERDICT_FIELDS at least; sites: site, home (the page it opens with), name. blocked: the home page shows a gate in
    place of itself. match: a name that the site gives itself, or a legal name, is like the company's. mismatch: none is.
    nameless: the site calls itself nothing.
    """
    home = facts.join(sites.select("site", F.col("home").alias("page")), ["site", "page"], "left_semi").where("field = 'title'")
    gated = home.where(F.col("value").rlike(GATE)).select("site").distinct().withColumn("gated", F.lit(True))
    head = F.trim(F.get(F.split(F.col("value"), r"\s[|–—·-]\s"), F.lit(0)))
    own = facts.where("field IN ('name', 'site_name')").select("site", "value", F.lit(True).alias("self"))
    own = own.unionByName(facts.where("field = 'legal_name'").select("site", "value", F.lit(False).alias("self"))).unionByName(home.select("site", head.alias("value")).where(looks_like_name(F.col("value"))).withColumn("self", F.lit(True)))
    keyed = own.withColumns({"key": N.name_key(F.col("value")), "loose": N.loose_name_key(F.col("value"))}).where("key <> ''")
    wanted = sites.select("site", N.name_key(F.col("name")).alias("w_key"), N.loose_name_key(F.col("name")).alias("w_loose"))
    j = keyed.join(wanted, "site").withColumn("hit", names_alike(F.col("key"), F.col("w_key")) | ((F.col("loose") != "") & (F.col("loose") == F.col("w_loose"))))
    said = j.groupBy("site").agg(F.max("hit").alias("hit"), F.min(F.when(F.col("self"), F.col("value"))).alias("says"))
    out = sites.select("site").join(gated, "site", "left").join(said, "site", "left")
    verdict = F.when(F.col("gated"), "blocked").when(F.col("hit"), "match").when(F.col("hit").isNull(), "nameless").otherwise("mismatch")
    return out.select("site", verdict.alias("verdict"), F.when(verdict == "mismatch", F.col("says")).alias("says"))


def job_postings(found: DataFrame, addresses: DataFrame, company: DataFrame | None = None) -> DataFrame:
    """(page, pos, title, location, employment_type, remote, posted_at, apply_url) of the JobPosting nodes (page, pos, node).

    addresses: (page, url), where to apply if the posting does not say. company: (page, name): postings of other organisations
    are left out. A posting needs a title; a date is a day; only web addresses are links.
    """
    n = F.col("node")
    j = found.where(F.array_contains(types(n), "jobposting")).join(addresses.select("page", F.col("url").alias("page_url")), "page", "left")
    place = F.try_variant_get(F.get(F.filter(each(n, "jobLocation"), P.is_object), F.lit(0)), "$.address", "variant")
    where = F.concat_ws(", ", F.trim(_text(place, "$.addressLocality")), F.trim(_text(place, "$.addressRegion")))
    remote = F.coalesce(F.try_variant_get(n, "$.jobLocationType", "string"), F.lit("")).rlike("(?i)telecommute")
    posted = F.regexp_extract(F.coalesce(F.try_variant_get(n, "$.datePosted", "string"), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1)
    link = F.trim(_text(n, "$.url"))
    j = j.select(
        "page", "pos", F.substring(F.trim(_text(n, "$.title")), 1, 120).alias("title"), F.when(where != "", where).when(remote, "Remote").alias("location"),
        F.trim(_text(F.get(each(n, "employmentType"), F.lit(0)))).alias("employment_type"), F.when(remote, True).alias("remote"), F.when(posted != "", posted).alias("posted_at"),
        F.when(link.rlike("(?i)^https?://"), link).otherwise(F.col("page_url")).alias("apply_url"), F.trim(_either(F.try_variant_get(n, "$.hiringOrganization", "variant"), "name")).alias("__org"),
    ).where("title IS NOT NULL")
    if company is not None:
        j = j.join(company.select("page", F.col("name").alias("__name")), "page", "left")
        j = j.withColumns({"__a": N.name_key(F.col("__org")), "__b": N.name_key(F.col("__name"))})
        a, b = F.col("__a"), F.col("__b")
        alike = (a != "") & (b != "") & ((a == b) | a.startswith(b) | b.startswith(a) | (N.similarity(a, b) >= 0.8))
        j = j.where(F.col("__org").isNull() | F.col("__name").isNull() | alike).drop("__name", "__a", "__b")
    return j.drop("__org")
