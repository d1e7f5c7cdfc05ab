"""What a web page says, by built-in expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions.once import once

# The named entities that are decoded.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "copy": "©", "reg": "®",
}
ENTITY = r"&(?:#[xX][0-9a-fA-F]{1,7}|#[0-9]{1,9}|[a-zA-Z]+);"


def _entity(hit: Column) -> Column:
    """The character of an entity, named or numbered; an unknown one stays as it is."""
    body = F.lower(F.substring(hit, 2, F.length(hit) - 2))
    number = F.when(body.rlike("^#x"), F.conv(F.substring(body, 3, 9), 16, 10)).when(body.rlike("^#"), F.substring(body, 2, 9)).try_cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), body)
    surrogate = number.between(0xD800, 0xDFFF)
    return F.when((number > 0) & (number < 0x110000) & ~surrogate, char).otherwise(F.coalesce(named, hit))


def decode_entities(text: Column) -> Column:
    """Every entity once, from left to right: what a decoded one leaves is not decoded again."""
    hits = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    between = F.split(text, ENTITY, -1)
    decoded = F.array_join(F.zip_with(between, F.concat(F.transform(hits, _entity), F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def title(html: Column) -> Column:
    t = F.trim(decode_entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))
    return F.when(t != "", t)


def links(html: Column) -> Column:
    """array<string> of the targets of all anchors, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#][^"']*)["']"""), F.lit(1)))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by its name or property, whichever order its attributes have."""
    a = F.regexp_extract(html, rf"""(?i)<meta\s[^>]*?(?:name|property)=["']{name}["'][^>]*?content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?i)<meta\s[^>]*?content=["']([^"']*)["'][^>]*?(?:name|property)=["']{name}["']""", 1)
    return F.when(a != "", a).when(b != "", b)


def strip_tags(html: Column) -> Column:
    """The text of a page: no scripts, styles, drawings, templates, comments and tags, white space in single blanks."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|template)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(s, r"(?s)<[^>]+>", " ")), r"\s+", " "))


#: Levels of lists and graphs that one pass opens.
LEVELS = 4


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_graph(v: Column) -> Column:
    """A node that only stands for its @graph; null, false, 0 and "" are none."""
    said = F.try_variant_get(v, "$['@graph']", "variant")
    return said.isNotNull() & ~F.is_variant_null(said) & ~F.coalesce(F.try_variant_get(v, "$['@graph']", "string"), F.lit("-")).isin("", "0", "false")


def opened(nodes: Column) -> Column:
    """array<variant>: lists and graphs give way to what they hold, LEVELS deep."""
    graph = lambda v: F.array(F.try_variant_get(v, "$['@graph']", "variant"))
    one = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(is_graph(v), graph(v)), F.array(v))
    for _ in range(LEVELS):
        nodes = F.flatten(F.transform(nodes, one))
    return nodes


def still_closed(nodes: Column) -> Column:
    return F.exists(nodes, lambda v: is_list(v) | is_graph(v))


def ld_blocks(html: Column) -> Column:
    """array<variant> of the JSON-LD blocks that parse, as they stand."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def json_ld(html: Column) -> Column:
    """array<variant> of the objects of all JSON-LD blocks, those in lists and graphs one by one, LEVELS deep (see `facts.nodes` for any depth)."""
    return F.filter(opened(ld_blocks(html)), is_object)


def ld_string(block: Column, path: str) -> Column:
    return F.try_variant_get(block, path, "string")


def quote_found(text: Column, quote: Column) -> Column:
    """Whether a page says a quote, case, spacing and typographic quotes aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.translate(c, "‘’“”–—", "''\"\"--"), r"\s+", " ")))
    return F.contains(flat(text), flat(quote))


#: How feeds write a moment, once the day of the week is off and the zone is a number.
MOMENTS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def moment(text: Column) -> Column:
    """A feed's time in ISO form, UTC; null where it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    parsed = F.coalesce(*[F.try_to_timestamp(plain, F.lit(m)) for m in MOMENTS])
    return F.date_format(F.to_utc_timestamp(parsed, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def feed_items(xml: Column) -> Column:
    """array<struct<title, link, guid, published, excerpt>> of an RSS or Atom feed.

    Items without title or link are left out; the link stands in for a missing guid.
    """
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))

    def said(item: Column, *names: str) -> Column:
        """The text of the first of these elements that says something."""
        out = F.lit("")
        for name in reversed(names):
            raw = F.regexp_replace(F.regexp_extract(item, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
            # tags may be written as entities, and what they leave may hold entities again
            own = strip_tags(decode_entities(raw))
            out = F.when(own != "", own).otherwise(out)
        return out

    def link(item: Column) -> Column:
        own = said(item, "link")
        return F.when(own != "", own).otherwise(F.regexp_extract(item, r"""(?i)<link\b[^>]*\bhref=["']([^"']+)["']""", 1))

    def row(item: Column) -> Column:
        guid = said(item, "guid", "id")
        return F.struct(
            said(item, "title").alias("title"),
            link(item).alias("link"),
            F.when(guid != "", guid).otherwise(link(item)).alias("guid"),
            moment(said(item, "pubDate", "published", "updated", "dc:date")).alias("published"),
            F.substring(said(item, "description", "summary"), 1, 600).alias("excerpt"),
        )

    return F.filter(F.transform(items, row), lambda r: (r["title"] != "") & (r["link"] != ""))


# Contact patterns, e-mail first, then mobile and other telephone numbers.
# The possessive repeats and the guard in front keep a long run of letters or dots from being tried at each of its places.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?!\d+x\.(?:png|jpe?g|gif|webp|avif|svg)\b)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# A look ahead at the first character spares most places of a text all the ways of writing a number.
MOBILE = r"(?=[+(0])(?:\(04\)\s?\d{4}\s?\d{4}|(?<!\d)04\d{2}[\s-]?\d{3}[\s-]?\d{3}(?!\d)|\+\s?61[\s-]?\(?0?\)?[\s-]?4(?:[\s-]?\d){8})"
PHONE = r"(?=[+(\d])(?:" + "|".join(
    (
        r"\+\s?61[\s-]?\(?0?\)?[\s-]?[2-378][\s-]?\d{4}[\s-]?\d{4}",
        r"\(0[2-478]\)[\s-]?\d{4}[\s-]?\d{4}",
        r"(?<!\d)0[2-478][\s-]?\d{4}[\s-]?\d{4}(?!\d)",
        r"(?<!\d)1300[\s-]?\d{3}[\s-]?\d{3}(?!\d)",
        r"(?<!\d)1800[\s-]?\d{3}[\s-]?\d{3}(?!\d)",
        r"(?<![\d-])13[\s-]\d{2}[\s-]\d{2}(?![\d-])",
        r"\+\d{1,3}[\s-]?\(?\d{1,4}\)?(?:[\s-]?\d{2,4}){2,3}",
        r"\(\d{3}\)\s?\d{3}[\s.-]\d{4}",
        r"(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    )
) + ")"


def redact_contacts(text: Column) -> Column:
    s = F.regexp_replace(text, EMAIL, "[email removed]")
    return F.regexp_replace(F.regexp_replace(s, MOBILE, "[phone removed]"), PHONE, "[phone removed]")


def contacts(text: Column) -> Column:
    """array<struct<kind, text>>: e-mail addresses, then mobile numbers, then other telephone numbers.

    One pass finds all of them, so that no two overlap; each is then named by what it is.
    """
    found = F.regexp_extract_all(text, F.lit(f"{EMAIL}|{MOBILE}|{PHONE}"), F.lit(0))
    kind = lambda t: F.when(F.contains(t, F.lit("@")), "email").when(t.rlike(f"^(?:{MOBILE})$"), "mobile").otherwise("phone")
    named = F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))
    of = lambda all_, wanted: F.filter(all_, lambda x: x["kind"] == wanted)
    return once(named, lambda all_: F.concat(of(all_, "email"), of(all_, "mobile"), of(all_, "phone")))
