"""What web pages and documents say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import pages as P
from tracefold.functions import urls as U
from tracefold.operators import quotes
from tracefold.plans.base import query
from tracefold.session import table


@query(r"""
SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '') AS title,
len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#][^"'']*)["'']', 1)))::INTEGER AS links FROM pages
""")
def html_title_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", P.title(F.col("html")).alias("title"), F.size(P.links(F.col("html"))).alias("links"))


@query(r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS h, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]+', ''), '[?#].*$', ''), '/+$', '') AS p,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '^(?:utm_.*|ref|source|gclid|fbclid|mc_cid|mc_eid)$'))) AS q FROM pages)
SELECT page_id, CASE WHEN h <> '' THEN 'https://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM u
""")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


TWO = ", ".join(f"'{s}'" for s in U.TWO_PART_SUFFIXES)


@query(rf"""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[0-9]*\.', '') AS h FROM pages),
l AS (SELECT page_id, h, string_split(h, '.') AS l FROM h WHERE contains(h, '.'))
SELECT page_id, h AS host, CASE WHEN len(l) <= 2 THEN h WHEN array_to_string(l[-2:], '.') IN ({TWO}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM l
""")
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host")).where("host IS NOT NULL")
    return h.select("page_id", "host", U.registrable_domain(F.col("host")).alias("domain"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www[0-9]*\.', '') AS h FROM pages)
SELECT h AS host, count(*)::BIGINT AS pages, min(page_id) AS first_page FROM h WHERE contains(h, '.') GROUP BY h
""")
def pages_by_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("host IS NOT NULL")


@query(r"""
WITH p AS (SELECT page_id, replace(html, '</body>', '<svg viewBox="0"><text>logo</text></svg><template><p>t</p></template><!-- a > b -->&#39;&hellip;&mdash;</body>') AS h FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<template\b.*?</template>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM p)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&hellip;', '…'), '&mdash;', '—'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM s
""")
def text_strip(spark: SparkSession, d: str) -> DataFrame:
    """The text of each page, a drawing, a template, a comment and entities put at its end."""
    more = '<svg viewBox="0"><text>logo</text></svg><template><p>t</p></template><!-- a > b -->&#39;&hellip;&mdash;</body>'
    html = F.replace("html", F.lit("</body>"), F.lit(more))
    return table(spark, d, "pages").select("page_id", P.strip_tags(html).alias("text"))


@query()
def redact_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without contact details; the patterns look around, which RE2 can't, so tests hold it against Python."""
    return table(spark, d, "documents").select("doc_id", P.redact_contacts(F.col("text")).alias("redacted"), F.size(P.contacts(F.col("text"))).alias("contacts"))


@query(r"""
SELECT source, lang, count(*)::BIGINT AS docs, count(*) FILTER (WHERE regexp_matches(text, '(?i)\b(?:the|and)\b'))::BIGINT AS english_words, count(*) FILTER (WHERE regexp_matches(text, '(?i)license'))::BIGINT AS licenses FROM documents GROUP BY ALL
""")
def phrase_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(t.rlike(r"(?i)\b(?:the|and)\b")).alias("english_words"), F.count_if(t.rlike("(?i)license")).alias("licenses")
    )


@query(r"""
WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark),
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(t, q)
""")
def quote_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that say a benchmark item."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = quotes.say(texts, table(spark, d, "benchmark").select(F.col("item_id").alias("quote"), "text"))
    return found.select(F.col("quote").alias("item_id"), F.col("doc").alias("doc_id"))


@query("""
SELECT quality, toxic, count(*)::BIGINT AS n, count(d.doc_id)::BIGINT AS with_text, max(length(d.text))::BIGINT AS longest FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL
""")
def label_join_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n_text"), F.lit(1).alias("has"))
    j = table(spark, d, "labels").join(docs, "doc_id", "left")
    return j.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("with_text"), F.max("n_text").cast("long").alias("longest"))
