"""Addresses on the web as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of two parts, and hosts that many tenants share.
TWO_PART_SUFFIXES = (
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "asn.au", "id.au",
    "co.nz", "org.nz", "net.nz", "govt.nz", "ac.nz",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk",
    "com.sg", "com.hk", "co.jp", "co.kr", "co.in", "com.br", "com.mx", "co.za", "com.cn", "com.tw", "com.my",
)
SHARED_HOSTS = (
    "github.io", "gitlab.io", "netlify.app", "vercel.app", "herokuapp.com", "onrender.com", "pages.dev", "workers.dev",
    "web.app", "firebaseapp.com", "azurewebsites.net", "cloudfront.net", "amazonaws.com", "wixsite.com", "squarespace.com",
    "webflow.io", "framer.website", "framer.app", "notion.site", "carrd.co", "blogspot.com",
    "wordpress.com", "weebly.com", "godaddysites.com", "myshopify.com", "bubbleapps.io", "glideapp.io", "canva.site",
    "substack.com", "medium.com",
)
#: Query parameters that do not change what a page is.
TRACKING = r"^(?:utm_.*|ref|source|gclid|fbclid|mc_cid|mc_eid)$"


def host(url: Column) -> Column:
    """The lower-cased host of an http(s) address, without www; null for anything else."""
    s = F.lower(F.trim(url))
    s = F.when(s.rlike("^[a-z][a-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    h = F.regexp_extract(s, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    h = F.regexp_replace(F.regexp_replace(h, r"\.$", ""), r"^www\d*\.", "")
    return F.when(h.contains(".") & ~h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), h)


def registrable_domain(h: Column) -> Column:
    """The last two labels of a host, three where the last two are a known suffix."""
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    return F.when(h.isNull(), None).when(F.size(labels) <= 2, h).when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def is_shared_host(h: Column) -> Column:
    return h.rlike(rf"\.(?:{'|'.join(x.replace('.', chr(92) + '.') for x in SHARED_HOSTS)})$")


def canonical_domain(url: Column) -> Column:
    """struct<host, domain, shared>: a tenant of a shared host keeps its whole host as domain."""
    h = host(url)
    return F.when(h.isNotNull(), F.struct(h.alias("host"), F.when(is_shared_host(h), h).otherwise(registrable_domain(h)).alias("domain"), is_shared_host(h).alias("shared")))


def url_key(url: Column) -> Column:
    """Host and path, without scheme, www, query, fragment and trailing slashes, lower-cased."""
    s = F.lower(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), r"[?#].*$", ""), "/+$", "")


def canonical_url(url: Column) -> Column:
    """https, lower-cased host, no fragment, no tracking parameters, parameters in order, no trailing slash."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]+", ""), r"[?#].*$", ""), "/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))
    return F.when(h != "", F.concat(F.lit("https://"), h, path, tail))
