import html as html_module
import re
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from tracefold.functions import addresses, dates, geo, names, pages, registry_numbers, roles, sectors, urls


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_name_keys(spark):
    got = each(spark, ["The Café & Co Pty Ltd", "Acme (AU) Labs", "the", "Ltd", None, "Über Tech Group Inc", "A.B.C. Corp"], names.name_key)
    assert got == ["cafeand", "acmelabs", "the", "ltd", "", "ubertechgroup", "abc"]
    assert each(spark, ["Acme (AU) Labs", "Über Tech Group Inc", "Labs"], names.loose_name_key) == ["acme", "uber", "labs"]


def test_name_variants(spark):
    got = each(spark, ["Acme (formerly Bolt) (aka Zed) (Sydney)", "Plain", "(only)"], names.name_variants)
    assert [tuple(r) for r in got] == [("Acme", ["Zed", "Sydney"], ["Bolt"]), ("Plain", [], []), ("(only)", ["only"], [])]


def test_similarity_against_python(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def want(a, b):
        if not a or not b:
            return 0.0
        edit = 1 - lev(a, b) / max(len(a), len(b))
        if len(a) < 6 or len(b) < 6:
            return edit
        ga, gb = [[s[i : i + 2] for i in range(len(s) - 1)] for s in (a, b)]
        shared = sum(min(ga.count(g), gb.count(g)) for g in set(ga))
        return max(edit, 2 * shared / (len(a) + len(b) - 2))

    words = ["", "a", "abcabc", "abcabcabc", "abcdef", "abcdeg", "kitten", "sitting", "bananas", "ananasb", "acmelabs", "labsacme"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", names.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r.s - want(r.a, r.b)) < 1e-9, r


def test_fold_and_slug(spark):
    text = "Crème Brûlée ＆ Söhne (Sydney)"
    assert each(spark, [text], names.fold)[0] == "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert each(spark, ["Crème & Söhne (Sydney)", "(x)"], names.slug) == ["creme-and-sohne", "x"]
    assert each(spark, ["Sydney (CBD)", "Unknown", None], names.city_key) == ["sydney", None, None]
    assert each(spark, ["José  O'Neil", "Cher"], names.person_key) == ["jose o'neil", None]


def test_urls(spark):
    assert each(spark, ["https://WWW.Acme.com.au/x?y", "acme.io", "http://10.0.0.1/", "nohost", None, "ftp://a.b"], urls.host) == ["acme.com.au", "acme.io", None, None, None, None]
    got = each(spark, ["https://shop.acme.com.au/", "https://a.b.acme.io", "team.github.io"], urls.canonical_domain)
    assert [(r.domain, r.shared) for r in got] == [("acme.com.au", False), ("acme.io", False), ("team.github.io", True)]
    assert each(spark, ["HTTP://A.com/B/?utm_source=x&b=2&a=1#z"], urls.canonical_url) == ["https://a.com/B?a=1&b=2"]
    assert each(spark, ["https://www.A.com/b/", "a.com/b?x"], urls.url_key) == ["a.com/b", "a.com/b"]


def test_registry_numbers(spark):
    assert each(spark, ["51 824 753 556", "51 824 753 557", "1", None], registry_numbers.is_abn) == [True, False, False, False]
    assert each(spark, ["004 085 616", "004 085 617", None], registry_numbers.is_acn) == [True, False, False]


def test_geo(spark):
    sydney, melbourne = (F.lit(-33.8688), F.lit(151.2093)), (F.lit(-37.8136), F.lit(144.9631))
    (m,) = one(spark, geo.distance_metres(*sydney, *melbourne))
    assert 713_000 < m < 714_500
    none = F.lit(None)
    block = lambda **k: geo.location_block(*[k.get(x, none.cast(t)) for x, t in (("verified", "boolean"), ("address", "string"), ("lat", "double"), ("lng", "double"), ("suburb", "string"), ("city", "string"), ("state", "string"))])
    yes, point = F.lit(True), {"lat": F.lit(1.0), "lng": F.lit(2.0)}
    got = one(
        spark, block(), block(verified=yes, address=F.lit("1 High St"), **point), block(verified=yes, suburb=F.lit("Glebe"), city=F.lit("Sydney"), **point),
        block(verified=yes, suburb=F.lit("sydney"), city=F.lit("Sydney"), **point), block(verified=yes, state=F.lit("NSW")),
    )
    assert got == ("UNKNOWN", "EXACT", "SUBURB", "CITY", "STATE")


def test_dates(spark):
    assert each(spark, ["2026-10", "2026-10-05", "x", None], dates.day) == [None, datetime(2026, 10, 5), None, None]
    assert each(spark, ["2026", "2026-10", "2026-10-05", "oct"], dates.partial_text) == ["2026", "Oct 2026", "5 Oct 2026", None]
    as_of = F.lit(datetime(2026, 10, 5))
    at = lambda d: F.lit(datetime(2026, 10, d)) if d else F.lit(None).cast("timestamp")
    got = one(spark, dates.fresh(at(1), at(3), as_of), dates.fresh(at(1), None if False else at(0), as_of), dates.fresh(at(8), at(0), as_of), dates.fresh(at(3), at(3), as_of))
    assert [g and g.kind for g in got] == ["role", "funding", None, "funding"]
    (u,) = one(spark, dates.unit(F.lit("seed")))
    import hashlib

    assert u == int(hashlib.sha256(b"seed").hexdigest()[:8], 16) / 2**32
    assert one(spark, *[dates.backoff_minutes(F.lit(n)) for n in (0, 1, 3, 9)], dates.backoff_minutes(F.lit(1), F.lit(False)), dates.backoff_minutes(F.lit(1), F.lit(True), F.lit(7200))) == (15, 15, 180, 1440, 1440, 120)


PAGE = """<html><head><title> A &amp; B
</title><meta content="Desc" name="description"><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Acme"},{"@type":"JobPosting","title":"Dev"}]}</script>
<script type='application/ld+json'>broken{</script></head><body><a class=x href="/one">1</a><a href='/two'>2</a><a href="/one">3</a><a href="#top">4</a><!-- <p>no</p> --><style>p{}</style><p>Hi&nbsp;there</p></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    h = F.col("html")
    r = df.select(pages.title(h).alias("t"), pages.links(h).alias("l"), pages.meta(h, "description").alias("m"), pages.strip_tags(h).alias("s")).first()
    assert (r.t, r.l, r.m, r.s) == ("A & B", ["/one", "/two"], "Desc", "A & B 1 2 3 4 Hi there")
    got = df.select(F.explode(pages.json_ld(h)).alias("v")).select(pages.ld_string(F.col("v"), "$['@type']").alias("k"), pages.ld_string(F.col("v"), "$.name").alias("n")).collect()
    assert [(r.k, r.n) for r in got] == [("Organization", "Acme"), ("JobPosting", None)]
    assert each(spark, ["He  said “hi” – ok"], lambda c: pages.quote_found(c, F.lit('said "HI" - ok'))) == [True]


def test_strip_tags_against_python(spark):
    def plain(html):
        s = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ", html)
        s = re.sub(r"(?s)<[^>]*>", " ", s)
        s = re.sub(r"&(?:#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);", lambda m: pages.NAMED.get(m[0][1:-1].lower(), html_module.unescape(m[0]) if "#" in m[0] else m[0]), s)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" ")

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in df.select("html", pages.strip_tags(F.col("html")).alias("t")).collect():
        assert r.t == plain(r.html)


def test_redaction_against_python(spark):
    def plain(t):
        return re.sub(pages.PHONE, "[phone removed]", re.sub(pages.MOBILE, "[phone removed]", re.sub(pages.EMAIL.replace(r"\G|", ""), "[email removed]", t)))

    sample = ["mail a@b.co, call 0412 345 678 or +61 2 9999 8888 or 1300 123 456; 13 12 34", "logo@2x.png (02) 9999 1234 x", "(312) 555-1234", "", "no contact"]
    sample += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert each(spark, sample, pages.redact_contacts) == [plain(t) for t in sample]
    kinds = each(spark, ["a@b.co 0412 345 678 (02) 9999 1234"], lambda c: F.transform(pages.contacts(c), lambda x: x["kind"]))
    assert kinds == [["email", "mobile", "phone"]]


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x/1</link><guid>g</guid><pubDate>Mon, 2 Feb 2026 00:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt; there</description></item></rss>"
    atom = "<feed><entry><title>T</title><link href='https://x/2'/><id>i</id><updated>u</updated><summary>S</summary></entry></feed>"
    got = each(spark, [rss, atom, "", None], pages.feed_items)
    assert [tuple(x) for x in got[0]] == [("A & B", "https://x/1", "g", "2026-02-02T00:00:00.000Z", "Hi there")]
    assert [tuple(x) for x in got[1]] == [("T", "https://x/2", "i", None, "S")]
    assert got[2] == [] and not got[3]


def test_entities_named_and_numbered(spark):
    given = ["a &amp;lt; b &#8217;s &#x2019; &#x1F600; &hellip; &unknown; &#0; &#xD800; & c", "none", None, "&AMP;&nbsp;x"]
    assert each(spark, given, pages.decode_entities) == ["a &lt; b ’s ’ 😀 … &unknown; &#0; &#xD800; & c", "none", None, "& x"]


def test_long_runs_do_not_end_the_session(spark):
    given = ["a@b" + ".c" * 20_000, "x" * 200_000, "1 " + "word " * 12_000 + "street"]
    got = each(spark, given, pages.redact_contacts)
    assert got[0] == "[email removed]" and got[1] == given[1]
    assert [len(x) for x in each(spark, given, pages.contacts)][:2] == [1, 0]
    assert each(spark, given, addresses.street)[2] == "1 " + "word " * 12_000 + "street"


def test_units_in_front_of_a_street_go_in_turn(spark):
    given = ["L6/8/4 Martin Place, Sydney", "Suite 1.103/477 Collins St", "Level 7 127 Creek St", "The Foundry, 2 Main Rd", "Yatala QLD 4207"]
    assert each(spark, given, addresses.street) == ["4 martin place", "477 collins street", "127 creek street", "2 main road", None]


def test_feed_items_have_title_link_guid_and_time(spark):
    rss = (
        "<rss><item><title>No link</title></item><item><title>A &#8217; B</title><link>https://x.y/1</link><pubDate>Tue, 03 Mar 2026 10:15:00 +1100</pubDate></item>"
        "<item><title>C</title><link>https://x.y/2</link><guid>g2</guid><dc:date>2026-03-04T01:02:03Z</dc:date></item><item><link>https://x.y/3</link></item></rss>"
    )
    (items,) = each(spark, [rss], pages.feed_items)
    assert [(i.title, i.link, i.guid, i.published) for i in items] == [
        ("A ’ B", "https://x.y/1", "https://x.y/1", "2026-03-02T23:15:00.000Z"),
        ("C", "https://x.y/2", "g2", "2026-03-04T01:02:03.000Z"),
    ]


def test_points_and_states(spark):
    points = [(-16.919, 145.778, "QLD"), (-35.353, 149.232, "NSW"), (-35.353, 149.232, "QLD"), (0.0, 0.0, "NSW"), (-33.86984, 151.20828, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lng double, state string")
    rows = geo.nearest_centre(df, "lat", "lng", 250).withColumn("bad", geo.conflicts_with_state(F.col("lat"), F.col("lng"), F.col("state"))).orderBy("i").collect()
    assert [r.centre for r in rows] == ["Cairns", "Queanbeyan", "Queanbeyan", None, "Sydney"]
    assert [r.bad for r in rows] == [False, False, True, False, True]


def test_sectors_roles_and_profiles(spark):
    assert each(spark, ["healthtech ", "VR", "Community", "Basket weaving", "N/A", "", None, "HR Tech"], sectors.group_of) == [
        "Health & Biotech", "Deep Tech & Space", "Other", "Other", None, None, None, "Software & DevTools",
    ]
    assert each(spark, ["Basket weaving", "saas", None], sectors.is_placed) == [False, True, True]
    assert each(spark, ["Talent Partner", "Operating Partner", "General Partner", "Venture Scout", "Baker", " ", None, "Investor/Analyst"], roles.role_class) == [
        "talent", "platform", "investment", "scout", "other", None, None, "investment",
    ]
    assert each(spark, ["https://au.LinkedIn.com/in/J%C3%A9Z/?x=1#t", "http://www.a.b:80/P/", "mailto:x", None, "https://linkedin.com/company/x"], roles.profile_key) == [
        "linkedin.com/in/jéz", "a.b/P", None, None, "linkedin.com/company/x",
    ]
    assert each(spark, ["https://linkedin.com/in/x", "https://linkedin.com/in/x/y", None], roles.is_linkedin_profile) == [True, False, False]
