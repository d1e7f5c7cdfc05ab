import json
from datetime import datetime

from pyspark.sql import functions as F

from tracefold.functions import headlines, pages
from tracefold.operators import facts, validate
from tracefold.plans import facts as plans


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_strips_and_feeds(spark):
    assert one(spark, pages.strip_tags, "<p>x</p><svg><text>logo</text></svg><template>tt</template> y", "a <b>c</b><script>z</script>", "1 <> 2") == ["x y", "a c", "1 <> 2"]
    item = "<item><title>T &amp; U</title><link>https://a.example/1</link><description>&lt;p&gt;Hello &lt;b&gt;world&lt;/b&gt; &amp;amp; co&lt;/p&gt;</description></item>"
    cdata = "<entry><title><![CDATA[<b>A</b> B]]></title><link href='https://a.example/2'/><summary><![CDATA[<i>x</i>]]> y</summary><updated>2024-05-01T00:00:00Z</updated></entry>"
    got = one(spark, pages.feed_items, item + cdata + "<item><title>no link</title></item>")[0]
    assert [(r.title, r.link, r.excerpt, r.published) for r in got] == [("T & U", "https://a.example/1", "Hello world & co", None), ("A B", "https://a.example/2", "x y", "2024-05-01T00:00:00.000Z")]


def script(data, attributes="type='application/ld+json'"):
    return f"<script {attributes}>{data if isinstance(data, str) else json.dumps(data)}</script>"


def test_structured_data_at_any_depth(spark):
    deep = {"@graph": [{"name": "deep"}]}
    for _ in range(9):
        deep = [{"@graph": deep, "name": "lost"}]
    html = script([{"@graph": [{"name": "a"}, [{"name": "b"}]]}, 5, None, "x"], 'async type = "application/ld+json"') + script("{broken") + script(deep) + script({"name": "c", "@graph": []}) + script({"name": "d", "@graph": None})
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    found = facts.nodes(df).orderBy("page", "pos").select("page", F.try_variant_get("node", "$.name", "string").alias("n")).collect()
    assert [(r.page, r.n) for r in found] == [(1, n) for n in ("a", "b", "deep", "d")]


def test_organisations_and_text(spark):
    org = {
        "@type": ["Brand", "Organization"], "name": " Acme ", "alternateName": ["Acme AI", 5, ""], "legalName": "Acme Pty Ltd", "description": "We make things", "foundingDate": "since 2019-01", "founders": [{"name": "Jane Doe"}, "Solo"],
        "address": ["x", {"streetAddress": "1 High St", "addressLocality": "Perth", "addressRegion": "WA", "postalCode": "6000", "addressCountry": {"name": "Australia"}}],
    }
    text = (
        "<body>Acme is operated by Possibility Studios Pty. Limited today. Contact Mitch Privacy Officer Trendspek Operations Pty Ltd. ABN 51 824 753 556 and ABN 11 111 111 111, ACN 004 085 616. "
        "Visit 12/34 Smith Street, Fitzroy VIC 3065. Founded in 2015 by friends. Co-founded by Dr Ada Lovelace, CEO, and Grace Hopper Today. Founded by Big Ventures Group.</body>"
    )
    df = spark.createDataFrame([(1, script(org) + script({"@type": "Person", "name": "No Org"})), (2, text)], "page_id long, html string")
    got = {(r.page, r.field, r.value, r.confidence) for r in facts.page_facts(df).collect()}
    assert {x for x in got if x[0] == 1} == {
        (1, "name", "Acme", "high"), (1, "name", "Acme AI", "high"), (1, "legal_name", "Acme Pty Ltd", "high"), (1, "description", "We make things", "medium"), (1, "founded_year", "2019", "high"),
        (1, "founders", "Jane Doe", "medium"), (1, "address", "1 High St, Perth WA 6000", "high"), (1, "state", "WA", "high"),
    }
    assert {x for x in got if x[0] == 2} == {
        (2, "legal_name", "Possibility Studios Pty Limited", "medium"), (2, "legal_name", "Trendspek Operations Pty Ltd", "medium"), (2, "abn", "51824753556", "medium"), (2, "acn", "004085616", "medium"),
        (2, "address", "12/34 Smith Street, Fitzroy VIC 3065", "medium"), (2, "state", "VIC", "medium"), (2, "founded_year", "2015", "medium"), (2, "founders", "Ada Lovelace", "medium"), (2, "founders", "Grace Hopper", "medium"),
    }


def test_the_strongest_reading_of_each_value(spark):
    rows = [("s", "f", "v", "medium", 1), ("s", "f", "v", "high", 3), ("s", "f", "v", "high", 2), ("s", "f", "w", "odd", 9)]
    got = facts.strongest(spark.createDataFrame(rows, "site string, field string, value string, confidence string, page int"), ["site"], ["page"]).collect()
    assert {(r.value, r.confidence, r.page, r.pages) for r in got} == {("v", "high", 2, 3), ("w", "odd", 9, 1)}


def test_whose_site_it_is(spark):
    rows = [
        ("a", 1, "title", "Acme Robotics | Home"), ("b", 2, "title", "Just a moment..."), ("b", 2, "name", "Beta"), ("c", 3, "name", "Somebody Else"), ("c", 3, "legal_name", "Gamma Holdings Pty Ltd"),
        ("d", 4, "name", "Quite Another"), ("e", 5, "title", "Quality, online learning for everybody"), ("f", 6, "title", "Welcome"), ("g", 7, "title", "Inner page name"), ("g", 8, "title", "Eta"),
    ]
    found = spark.createDataFrame(rows, "site string, page long, field string, value string")
    sites = spark.createDataFrame([("a", 1, "Acme"), ("b", 2, "Beta"), ("c", 3, "Gamma"), ("d", 4, "Delta"), ("e", 5, "Epsilon"), ("f", 6, "Zeta"), ("g", 7, "Eta"), ("h", 9, "Theta")], "site string, home long, name string")
    got = {r.site: (r.verdict, r.says) for r in facts.site_verdicts(found, sites).collect()}
    assert got == {"a": ("match", None), "b": ("blocked", None), "c": ("match", None), "d": ("mismatch", "Quite Another"), "e": ("nameless", None), "f": ("nameless", None), "g": ("mismatch", "Inner page name"), "h": ("nameless", None)}


def test_postings(spark):
    job = {"@type": "JobPosting", "title": " Engineer ", "jobLocation": [{"address": {"addressLocality": "Perth", "addressRegion": "WA"}}], "employmentType": ["FULL_TIME", "x"], "datePosted": "2024-02-03T01:00", "url": "https://a.example/job"}
    blocks = [job, job | {"title": ""}, job | {"hiringOrganization": "Other Corp Holdings"}, job | {"hiringOrganization": {"name": "Acme Labs"}, "jobLocation": None, "jobLocationType": "TELECOMMUTE", "datePosted": "soon", "url": "ftp://x"}]
    df = spark.createDataFrame([(1, script(blocks))], "page_id long, html string")
    rows = facts.job_postings(facts.nodes(df), spark.createDataFrame([(1, "https://acme.example/jobs")], "page long, url string"), spark.createDataFrame([(1, "Acme")], "page long, name string")).orderBy("pos").collect()
    assert [(r.title, r.location, r.employment_type, r.remote, r.posted_at, r.apply_url) for r in rows] == [
        ("Engineer", "Perth, WA", "FULL_TIME", None, "2024-02-03", "https://a.example/job"), ("Engineer", "Remote", "FULL_TIME", True, None, "https://acme.example/jobs"),
    ]


def test_queries_of_pages_read_all_of_them(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/pages.parquet").count()
    assert plans.page_facts(spark, d).where("field = 'name'").agg(F.sum("pages")).first()[0] == n
    got = plans.site_verdicts(spark, d).collect()
    assert len(got) == len({r.site for r in got}) and {r.verdict for r in got} <= {"match", "mismatch", "nameless", "blocked"} and any(r.verdict == "match" for r in got)


def test_stories(spark):
    cases = {
        ("House of Robin raises $5M", ""): ("House of Robin", "headline", False),
        ("Sydney fintech Zed raises $5M seed", "Zed has grown. It raised more."): ("Zed", "headline", False),
        ("Big news", "Bank of X raises $2m to grow"): ("Bank of X", "excerpt", False),
        ("Acme raises $3M", "Acme secured a $3M round"): ("Acme", "excerpt", True),
        ("Concrete idea", "R2Crete turns landfill concrete into roads with a $750k pre-seed"): ("R2Crete", "excerpt-round", False),
        ("How Acme raised $3M", "Acme raises $3M"): None,
        ("Five startups raise $30M", "Acme raises $3M"): None,
        ("Nothing happened", "Nothing at all"): None,
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, t string, e string")
    got = [r.s and tuple(r.s) for r in df.orderBy("i").select(headlines.story(F.col("t"), F.col("e")).alias("s")).collect()]
    assert got == list(cases.values())


def test_leads_of_a_feed_are_fresh(spark):
    rows = [("Acme raises $3M", "l1", "g1", "2024-05-01T00:00:00.000Z", "Perth-based Acme, seed, with Big Fund"), ("Acme raises $3M", "l2", "g2", "2024-01-01T00:00:00.000Z", ""), ("Zed raises $1M", "l3", "g3", None, ""), ("Nothing", "l4", "g4", None, "")]
    items = spark.createDataFrame(rows, "title string, link string, guid string, published string, excerpt string")
    got = headlines.feed_leads(items, F.lit(datetime(2024, 6, 1)), F.array(F.lit("Big Fund"), F.lit("Other"))).collect()
    assert {(r.key, r.name, r["round"], r.city, tuple(r.investors)) for r in got} == {("g1", "Acme", "Seed", "Perth", ("Big Fund",)), ("g3", "Zed", None, None, ())}


def test_roles_links_and_places(spark):
    now = datetime(2024, 5, 2)
    at = datetime(2024, 5, 1)
    rows = [
        ("a", "s", "lever", "https://jobs.lever.co/x?utm_source=1", None, "https://acme.example", True, None), ("b", "s", "lever", "https://jobs.lever.co/x", None, "https://acme.example", None, True),
        ("c", "s", "lever", "https://evil.example/x", "k", "https://acme.example", True, None), ("d", "t", "lever", "https://careers.acme.example/x", "k", "https://acme.example", None, None),
    ]
    df = spark.createDataFrame([(*r[:5], "open", at, at, None, *r[5:]) for r in rows], "id string, source_id string, provider string, apply_url string, duplicate_key string, status string, first_seen_at timestamp, last_confirmed_at timestamp, posted_at timestamp, website string, au boolean, remote_au boolean")
    boards = spark.createDataFrame([("s", "ok", at), ("t", "ok", at)], "source_id string, status string, last_success_at timestamp")
    got = {(r.id, r.code) for r in validate.roles(df, boards, now).collect()}
    assert got == {("a", "shared_link"), ("c", "link_elsewhere"), ("c", "on_two_boards"), ("d", "not_in_australia")}
