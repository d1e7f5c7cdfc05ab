import hashlib
import random

import numpy as np
import pytest

from tracefold.llm import boost, pii, secrets


def spans(rows):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in rows}


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is True
    assert secrets.trigram_query("(?:abc|xyzw)") == ("or", ("abc", ("and", ("xyz", "yzw"))))
    assert secrets.trigram_query("ab?c") is True  # "ac" has no trigram


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_hold_for_matches(rule):
    hits = {
        "assign": 'API_KEY = "abcdefghijkl"', "access": "AKIAABCDEFGHIJKLMN", "hex": "0123456789abcdef", "github": "ghp_" + "a" * 36, "slack": "xoxb-1234567890ab",
        "google": "AIza" + "b" * 35, "stripe": "sk_live_" + "c" * 20, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "pem": "-----BEGIN RSA PRIVATE KEY-----",
    }
    text = hits[rule.kind].lower()

    def met(q):
        return True if q is True else q in text if isinstance(q, str) else (all if q[0] == "and" else any)(map(met, q[1]))

    assert met(secrets.trigram_query(rule.pattern))
    assert [k for _, k, _ in secrets.brute_spans(hits[rule.kind], (rule,))] == [rule.kind]


def test_against_brute_force(spark):
    r = random.Random(5)
    bits = ["token: token: ", "password='", "passwd=", "API-KEY=", "apikey :", "secret", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef0", "é", "\n", " ", "=", '"', "hunter2hunter2", "😀", "xoxb-1234567890ab", "ghp_" + "Z" * 36]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(secrets.find_secrets(df).collect())
    assert got == {i: secrets.brute_spans(t) for i, t in enumerate(texts)}


def test_many_matches_in_one_text(spark):
    text = "0123456789abcdef " * 1500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert spans(secrets.find_secrets(df).collect())[1] == secrets.brute_spans(text)


def test_secret_edges(edge, nothing):
    out = secrets.secret_digest(edge)
    assert out.count() == 13 and secrets.secret_digest(nothing).count() == 0
    full = secrets.find_secrets(edge)
    assert full.columns == [*edge.columns, "secrets"]


def test_columns_of_any_name_stay(spark):
    names = ["__rules", "__s0", "__c0", "__base", "__more", "__doc", "doc", "rules", "c1"]
    df = spark.createDataFrame([(1, "password=abcdefghijkl 1.2.3.4", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for found, column in ((secrets.find_secrets(df), "secrets"), (pii.find_pii(df, pii.train(spark)), "pii")):
        row = found.first()
        assert found.columns == [*df.columns, column] and [row[n] for n in names] == names and len(row[column]) == 1


def test_pii_against_brute_force(spark):
    r = random.Random(6)
    bits = ["a.b", "@", "x-y", ".", "com", "1.2.3.4", "300.1.1.1", "0255.1.1.1", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+1 (555) 123-4567", "+", "12", "é", "\n", "%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, "", "1" * 3000, "a" * 3000 + "@", "1 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.base_sha256 for x in pii.pii_digest(df).collect()}
    want = {i: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in pii.brute_base(t)).encode()).hexdigest() for i, t in enumerate(texts)}
    assert got == want


def test_trees_as_sql_and_held_out_accuracy(spark):
    model = pii.train(spark)
    rows = pii.examples(seed=99)
    df = spark.createDataFrame([(n, t, k, y) for n, (t, k, y) in enumerate(rows)], "doc_id long, text string, kind string, truth int")
    found = {x.doc_id: {s.kind for s in x.pii} for x in pii.find_pii(df, model).collect()}
    # a base kind may have claimed the same digits: then the candidate adds nothing
    right = sum((k in found[n] or ("card" in found[n] and k == "cardlike")) == bool(y) for n, (_, k, y) in enumerate(rows))
    assert right / len(rows) > 0.9


def test_boosting_learns_and_renders(spark):
    x = np.random.default_rng(1).normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boost.train(x, y)
    z = boost.log_odds(trees, x)
    assert ((z > 0) == (y == 1)).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r.z for r in df.selectExpr(f"{boost.as_sql(trees, ['a', 'b', 'c'])} AS z").collect()]
    assert np.allclose(got, z[:50], atol=1e-3)


def test_pii_edges(spark, edge, nothing):
    model = pii.train(spark)
    assert pii.find_pii(edge, model).columns == [*edge.columns, "pii"]
    assert pii.pii_digest(edge).count() == 13 and pii.pii_digest(nothing).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567 now"), (2, None)], "doc_id long, text string")
    got = [r.redacted for r in pii.redact(df, pii.train(spark)).orderBy("doc_id").collect()]
    assert got == ["mail <email> or <phone> now", ""]
