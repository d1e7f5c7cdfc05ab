"""Short texts against plain Python, with the cases that SQL does not show."""

import re

from tracefold.functions import texts
from pyspark.sql import functions as F

TEXTS = [None, "", "  ", "One. Two", "We do e.g. this. And that", "No end", "A v1.2 tool! (Really)", "x" * 300, "word " * 60 + "end. Next", "a, " * 70, "Is it? 3 ways", "Dots... Then", "." * 5, "One.\n\nTwo."]


def plain_sentence(text, most=170):
    t = re.sub(r"\s+", " ", text or "").strip()
    m = re.match(r'.*?[.!?](?=\s+[A-Z0-9"“(]|$)', t)
    first = m.group(0) if m else t
    if len(first) <= most:
        return first
    cut = first[: most - 1]
    at = cut.rfind(" ")
    return re.sub(r"[,;:\s]+$", "", cut[: at if at > 40 else len(cut)]) + "…"


def test_first_sentence(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", texts.first_sentence(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_sentence(t) for i, t in enumerate(TEXTS)}


def test_a_long_text_without_an_end(spark):
    rows = spark.createDataFrame([("a.b " * 200_000,)], "t string")
    assert rows.select(texts.first_sentence(F.col("t")).alias("s")).first().s.endswith("…")


def test_small_forms(spark):
    rows = spark.createDataFrame([("Ann  lee smith", "a@b.co", "x​y\tz", "Solar panels for farms", "farms need solar, software"), (None, "a@b", None, None, "x"), (" ", "a b@c.de", "\x00", "", "")], "n string, m string, c string, a string, b string")
    got = [tuple(r) for r in rows.select(texts.initials(F.col("n")), texts.looks_like_email(F.col("m")), texts.clean_line(F.col("c")), texts.shared_words(F.col("a"), F.col("b"))).collect()]
    assert got == [("AL", True, "xy z", ["solar", "farms"]), ("", False, None, None), ("", False, "", [])]


def test_card_place(spark):
    rows = spark.createDataFrame([("Newtown", "Sydney"), ("Sydney", "Sydney"), ("unknown", "Perth"), (None, None), ("Newtown", " ")], "s string, c string")
    assert [r[0] for r in rows.select(texts.card_place(F.col("s"), F.col("c"))).collect()] == ["Newtown, Sydney", "Sydney", "Perth", "", "Newtown"]
