import random

import numpy as np

from tracefold.llm import decontaminate as D
from tracefold.llm import topk as T


def brute_top_k(rows, k):
    out = []
    for q, a in rows:
        if q % 20 == 0:
            near = sorted((bin(a ^ b).count("1"), i) for i, b in rows)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_top_k_is_exact_with_ties_and_a_hot_code(spark):
    r = random.Random(1)
    hot = r.getrandbits(63)
    codes = [hot if r.random() < 0.35 else r.getrandbits(63) if r.random() < 0.5 else hot ^ (1 << r.randrange(63)) for _ in range(600)]
    rows = list(enumerate(codes))
    df = spark.createDataFrame(rows, "id long, code long")
    got = T.top_k(df, df.where("id % 20 = 0"), 10).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 10)


def test_top_k_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (20, -1)], "id long, code long")
    assert sorted(map(tuple, T.top_k(df, df.where("id % 20 = 0"), 10).collect())) == brute_top_k([(0, 5), (1, 5), (20, 2**64 - 1)], 10)
    assert T.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_over_several_blocks_and_shards_without_ids_or_codes(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 40)
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "AT_A_TIME", 3)
    r = random.Random(2)
    rows = [(i, r.getrandbits(8)) for i in range(400)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 3), (20, None)], "id long, code long")
    assert sorted(map(tuple, T.top_k(df, df.where("id % 20 = 0"), 10).collect())) == brute_top_k(rows, 10)


def test_codes_of_vectors(spark):
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64), (2, None), (None, [1.0] * 64), (3, [0.5, -0.5]), (4, []), (5, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.id: r.code for r in T.binary_codes(df).collect()}
    assert got[0] == -1 and got[1] == 0 and set(got) == {0, 1, 3}
    assert T.top_k_digest(df).count() == 3
    assert T.top_k_digest(df.limit(0)).count() == 0


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_containment_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    items = [" ".join(word() for _ in range(n)) for n in (5, 9, 12, 20, 40, 70, 200, 3, 4, 2)] + ["", None]
    docs = []
    for n in range(120):
        parts = [word() for _ in range(r.randint(0, 900))]
        if n % 3 and items[n % 8]:
            words = items[n % 8].split(" ")
            if n % 9 == 1:
                words[len(words) // 2] = "changed"
            at = r.randint(0, len(parts))
            parts[at:at] = words
        docs.append(" ".join(parts))
    docs += ["", None, items[7], items[7].upper()]
    docs += [" ".join([word(), *items[8].split(), word()]), items[8].upper(), items[9], f"{items[9]} and more", " ".join(items[8].split()[:3])]
    row = lambda x: " " + " ".join((x or "").lower().split()) + " "
    short = lambda y: len((y or "").split()) in (3, 4)
    want = [(d, i, len(sets(x) & sets(y)), len(sets(y))) for d, x in enumerate(docs) for i, y in enumerate(items) if not short(y) and sets(y) and 100 * len(sets(x) & sets(y)) >= 75 * len(sets(y))]
    want = sorted(want + [(d, i, 1, 1) for d, x in enumerate(docs) for i, y in enumerate(items) if short(y) and row(y) in row(x)])
    assert len({i for _, i, *_ in want}) == 10
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(map(tuple, D.contaminated(a, b).collect())) == want
    clean = {r.doc_id for r in D.decontaminate(a, b).collect()}
    assert clean == set(range(len(docs))) - {w[0] for w in want}


def test_containment_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 2)
    text = "one two three four five six seven eight nine ten"
    a = spark.createDataFrame([(1, text), (2, "nothing of the kind is in here at all")], "doc_id long, text string")
    b = spark.createDataFrame([(i, text) for i in range(5)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(a, b).collect()} == {(1, i) for i in range(5)}
    assert [r.doc_id for r in D.decontaminate(a, b).collect()] == [2]


def test_containment_edges(spark, edge, nothing):
    b = spark.createDataFrame([(1, "needle in a very long text that goes on")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(edge, b).collect()) == [6, 7, 7]
    assert D.decontaminate(edge, b).columns == edge.columns and D.decontaminate(edge, b).count() == 10
    assert D.contaminated(nothing, b).count() == 0 and D.contaminated(edge, b.limit(0)).count() == 0 and D.decontaminate(edge, b.limit(0)).count() == 13


def test_window_minima_cover_any_run():
    index = D.build_index([(0, " ".join(f"w{i}" for i in range(16)))])
    (c,) = index.classes
    assert c.u > len(index.sets[0]) >= c.u // 2 and np.array_equal(c.items, [0])
