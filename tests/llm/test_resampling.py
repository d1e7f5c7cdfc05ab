import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tracefold.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, runs, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x, runs)[1]), Counter(bucket(f) for _, x in target for f in features(x, runs)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size_s + 10_000) / ((s[b] + 1) * (size_t + 10_000))))
    rows, able = [], []
    for d, x in docs:
        n, f = features(x, runs)
        weight = sum(gain(bucket(y)) for y in f)
        h = d is not None and int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(f), weight, score))
        if d is not None and n >= least:
            able.append((-score, d))
    drawn = {d: k + 1 for k, (_, d) in enumerate(sorted(able)[: percent * len(able) // 100])}
    return sorted(((*r, drawn.get(r[0])) for r in rows), key=repr)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma9", "délta", "e", "zeta-eta", "TWO", "x1", "ﬁne", "y_z"]
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 80))) + r.choice(["", ".", "\n", "-"])) for i in range(n)]


@pytest.mark.parametrize("runs", [1, 3])
def test_against_brute_force(spark, runs):
    docs = [*texts(150), (200, None), (201, ""), (202, "long text of many words, again. " * 400), (None, "nobody " * 30)]
    target = texts(12, 2)
    df, tf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string")
    got = sorted(map(tuple, R.importance_resample(df, tf, runs=runs).collect()), key=repr)
    assert got == brute(docs, target, runs)


def test_chunks_carry_words_and_own_starting_places():
    text = "".join(random.Random(4).choice(["one ", "two, ", "three-four\n", "é", "  ", "--- "]) for _ in range(900))
    words = R.words_of(text.encode())
    for runs in (1, 2, 4):
        for size in (1, 9, 60, 10_000):
            parts = list(R.chunks_of(text, runs, size))
            assert sum(own for _, own in parts) == len(words)
            at = 0
            for part, own in parts:
                mine = R.words_of(part)
                assert mine == words[at : at + own + runs - 1]
                at += own
            whole = sorted(R.feature_codes(words, len(words), runs).tolist())
            assert sorted(c for part, own in parts for c in R.feature_codes(R.words_of(part), own, runs).tolist()) == whole


def test_long_texts_are_dealt_in_chunks_with_the_same_result(spark):
    docs = [(1, "alpha beta " * 500), (2, "beta gamma9 TWO " * 300), (3, "one word " * 5), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for runs in (1, 2):
        small = R.counted(df, "doc_id", "text", runs, chunk=200)
        assert small.where("long").count() > 10
        total = {}
        for r in small.collect():
            w, f = total.get(r.id, (0, 0))
            total[r.id] = (w + r.n_words, f + r.n_features)
        assert total == {d: (n, len(f)) for d, (n, f) in ((d, features(x, runs)) for d, x in docs)}


def test_ranks_run_on_over_ranges(spark):
    r = random.Random(6)
    rows = [(i, r.randint(0, 9), i) for i in range(500)]
    out, n = R.ranked(spark.createDataFrame(rows, "id long, score long, row long"), ["score", "id", "row"])
    assert n == 500
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [x.id for x in out.orderBy("rank").collect()] == [x[0] for x in want]
    assert [x.rank for x in out.orderBy("rank").collect()] == list(range(1, 501))


def test_resampling_edges(spark, edge, edge_rows, nothing):
    target = spark.createDataFrame([(1, "one shared line of text"), (None, None)], "item_id long, text string")
    out = R.importance_resample(edge, target)
    assert out.columns == ["id", "n_features", "weight", "score", "rank"] and out.count() == 13
    sevens = [r for r in out.collect() if r.id == 7]
    assert len({(r.n_features, r.weight, r.score) for r in sevens}) == 1
    assert R.resampling_digest(nothing, target).count() == 0
    assert R.resampling_digest(edge, target.limit(0)).count() == 13
