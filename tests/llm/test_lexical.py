import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracefold.llm import lexical as L
from tracefold.llm import pieces

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d, Counter(terms(x))) for d, x in docs if d is not None and terms(x)]
    n, size = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                rows.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def made(n, seed=1, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé9") for _ in range(r.randint(1, 5))) for _ in range(words)]
    pick = lambda: vocabulary[min(int(r.expovariate(0.15)), words - 1)]
    return [(i, r.choice([" ", ", ", "-"]).join(pick().title() if r.random() < 0.1 else pick() for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("segment", [600, 4_000, 8_000_000])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "LEADERS", 3)
    docs = [*made(300), (900, None), (901, "..."), (None, "nobody a b c"), *[(1000 + i, "the same text for all of them, a b") for i in range(40)]]
    items = [*made(15, 2), (50, None), (51, ""), (52, "unheard-of zzzzzzz"), (53, "the same text")]
    df, qf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = L.search(L.build(df, segment=segment), qf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "TERMS_AT_ONCE", 40)
    docs, items = made(80), made(12, 3)
    df, qf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, L.search_digest(df, qf).collect()), key=repr) == brute(docs, items)


def test_blocks_below_the_bar_stay_packed(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    r = random.Random(5)
    docs = [(i, "common " * r.randint(1, 3) + "filler " * r.randint(5, 400) + ("rare " if i % 100 == 7 else "")) for i in range(2000)]
    n, size = len(docs), sum(len(terms(x)) for _, x in docs)
    at = L.Building(n, size)
    at.ids = [d for d, _ in docs]
    at.add(at.ids, list(range(n)), [x.encode() for _, x in docs])
    s = L.Segment(at.segment(at.ids), n, size)
    hashes = np.unique(L.term_hashes([b"common rare"])[0])
    df = {h: c for h, c in zip(s.terms.tolist(), s.df.tolist(), strict=True)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[int(h)] + 1))) for h in hashes])
    scores, ids = s.search(hashes, weights, 10, L.NONE, 0)
    want = brute(docs, [(0, "common rare")])
    assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(d, sc) for _, _, d, sc in sorted(want, key=lambda x: x[1])]
    blocks = int(sum(-(-df[int(h)] // 16) for h in hashes))
    assert s.decoded < blocks / 2
    # a bar that nothing reaches leaves every block packed
    before = s.decoded
    assert len(s.search(hashes, weights, 10, L.NONE, int(scores[0]) + 10**12)[0]) == 0 and s.decoded == before


def test_byte_code_round_trip():
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(0, 2**b, 200) for b in (1, 7, 8, 14, 15, 31, 40)] + [np.array([0, 127, 128, 16383, 16384])])
    raw, ends = L.encode(values)
    assert np.array_equal(L.decode(raw), values) and ends[-1] == len(raw)
    assert len(L.decode(np.empty(0, dtype=np.uint8))) == 0


def test_long_texts_are_indexed_whole():
    docs = [(1, "alpha beta " * 400 + "needle"), (2, "needle in here"), (3, "beta " * 90)]
    at, groups = L.Building(3, 1), list(pieces.in_groups(enumerate(x for _, x in docs), 500))
    assert len(groups) > 5
    for owners, parts in groups:
        at.add([1, 2, 3], owners, parts)
    s = at.segment([1, 2, 3])
    tf = defaultdict(int)
    seg = L.Segment(s, 3, 1)
    for k, h in enumerate(seg.terms):
        place, doc, n = seg._postings(np.arange(seg.block[k], seg.block[k + 1]))
        for d, c in zip(doc, n, strict=True):
            tf[int(seg.ids[d]), int(h)] += int(c)
    name = lambda w: int(L.term_hashes([w.encode()])[0][0])
    assert tf == {(1, name("alpha")): 400, (1, name("beta")): 400, (1, name("needle")): 1, (2, name("needle")): 1, (2, name("in")): 1, (2, name("here")): 1, (3, name("beta")): 90}


def test_search_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "one shared line", 3), (1, "needle", 4), (None, "line", 5), (2, None, 6)], "item_id long, text string, score int")
    out = L.search(L.build(edge), items)
    assert out.columns == ["item", "rank", "doc_id", "score"]
    got = {(r.item, r.doc_id) for r in out.collect()}
    assert {(1, 6), (1, 7), (1, 1), (None, 1)} <= got and not any(d is None for _, d in got)
    assert L.search(L.build(nothing), items).count() == 0 and L.search(L.build(edge), items.limit(0)).count() == 0
