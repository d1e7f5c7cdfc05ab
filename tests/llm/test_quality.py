import random
import zlib

import numpy as np
import pytest

from tracefold.llm import pieces, quality


def brute_counts(text):
    """Bucket counts by a loop over places, from the hashes of single pieces."""
    raw = (text or "").encode()
    out = {quality.BUCKETS: 1}
    blank = b" \t\n\r\x0b\x0c"
    padded = b" " + raw + b" "
    for n in quality.GRAMS:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if any(c in blank for c in gram[1:-1]):
                continue
            h = 0
            for c in gram:
                h = (h * 0x9E3779B1 + int(quality._CODE[c])) % 2**32
            h ^= h >> 15
            b = ((h * 0x85EBCA6B + n) % 2**32) >> 16
            out[b] = out.get(b, 0) + 1
    for w in raw.split():
        b = int(quality.words([w.decode()]).hashes[0] >> np.uint64(48))
        out[b] = out.get(b, 0) + 1
    return out


@pytest.mark.parametrize("text", ["", None, "a", "Ab  cde\tfgh\n", "naïve café", "one two three " * 30])
def test_features_against_a_loop_over_places(text):
    buckets, counts = quality.bucket_counts([text])[0]
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == brute_counts(text)


def test_long_texts_have_the_features_of_the_whole():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcxyz") for _ in range(r.randint(1, 9))) for _ in range(3000))
    whole = quality.bucket_counts([text])[0]
    parts = list(pieces.cut(text.encode(), 700))
    assert b"".join(parts) == text.encode() and max(map(len, parts)) <= 700
    total = {}
    for part in parts:
        for b, c in zip(*(x.tolist() for x in quality.bucket_counts([part.decode()])[0]), strict=True):
            total[b] = total.get(b, 0) + c
    total[quality.BUCKETS] = 1
    assert total == dict(zip(*(x.tolist() for x in whole), strict=True))


def test_gradient_is_that_of_the_loss():
    net = quality.fresh()
    net["W"] = np.random.default_rng(1).normal(size=net["W"].shape)
    buckets, share = np.array([3, 70, 900]), np.array([0.5, 0.3, 0.2])
    _, dw, db, dm = quality.gradients(net, buckets, share, 1)

    def slope(change):
        ends = []
        for step in (1e-5, -1e-5):
            other = quality.Network({k: v.copy() for k, v in net.items()})
            change(other, step)
            ends.append(quality.gradients(other, buckets, share, 1)[0])
        return (ends[0] - ends[1]) / 2e-5

    assert abs(slope(lambda n, s: n["W"].__setitem__((1, 2), n["W"][1, 2] + s)) - dw[1, 2]) < 1e-6
    assert abs(slope(lambda n, s: n["b"].__setitem__(0, n["b"][0] + s)) - db[0]) < 1e-6
    assert abs(slope(lambda n, s: n["E"].__setitem__((70, 4), n["E"][70, 4] + s)) - 0.3 * dm[4]) < 1e-6


@pytest.fixture(scope="module")
def larger(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy_and_scores_of_whole_documents(larger):
    docs, labels = larger
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    assert len(got) == docs.count() and {k for k, r in got.items() if r.held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 5 == 0}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for q, r in held]) > 0.93
    assert np.mean([r.predicted == 1 for q, r in held if q == 1]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    # the sum over all places of a text, feature by feature
    net = quality.learn(docs, labels)
    worth, bias = net["E"] @ (net["W"][1] - net["W"][0]), net["b"][1] - net["b"][0]
    for r in docs.orderBy("doc_id").limit(40).collect():
        buckets, counts = quality.bucket_counts([r.text])[0]
        z = (worth[buckets] @ counts) / counts.sum() + bias
        assert abs(1 / (1 + np.exp(-z)) - got[r.doc_id].score) < 1e-9


def test_quality_edges(spark, edge, nothing, larger):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 1), (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    net = quality.learn(edge, labels)
    out = quality.score(edge, net)
    assert out.columns == [c for c in edge.columns if c != "score"] + ["score", "predicted"] and out.count() == 13
    assert len({r.score for r in out.collect() if not (r.text or "")}) == 1
    assert quality.learn(edge, labels.limit(0)) is None and quality.learn(nothing, labels) is None
    assert {r.score for r in quality.score(edge, None).collect()} == {0.5}
    assert quality.quality_digest(nothing, labels.limit(0)).count() == 0


def test_the_sample_is_bounded_and_holds_both_labels(larger):
    docs, labels = larger
    few = quality.learn(docs, labels, sample=20, per_label=10)
    assert few is not None and np.isfinite(few["E"]).all()
