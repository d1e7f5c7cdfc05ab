import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_groups, brute_lines, sets_of
from tracefold.llm import gru, langid
from tracefold.llm.tokens import tokenizer_path


def test_gradient_is_that_of_the_loss():
    p = gru.init(4, 3, 1)
    r = np.random.default_rng(0)
    x, y, w = r.integers(0, 256, (5, 6)), np.array([0, 1, 2, 0, 1, 2]), np.ones(6, dtype=np.float32)
    _, g = gru.gradients(p, x, y, w)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        ends = []
        for step in (1e-2, -1e-2):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            ends.append(gru.gradients(q, x, y, w)[0])
        assert abs((ends[0] - ends[1]) / 2e-2 - g[k][at]) < 2e-4


def test_labeller_agrees_with_the_training_pass():
    p = gru.init(4, 3, 2)
    x = np.random.default_rng(1).integers(0, 256, (9, 4)).astype(np.uint8)
    runs = {s: gru._run(p, s, x) for s in "fb"}
    logits = np.einsum("lh,thn->tln", p["Vf"], runs["f"]["out"]) + np.einsum("lh,thn->tln", p["Vb"], runs["b"]["out"]) + p["d"]
    prob = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(gru.Labeller(p).sums(x), prob.sum(axis=0), atol=1e-4)
    # a padded window counts like the window alone
    padded = np.concatenate((x, np.zeros((5, 4), dtype=np.uint8)))
    assert np.allclose(gru.Labeller(p).sums(padded, np.full(4, 9)), prob.sum(axis=0), atol=1e-4)


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_whole_documents_against_a_loop_over_places(larger):
    """The mean over all bytes of a text, window by window, from the states one after another."""
    langs, net = langid.learn(larger)
    rows = [r for r in larger.orderBy("doc_id").limit(30).collect() if r.text and any(map(str.isalpha, r.text))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(larger.where(F.col("doc_id").isin([r.doc_id for r in rows])), (langs, net)).collect()}
    for r in rows:
        raw, total = np.frombuffer(r.text.encode(), dtype=np.uint8), np.zeros(len(langs))
        for at in range(0, len(raw), langid.WINDOW):
            window = raw[at : at + langid.WINDOW][:, None]
            runs = {s: gru._run(net, s, window) for s in "fb"}
            logits = np.einsum("lh,thn->tln", net["Vf"], runs["f"]["out"]) + np.einsum("lh,thn->tln", net["Vb"], runs["b"]["out"]) + net["d"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += (p / p.sum(axis=1, keepdims=True)).sum(axis=(0, 2))
        mean = total / len(raw)
        assert got[r.doc_id][0] == langs[int(mean.argmax())] and abs(got[r.doc_id][1] - mean.max()) < 1e-3


def test_held_out_accuracy(larger):
    found = {r.doc_id: r for r in langid.language_digest(larger).collect()}
    truth = {r.doc_id: r.lang for r in larger.select("doc_id", "lang").collect()}
    assert {k for k, r in found.items() if r.held_out} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    held = [k for k in truth if found[k].held_out]
    assert np.mean([found[k].lang_pred == truth[k] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_edges(edge, nothing, larger):
    model = langid.learn(larger)
    got = langid.identify(edge, model)
    assert got.columns == [c for c in edge.columns if c != "score"] + ["lang_pred", "score"]
    und = {r.doc_id for r in got.collect() if r.lang_pred == "und"}
    assert und == {3, 4, 5, 10, None} and langid.keep_identified(edge, model).columns == edge.columns
    assert langid.language_digest(nothing).count() == 0 and langid.learn(nothing) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.language_digest(edge).count() == 13


def test_rare_languages_are_learned_at_every_size(spark):
    """60 and 6 of 200,000 documents: far under one in SAMPLE, in letters of their own."""
    lang = F.when(F.col("id") % 3333 == 1, "el").when(F.col("id") % 33333 == 2, "ru").otherwise("en")
    text = F.when(F.col("lang") == "el", "και το νερό της θάλασσας ").when(F.col("lang") == "ru", "вода и ветер над морем ").otherwise("the water of the sea and the wind ")
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), lang.alias("lang")).withColumn("text", F.concat(F.repeat(text, 3), F.col("doc_id").cast("string")))
    model = langid.learn(docs)
    assert model[0] == ["el", "en", "ru"]
    rare = langid.identify(docs.where("lang <> 'en' OR doc_id < 100"), model)
    assert rare.where("lang_pred <> lang AND lang <> 'ru'").count() == 0
    assert langid.keep_identified(docs.where("lang = 'el'"), model).count() == docs.where("lang = 'el'").count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version of itself, on what its predecessor kept."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if n < 4:
            assert out.columns == columns
            kept.append(len(after))
        if name == "language_id":
            gone = set(before) - {r.doc_id for r in after}
            assert len(gone) <= len(before) // 20 and {r.doc_id for r in after} <= set(before)
        elif name == "line_dedup":
            want = {w[0]: w[3] for w in brute_lines([(k, r.text) for k, r in before.items()])}
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
        elif name == "minhash_near_dedup":
            assert sorted(r.doc_id for r in after) == [w[0] for w in brute_groups([(k, r.text) for k, r in before.items()]) if w[3]]
        elif name == "benchmark_decontamination":
            items = [sets_of(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            index = {}
            for i, s in enumerate(items):
                for x in s:
                    index.setdefault(x, []).append(i)
            clean = set()
            for k, r in before.items():
                hits = Counter(i for x in sets_of(r.text) for i in index.get(x, ()))
                if not any(100 * c >= 75 * len(items[i]) for i, c in hits.items()):
                    clean.add(k)
            assert {r.doc_id for r in after} == clean
        else:
            assert {r.doc_id for r in after} == set(before)
        docs = out
    assert kept[0] == kept[1] >= kept[2] > kept[3] > 0


def test_run_is_its_stages_one_after_another(spark, tmp_path):
    """run() itself, against plain versions of the stages that have one and its own two trained or packed ends."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    lines = {}
    for doc, text in sorted(texts.items()):
        for key in {x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")}:
            lines.setdefault(key, []).append(doc)
    lost = {k: v[0] for k, v in lines.items() if len(k) >= 10 and len(v) > 1}
    texts = {doc: "\n".join(x for x in (text or "").split("\n") if lost.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), doc) == doc) for doc, text in texts.items()}
    texts = {doc: texts[doc] for doc, _, _, kept in brute_groups(sorted(texts.items())) if kept}
    items = [s for s in (sets_of(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()) if s]
    texts = {doc: text for doc, text in texts.items() if not any(100 * len(s & sets_of(text)) >= 75 * len(s) for s in items)}
    encoder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {(doc, start, crc) for doc, text in texts.items() for start, crc in pieces_of([*encoder.encode(text, add_special_tokens=False).ids, 1])}
    got = corpus_pipeline.run(spark, d).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096


def pieces_of(ids):
    return [(at, zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())) for at in range(0, len(ids), 4096)]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_keep_columns_of_any_name(spark, edge, nothing):
    """Nulls, repeated rows, no rows, and columns named like results go through every stage as they are."""
    d = "/root/testdata/sf0.001"
    names = ["component_id", "n_shingles", "n_lines", "n_dropped", "kept_text", "lang_pred", "sequence_id"]
    for rows in (edge, nothing):
        docs = rows.withColumns({n: F.lit(n) for n in names})
        for _, stage in corpus_pipeline.STAGES[1:4]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(getattr(r, n) == n for r in got for n in names)
            assert bool(got) == (rows is edge)
        assert corpus_pipeline.language_id(spark, docs, d).columns == docs.columns
        assert (corpus_pipeline.best_fit_packing(spark, docs, d).count() > 0) == (rows is edge)
    got = corpus_pipeline.line_dedup(spark, edge, d).collect()
    assert {r.text for r in got if r.doc_id == 4} == {None} and {r.kept for r in got if r.doc_id in (1, 7)} == {True}
