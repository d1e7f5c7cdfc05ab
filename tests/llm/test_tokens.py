import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tracefold.llm import packing, tokencount, tokenfiles
from tracefold.llm.tokens import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def texts():
    r = random.Random(2)
    letters = "abC É ñ\n\t.,'s<|endoftext|>ΣσİK日本😀éÅ1２%  "
    latin = "".join(chr(c) for c in range(0x20, 0x180))
    words = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't", "ΑΣ ", "ΣΑΣ.", "é", "́a", "...!", "</w>", "x</w>y"]
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    out += ["".join(r.choice(latin) for _ in range(r.randint(1, 30))) for _ in range(800)]
    return out + [" ".join(r.choice(words) for _ in range(6)) for _ in range(200)] + ["", None, " ", "\n"]


def test_pieces_are_encoded_like_whole_texts(tokenizer, monkeypatch):
    e = Encoder(tokenizer_path())
    for remembered in (10**6, 40):
        monkeypatch.setattr("tracefold.llm.tokens.REMEMBERED_BYTES", remembered)
        sample = texts()
        encoded = [x for at in range(0, len(sample), 150) for x in e.encode(sample[at : at + 150])]
        for got, text in zip(encoded, sample, strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def check_packing(rows, wanted, capacity):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def pieces_of(tokenizer, rows, capacity, end=1):
    out = []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")
        out += [(doc is None, doc or 0, n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
    return out


def test_packing_of_documents(spark, tokenizer, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    wanted = pieces_of(tokenizer, rows, 4096)
    n = check_packing(packing.pack_documents(documents).collect(), wanted, 4096)
    assert n == -(-sum(w[4] for w in wanted) // 4096)


def test_packing_edges(spark, tokenizer, edge, edge_rows, nothing):
    wanted = pieces_of(tokenizer, [r[:2] for r in edge_rows], 4096)
    check_packing(packing.pack_documents(edge).collect(), wanted, 4096)
    check_packing(packing.pack_documents(edge, capacity=16).collect(), pieces_of(tokenizer, [r[:2] for r in edge_rows], 16), 16)
    assert packing.pack_documents(nothing).count() == 0


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_runs_pack_like_best_fit_of_single_pieces():
    r = random.Random(1)
    for _ in range(60):
        capacity = r.choice([1, 7, 64, 500])
        lengths = [r.randint(1, capacity) if r.random() < 0.7 else max(1, capacity // 3) for _ in range(r.randint(0, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.best_fit(histogram, capacity)
        assert sum(x.count for x in runs) == plain_best_fit(lengths, capacity)
        assert len({x.number for x in runs}) == len(runs)


def test_token_files_round_trip(spark, tokenizer, documents):
    folder, shards = tokenfiles.write_token_files(documents, shards=5)
    got = tokenfiles.read_token_files(spark, folder, shards, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, row in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = tokenizer.encode(row.text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (row.doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    # one document alone, through the index
    first = shards.orderBy("shard").first()
    shard = tokenfiles.Shard(first.path, tokenfiles.read_dictionary(folder))
    assert shard.find(int(shard.ids[3])).tolist() == [r.ids for r in got if r.doc_id == int(shard.ids[3])][0] and shard.find(-5) is None
    with pytest.raises(ValueError, match="dictionary"):
        tokenfiles.Shard(first.path, b"another")


def test_there_is_a_dictionary_at_every_size():
    import zstandard

    for samples in ([], [b"ab"], [b"one sample of ids"] * 7, [b""] * 50, [b"the same"] * 5000, [bytes([i % 251, i % 7]) * 60 for i in range(500)]):
        d = tokenfiles.train_dictionary(samples)
        assert 8 <= len(d) <= tokenfiles.DICTIONARY_BYTES
        frame = tokenfiles._compressor(d).compress(b"one sample of ids and more")
        assert tokenfiles._decompressor(d).decompress(frame) == b"one sample of ids and more"
        if samples and len(d) > 16:
            plain = zstandard.ZstdCompressor(level=tokenfiles.LEVEL).compress(samples[0])
            assert len(tokenfiles._compressor(d).compress(samples[0])) <= len(plain) + 4


def test_token_file_edges(spark, tokenizer, edge, edge_rows, nothing):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens) for r in tokenfiles.token_file_digest(edge).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted(r[:2] for r in got) and len(got) == 13
    counts = sorted(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in edge_rows)
    assert sorted(r[3] for r in got) == counts and [r[2] for r in got] == [sum(x[3] for x in got[:i]) for i in range(13)]
    assert tokenfiles.token_file_digest(nothing).count() == 0


@pytest.fixture(scope="module")
def unigram():
    vocab = tokencount.vocabulary(tokencount.vocabulary_path())
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always", split=True)
    return vocab, t


def test_counts_are_those_of_the_unigram_tokenizer(unigram, documents):
    vocab, tok = unigram
    c = tokencount.Counter(vocab)
    r = random.Random(1)
    letters = "ab e\n\tñé▁<0x41>日本😀1."
    sample = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n", "a\n", "\n a", "  a  b ", "<0x0A>", "<s>a</s>"]
    sample += [x.text for x in documents.limit(60).collect()]
    for text in sample:
        assert c.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


def test_ties_and_unknown_characters():
    # equal scores: the piece that starts earlier stays; without byte pieces a run of unknown characters is one token
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = tokencount.Counter(vocab)
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice("ab xy\n") for _ in range(r.randint(0, 12)))
        assert c.count(text) == len(tok.encode(text, add_special_tokens=False).ids), text


def test_count_edges(edge, nothing, edge_rows, unigram):
    got = tokencount.count_tokens(edge)
    assert got.columns == [c for c in edge.columns if c != "n_tokens"] + ["n_tokens"]
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(unigram[1].encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows)
    assert tokencount.token_count_digest(nothing).count() == 0
