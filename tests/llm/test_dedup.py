import hashlib
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tracefold.llm import components, linededup, neardup, shingles


def brute_lines(docs):
    """Rows (id, text) -> {row: (n_lines, n_dropped, kept)}; ids are not null."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = ["a line that is shared", " A Line that is SHARED\t", "ÄÖ shared line with umlauts", "short", "", "   ", "0123456789", "012345678", "x" * 50]
    docs = [(i, None if r.random() < 0.05 else "\n".join(r.choice(pool) if r.random() < 0.6 else f"own line number {r.random()}" for _ in range(r.randint(0, 9)))) for i in range(300)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for batches in (1, 4, 9):
        got = linededup.dedup_lines(df, batches=batches).collect()
        assert sorted((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in got) == brute_lines(docs)


def test_runs_are_compacted(spark, tmp_path):
    runs = linededup.LineRuns.open(spark, str(tmp_path / "runs"), buckets=4)
    for i in range(5):
        runs.push(spark.createDataFrame([(bytes([i]), i)], "h binary, owner long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1] and sorted(r.owner for t in runs.tables() for r in t.collect()) == [0, 1, 2, 3, 4]
    # a look-up shuffles neither run
    runs.push(spark.createDataFrame([(b"x", 9)], "h binary, owner long"))
    a, b = runs.tables()
    plan = a.join(b.withColumnRenamed("owner", "other").hint("merge"), "h", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_second_batch_meets_saved_runs(spark, tmp_path):
    docs = [(i, f"line shared by all of them\nline of {i % 40} and its copies\nown line of number {i}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path, got = str(tmp_path / "runs"), []
    for low, high in ((0, 50), (50, 90), (90, 120)):
        got += linededup.LineRuns.open(spark, path, buckets=4).add(df.where(f"doc_id >= {low} AND doc_id < {high}")).collect()
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in got) == brute_lines(docs)


def test_lines_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a line of text that repeats", "x"), (2, "a line of text that repeats", "y")], "doc_id long, text string, positions string")
    df = df.withColumns({"kept": F.lit(7), "__lines": F.lit("l"), "doc": F.lit("d"), "version": F.lit("v"), "lines": F.lit(1), "n": F.lit(2), "c0": F.lit(3)})
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert [got[2][c] for c in ("positions", "kept", "__lines", "doc", "version", "lines", "n", "c0", "n_dropped")] == ["y", 7, "l", "d", "v", 1, 2, 3, 1]


def test_line_edges(edge, nothing):
    out = linededup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_dropped", "kept_text"] and out.count() == 13
    rows = out.collect()
    assert [r.n_dropped for r in rows if r.doc_id == 2] == [1] and [r.n_dropped for r in rows if r.doc_id is None] == [0, 0]
    assert [r.n_dropped for r in rows if r.doc_id == 6] == [0] and {r.n_dropped for r in rows if r.doc_id == 7} == {3}
    assert linededup.line_dedup_digest(nothing).count() == 0


def words_of(text):
    return (text or "").encode().lower().split()


def sets_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(docs):
    sets = {d: sets_of(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def edits(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.random()}"
    return " ".join(words)


def test_groups_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    docs, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randint(1, 160))]
        for _ in range(r.randint(1, 7)):
            docs.append((n, edits(r, base, r.randint(0, 4))))
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "x y"), (n + 4, "X  y"), (n + 5, "x y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_dup_digest(df).collect())) == brute_groups(docs)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text that differ so much that many are linked only through others; blocks are smaller than buckets."""
    monkeypatch.setattr(neardup, "CHUNK", 20)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, edits(r, base, r.randint(0, 6))) for i in range(250)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_dup_digest(df).collect())) == brute_groups(docs)


def test_texts_of_one_id_are_one_document(spark):
    a, b = "one two three four five six seven eight nine ten", " ".join(f"b{i}" for i in range(60))
    near = b.replace("b59", "other")
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, near), (11, "alone in its own group"), (12, ""), (12, a)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_dup_digest(docs).collect()}
    assert got == {(3, 3, True), (7, 3, False), (9, 3, False), (11, 11, True), (12, 3, False)}


def test_min_max_estimates_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate((a[:1500], r.integers(0, 2**63, 500, dtype=np.uint64)))
    agree = (neardup.minmax(a, neardup.MORE) == neardup.minmax(b, neardup.MORE)).mean()
    assert abs(agree - 1500 / 2500) < 0.06


def test_sketches_keep_pairs_at_the_threshold():
    """Planted pairs of similarity 0.75 to 0.76, which no hub connects: their sketches agree enough."""
    r = np.random.default_rng(12)
    lost = 0
    for _ in range(400):
        n = int(r.integers(40, 700))
        union = r.integers(0, 2**63, n, dtype=np.uint64)
        both = -(-75 * n // 100)
        half = both + (n - both) // 2
        a, b = union[:half], np.concatenate((union[:both], union[half:]))
        first = [neardup.sketch(neardup.minmax(x)) for x in (a, b)]
        more = [neardup.sketch(neardup.minmax(x, neardup.MORE)) for x in (a, b)]
        agree = [np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in (first, more)]
        lost += agree[0] < neardup.LEAST_AGREE or agree[1] < neardup.LEAST_AGREE_MORE
    assert lost == 0


def test_near_duplicates_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", "y", 3), (2, "a b c d e f", "z", "w", 4)], "doc_id long, text string, __doc string, doc string, id int")
    got = {r.doc_id: (r["__doc"], r.doc, r.id, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: ("x", "y", 3, 1), 2: ("z", "w", 4, 1)}


def test_near_edges(edge, nothing):
    out = neardup.near_duplicates(edge)
    assert set(out.columns) == {*edge.columns, "n_shingles", "component_id"} and out.count() == 13
    got = {(r.doc_id, r.component_id, r.kept) for r in out.collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False), (None, None, True), (10, 10, True)}
    assert neardup.near_dup_digest(nothing).count() == 0


def test_shingles_are_sets_of_words():
    texts = ["A b c d e f", "q", "a B c  d\ne F", "", None, "a b c d e é", "x " * 5000, "one\x1ctwo three four five six"]
    s = shingles.shingles(shingles.words(texts))
    got = [len(np.unique(s.hashes[a:b])) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    assert got == [len(sets_of(t)) for t in texts]
    assert np.array_equal(s.hashes[0:2], s.hashes[s.first[2] : s.first[3]])


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: find(k) for k in root if k != 300 and any(k in e and e[0] != e[1] for e in edges)}
    assert got == want
