from __future__ import annotations

import random
import re

from siltstone.llm import minhash


def brute(docs):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and 100 * len(p & q) >= 85 * len(p | q):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    out = [None, "", " \n ", "a b", "A B", "one two three four five", "One two  three\nfour five", "x " * 4000]
    for _ in range(12):
        base = make(rng.choice((30, 80, 200)))
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "edit"
            if rng.random() < 0.3:
                own = own[rng.randrange(8) :]
            out.append(" ".join(own))
            base = own if rng.random() < 0.5 else base  # chains
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


def test_components_match_all_pairs(spark):
    for seed in (1, 2, 3):
        docs = corpus(seed)
        frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_shingles int")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}
        assert got == brute(docs)


def test_one_stays_of_each_component(spark):
    docs = corpus(5)
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.component_id for r in rows} == {r.doc_id for r in rows if r.kept}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_id_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    for seed in (6, 7):
        docs = corpus(seed)
        frame = spark.createDataFrame([*docs, (None, docs[8][1]), (None, None)], "doc_id long, text string")
        rows = minhash.near_duplicates(frame).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute(docs)
        assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2


def test_forest_joins_what_all_pairs_join():
    import numpy as np

    rng = np.random.default_rng(3)
    for crossed in (False, True):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.05, 0.3]), rng.integers(0, 1 << 60, 60).astype(np.uint64), base)) for _ in range(40)]
        block = [i % 2 for i in range(40)]
        found = minhash.forest(list(range(40)), list(range(40)), block, sets, crossed)
        parts = [{i} for i in range(40)]
        merge = lambda i, j: parts.remove(b) or a.update(b) if (a := next(p for p in parts if i in p)) is not (b := next(p for p in parts if j in p)) else None
        for i, j in found:
            merge(i, j)
        got = sorted(map(sorted, parts))
        parts[:] = [{i} for i in range(40)]
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and (not crossed or block[i] != block[j]):
                    merge(i, j)
        assert got == sorted(map(sorted, parts)) and len(got) < 40


def test_hot_keys_and_copied_pivots(spark, monkeypatch):
    from siltstone.llm import shared

    monkeypatch.setattr(shared, "HOT", 50)
    monkeypatch.setattr(shared, "LEAST", 2)
    monkeypatch.setattr(minhash, "SALT", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    docs = corpus(9)
    for i in range(60):  # exact copies and near copies of one text
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"edit{i}"
        docs.append((20_000 + i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_all_texts_of_a_repeated_doc_id_count(spark):
    rng = random.Random(10)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    docs = [(7, a), (7, b), (3, b + " x"), (9, a + " y"), (11, c)]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(7, 3), (3, 3), (9, 3), (11, 11)} and len(rows) == 5


def test_join_hot_is_a_join(spark, monkeypatch):
    from siltstone.llm import shared

    monkeypatch.setattr(shared, "LEAST", 3)
    rows = spark.createDataFrame([(i % 3 if i < 30 else i, i) for i in range(50)], "k long, v long")
    table = rows.groupBy("k").count().where("k != 2 and k < 45").selectExpr("k", "k * 10 AS w", "count AS often")
    for hot in (4096, 10, 1):
        monkeypatch.setattr(shared, "HOT", hot)
        got = {(r.k, r.v, r.w) for r in shared.join_hot(rows, table, ["k"]).select("k", "v", "w").collect()}
        assert got == {(k, v, k * 10) for k, v in ((i % 3 if i < 30 else i, i) for i in range(50)) if k != 2 and k < 45}


def test_small_slices_and_batches_give_the_same(spark, monkeypatch):
    from siltstone.llm import minhash as M

    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine w{i % 7} ten eleven twelve " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, M.near_duplicates(docs).collect()))
    monkeypatch.setattr(M, "SLICE", 100)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
