from __future__ import annotations

import numpy as np

from siltstone.llm import weak_quality as W
from siltstone.llm.bytetext import text_slices

TEXTS = [None, "", "   ", "One two three.\nOne two three.\n\n A b.", "X!! Y!! Z!!", "a### b%%% c", "again again again again", "| x | y |", "é É ñ"]


def test_measures_of_small_texts():
    import pyarrow as pa

    got = np.vstack([W.measures(data, offsets) for _, _, data, offsets in text_slices(pa.array(TEXTS))])
    assert got.shape == (len(TEXTS), len(W.LABELLERS))
    column = {name: got[:, j] for j, (name, _, _) in enumerate(W.LABELLERS)}
    assert column["words"].tolist() == [0, 0, 0, 8, 3, 3, 4, 5, 3]
    assert column["lines said before"][3] == 1 / 5 and column["three-word windows said before"][3] == 1 / 28
    assert column["symbols per word"][5] == 2 and column["words that end in a symbol"][5] == 2 / 3
    assert column["capitals among letters"][4] == 1 and column["exclamation marks per word"][4] == 2
    assert column["words said twice in a row"][6] == 3 / 4 and column["words without a letter"][7] == 3 / 5


def test_slices_do_not_change_measures():
    import pyarrow as pa

    whole = np.vstack([W.measures(d, o) for _, _, d, o in text_slices(pa.array(TEXTS))])
    parts = np.vstack([W.measures(d, o) for _, _, d, o in text_slices(pa.array(TEXTS), 1)])
    assert np.array_equal(whole, parts)


def test_patterns_round_trip():
    said = np.random.default_rng(0).integers(0, 3, (50, len(W.LABELLERS)))
    assert np.array_equal(W.votes_of(W.pattern_of(said)), said)


def test_accuracies_are_recovered():
    rng, n = np.random.default_rng(1), 40_000
    good = rng.random(n) < 0.85
    right = np.array([0.95, 0.9, 0.8, 0.9, 0.7, 0.9])
    said = np.where(good[:, None], W.GOOD, np.where(rng.random((n, 6)) < right, W.BAD, W.GOOD))
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    table, share = W.accuracies(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.03
    # the prior draws the rates towards its own, and keeps their order
    assert set(np.argsort(table[0, :, W.BAD])[:2]) == {2, 4} and table[1, :, W.BAD].max() < 0.02
    after = W.posterior(said, table, share)
    assert ((after >= 0.5) == good).mean() > 0.99


def test_held_out_labels_of_the_synthetic_table(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = W.score(docs).collect()
    assert len(rows) == docs.count()
    kept = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    gone = [not r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(kept) > 0.98 * len(kept) and sum(gone) > 0.95 * len(gone)
    # the scorer sees trigrams only, and tells the labels about as well as the votes do
    right = {c: sum((r[c] >= 0.5) == labels[r.doc_id] for r in rows if r.doc_id in labels) for c in ("score", "posterior")}
    assert right["score"] >= right["posterior"] - 0.01 * len(labels)
    assert len({r.score for r in rows}) > 4 * len({round(r.posterior, 9) for r in rows})


def test_scorer_never_sees_votes(spark):
    # by their votes both texts at the end are alike; the scorer tells them apart by what it has learnt
    good, bad = "The quiet harbour kept its boats in order, and the sailors sang. " * 8, "#### $$$$ %%%% **** |||| #### " * 12
    rows = [(i, good + f"Day {i} ends.") for i in range(60)] + [(100 + i, bad + str(i)) for i in range(30)] + [(200, "harbour boats sailors"), (201, "$$$$ harbour ####")]
    got = {r.doc_id: r for r in W.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and not got[100].kept and got[200].score > got[201].score


def test_accuracies_match_plain_em_on_every_row():
    rng = np.random.default_rng(2)
    m = len(W.LABELLERS)
    good = rng.random(3000) < 0.7
    said = np.where(rng.random((3000, m)) < 0.3, W.NONE, np.where(good[:, None] ^ (rng.random((3000, m)) < 0.1), W.GOOD, W.BAD))
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    table, share = W.accuracies(patterns, counts.astype(float))
    # one row after the other, one labeller after the other
    p = [(sum(v == W.GOOD for v in row) + 1) / (sum(v != W.NONE for v in row) + 2) for row in said.tolist()]
    for _ in range(300):
        plain = np.tile(W.PRIOR * W.RATES[:, None, :], (1, m, 1))
        for j in range(m):
            for v in range(3):
                here = said[:, j] == v
                plain[1, j, v] += np.sum(np.asarray(p)[here])
                plain[0, j, v] += np.sum(1 - np.asarray(p)[here])
        plain /= plain.sum(axis=2, keepdims=True)
        rate = (sum(p) + W.PRIOR / 2) / (len(p) + W.PRIOR)
        odds = [np.prod(plain[c][np.arange(m), said], axis=1) * w for c, w in ((0, 1 - rate), (1, rate))]
        new = odds[1] / (odds[0] + odds[1])
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    assert np.allclose(table, plain, atol=1e-6) and abs(share - rate) < 1e-6
    # the data, not the prior, set the rates
    assert abs(table[1, :, W.BAD].mean() - 0.07) < 0.01 and abs(table[0, :, W.GOOD].mean() - 0.07) < 0.01


def test_scores_match_brute_force(spark):
    texts = [*TEXTS, "Some plain words stand here. " * 30, "### $$$ " * 40, "Wörter, und noch mehr Wörter.\n" * 20]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    table, share, w = W.learn(frame)
    rows = W.score(frame).collect()
    assert len(rows) == 2 * len(texts)
    import pyarrow as pa

    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        [(_, _, flat, offsets)] = list(text_slices(pa.array([data.decode()])))
        said = W.votes(W.measures(flat, offsets))[0]
        odds = [np.prod([table[c, j, v] for j, v in enumerate(said)]) * s for c, s in ((0, 1 - share), (1, share))]
        after = odds[1] / sum(odds)
        assert abs(r.posterior - after) < 1e-6
        grams = [(int.from_bytes(data[i : i + 3], "little") * 2_654_435_761 % 2**32) >> 16 for i in range(len(data) - 2)]
        z = sum(w[g] for g in grams) / max(len(grams), 1) * W.SCALE + w[-1]
        assert abs(r.score - (1 / (1 + np.exp(-z)) if grams else after)) < 1e-6


def test_long_texts_and_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(W, "ENTRIES", 50)
    frame = spark.createDataFrame([(i, "Plain words, of some length, stand here.") for i in range(40)] + [(99, "long words here. " * 200_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in W.score(frame).collect()}
    assert len(rows) == 41 and all(0 <= r.score <= 1 for r in rows.values()) and rows[0].score == rows[1].score


def test_edge_cases(spark):
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(TEXTS)] + [(None, "x"* 5000, 1.0)], "doc_id long, text string, score double")
    rows = W.score(frame).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows)
    assert all(r.score == r.posterior for r in rows if r.doc_id in (0, 1))
    assert W.score(frame.limit(0)).count() == 0
