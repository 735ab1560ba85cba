from __future__ import annotations

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import toxicity


def brute_segments(scores):
    """All maximal scoring segments by their recursive definition: the best one, then the rest on both sides."""
    if not len(scores) or max(scores) <= 0:
        return []
    best, at = -1.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or (abs(total - best) <= 1e-9 and j + 1 - i < at[1] - at[0]):
                best, at = total, (i, j + 1)
    a, b = at
    return brute_segments(scores[:a]) + [(best, a, b)] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=25), st.integers(0, 1000))
def test_segments_match_brute_force(values, seed):
    # small distinct fractions keep sums from tying
    scores = np.array([v + x for v, x in zip(values, np.random.default_rng(seed).uniform(-0.01, 0.01, len(values)), strict=True)])
    got = toxicity.segments(np.zeros(len(scores), np.int64), scores, 1)[0]
    want = brute_segments(scores.tolist())
    assert [(x, y) for _, x, y in got] == [(x, y) for _, x, y in want]


def fixture(spark):
    rng = random.Random(7)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [(90_000, None), (90_001, ""), (90_002, "?!")], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 90))]
        toxic = i % 9 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(("grumf", "blarg", "snirk")) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), dict(rows)


def test_held_out_accuracy_and_passages(spark):
    docs, labels, truth, texts = fixture(spark)
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(texts)
    right = [int(r.predicted == truth[r.doc_id]) for r in rows if r.doc_id in truth and r.held_out]
    assert len(right) > 200 and sum(right) > 0.97 * len(right)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id in truth and truth[r.doc_id] and r.held_out and r.predicted:
            assert any("grumf" in (s := texts[r.doc_id][p.begin : p.end]) or "blarg" in s or "snirk" in s for p in r.passages)
    empty = {r.doc_id: r.score for r in rows if r.doc_id >= 90_000}
    assert len(empty) == 3 and all(s < 0.3 for s in empty.values())


def test_held_out_labels_do_not_count(spark):
    docs, labels, _, _ = fixture(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_no_labels_and_empty_table(spark):
    docs, labels, _, _ = fixture(spark)
    assert all(r.predicted == 0 for r in toxicity.score(docs.limit(5), labels.limit(0)).collect())
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_cross_validation_reads_training_rows_only(spark):
    docs, labels, _, _ = fixture(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.cross_validate(docs, rows, parts=2) for rows in (labels, flipped))
    assert a == b and 0 < a < 0.3


def test_repeated_rows_long_texts_and_code_points(spark):
    docs, labels, truth, texts = fixture(spark)
    long = "ñandú word1 " * 60_000 + "grumf blarg snirk " * 8 + "word2 " * 1000
    more = docs.select("doc_id", "text").unionByName(docs.where("doc_id < 9").select("doc_id", "text")).unionByName(spark.createDataFrame([(80_000, long), (80_000, long)], "doc_id long, text string"))
    rows = toxicity.score(more, labels).collect()
    assert len(rows) == len(texts) + 11
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    for r in rows:
        if r.doc_id == 80_000:
            assert any("grumf blarg" in long[p.begin : p.end] and p.end - p.begin < 400 for p in r.passages)
