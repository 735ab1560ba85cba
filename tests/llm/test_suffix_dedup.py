from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import suffix_dedup as S


def brute_starts(strings, minimum):
    often = Counter(s[i : i + minimum] for s in strings for i in range(len(s) - minimum + 1))
    return [[i for i in range(len(s) - minimum + 1) if often[s[i : i + minimum]] > 1] for s in strings]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=8), st.integers(1, 12))
def test_expansion_matches_brute_force(strings, minimum):
    got = S.repeated([np.frombuffer(s, np.uint8) for s in strings], minimum)
    assert [x.tolist() for x in got] == brute_starts(strings, minimum)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=6), st.integers(2, 30))
def test_expansion_on_any_bytes(strings, minimum):
    strings = strings + [strings[0] + b"x" + strings[-1]]
    got = S.repeated([np.frombuffer(s, np.uint8) for s in strings], minimum)
    assert [x.tolist() for x in got] == brute_starts(strings, minimum)


def brute(texts, minimum):
    raw = [(t or "").encode() for t in texts]
    out = []
    for s, starts in zip(raw, brute_starts(raw, minimum), strict=True):
        gone = bytearray(len(s))
        for i in starts:
            gone[i : i + minimum] = b"\1" * minimum
        spans = sum(1 for i in range(len(s)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(s, gone, strict=True) if not g)
        out.append((len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdeé fghij\n") for _ in range(n))
    passages = [make(n) for n in (150, 199, 200, 201, 260, 900)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, make(5000)]
    for _ in range(60):
        parts = [make(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a:] if rng.random() < 0.3 else p, make(rng.randrange(40)) if rng.random() < 0.8 else ""]
        texts.append("".join(parts))
    base = make(1200)
    texts += [base, base, base[:600] + "!" + base[600:], base[100:], base * 2]
    return texts


def test_documents_match_brute_force(spark):
    for seed, group in ((1, 512), (2, 2)):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, begin int")
        want = dict(enumerate(brute(texts, 200)))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(docs, group=group).collect()}
        assert got == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = corpus(3)[6][:400]
    rows = [(1, text), (1, text), (None, "q" * 150), (None, None), (1, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in S.deduplicate(docs).collect())
    size = len(text.encode())
    assert got == sorted([(size, size)] * 2 + [(150, 0), (0, 0), (5, 0)])
    assert S.deduplicate(docs.limit(0)).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    texts = corpus(4)
    found = Counter()
    for rows, data, bounds, place in S.pieces(__import__("pyarrow").array(["".join(t or "" for t in texts)]), 200):
        text, first, count, _, _ = S.runs(data, bounds, 200, 56)
        for a, n, p in zip(first.tolist(), count.tolist(), place[text].tolist(), strict=True):
            found.update(range(a + p, a + p + n))
    size = len("".join(t or "" for t in texts).encode())
    assert set(found) == set(range(size - 199)) and set(found.values()) == {1}


def test_texts_and_batches_are_taken_in_small_parts(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"{i} " * 500 for i in range(4000)])
    parts = list(S.pieces(texts, 200))
    assert max(len(data) for _, data, _, _ in parts) <= 1 << 19 and sum(len(rows) for rows, *_ in parts) == 4000
    # hot anchors, their windows counted by slices of two runs
    monkeypatch.setattr(S, "COUNTED", 2)
    same = "".join(chr(97 + i * i % 23) for i in range(230))
    docs = spark.createDataFrame([(i, f"{i:03d}" * 30 + same + f"{i * 7:03d}" * 30) for i in range(12)], "doc_id long, text string")
    want = sorted(map(tuple, S.deduplicate(docs).collect()))
    assert sorted(map(tuple, S.deduplicate(docs, group=1).collect())) == want and all(r[2] >= 230 for r in want)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
