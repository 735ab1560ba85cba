from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import whitening as W
from siltstone.llm.queries import QUERIES


def numbers(n, d, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3 * rng.normal(size=d)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.integers(0, 99))
def test_merging_gives_the_moments_of_all(sizes, seed):
    x = np.floor(1024 * numbers(sum(sizes), 5, seed)).astype(np.int64) + 100_000
    parts = [W.moments(p) for p in np.split(x, np.cumsum(sizes)[:-1])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    apart = x - x.mean(axis=0)
    assert whole.n == len(x) and whole.sums == x.sum(axis=0).tolist()
    np.testing.assert_allclose(whole.mean, x.mean(axis=0), rtol=1e-13)
    np.testing.assert_allclose(whole.scatter, apart.T @ apart, rtol=1e-9, atol=1e-5)


def brute(rows, grid=W.GRID, most=8):
    """rows: (vec_id, vector); the columns by (vec_id, component)."""
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(grid[0] * float(c))) + grid[1] for c in v] for _, v in used], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    values, columns = np.linalg.eigh(np.cov(x.astype(float).T, ddof=0))
    order = np.argsort(-values)[:most]
    out = {}
    for (i, _), row in zip(used, x, strict=True):
        for k, c in enumerate(order.tolist()):
            score = float((row - sums / n).astype(float) @ columns[:, c]) / values[c] ** 0.5
            out[i, k + 1] = (n, sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), score, values[c] / values.sum())
    return out


def held(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs: dict[int, set] = {}
    for r in got:
        n, deviation, score, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-8) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(score), rel=1e-6, abs=1e-7)
        if abs(score) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(score))
    assert all(len(s) == 1 for s in signs.values())


def test_query_matches_brute_force_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    held(QUERIES["op13_whitening"](spark, folder).collect(), brute(rows))


def test_unusable_vectors_ties_and_other_columns(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(numbers(40, 3, 7))]
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [1.0, 2.0, float("inf")], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").repartition(5)
    held(W.whiten(df, grid=W.GRID).collect(), brute([r[:2] for r in rows]))
    # other lengths and empty vectors go; rows that repeat an id count each; a null id stays
    more = spark.createDataFrame([(200, [1.0, 2.0], 1), (201, [], 1), (0, [0.5, 0.25, 9.0], 1), (None, [1.5, 0.25, 3.0], 1)], df.schema)
    got = W.whiten(df.unionByName(more), grid=W.GRID).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {42} and sum(r.vec_id == 0 for r in got) == 6 and sum(r.vec_id is None for r in got) == 3


def test_nothing_varies_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = W.whiten(df, grid=W.GRID).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(2, 0, None, None, None)}
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id > 5").repartition(3)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = W.whiten(flat, grid=W.GRID).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(r.identity_error < 1e-9 for r in got)


def test_huge_entries_and_deviations_past_64_bits(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    got = W.whiten(df, grid=W.GRID).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3) and all(r.n == 3 for r in got)


def test_a_large_common_offset_costs_no_digits(spark):
    x = numbers(300, 4, 3)
    df = spark.createDataFrame([(i, (v + 1e6).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    model = W.fit(df)
    np.testing.assert_allclose(model.variance, np.sort(np.linalg.eigvalsh(np.cov((x + 1e6).T, ddof=0)))[::-1], rtol=1e-6)
    assert W.verify(df, model) < 1e-8
    got = np.array([[r.whitened for r in W.whiten(df).where(f"component = {k}").orderBy("vec_id").collect()] for k in range(1, 5)])
    np.testing.assert_allclose(np.cov(got, ddof=0), np.eye(4), atol=1e-8)
