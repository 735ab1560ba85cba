from __future__ import annotations

import random

import pytest

from siltstone.operators import machines as M
from siltstone.streaming import state


def rows(seed, machine):
    rng = random.Random(seed)
    out = []
    for place in range(240):
        at = 1_700_000_000_000 + rng.choice([0, 500, 1000]) + 700 * place
        own = {"at": at, "place": place, "type": rng.choice(["PageDiscovered", "PageVisited", "PageFailed", "Other"]), "limited": rng.random() < 0.4, "retry_after_s": rng.choice([None, 0, 7]), "failed": rng.random() < 0.7}
        own |= {"queue_size": rng.choice([5, 5, 5, 5, 0]), "knowledge_size": 7 + (rng.random() < 0.03), "discovered": 9, "processed": 4 + (rng.random() < 0.03), "memory_rss": rng.choice([100, 101, 100, 0]), "active_workers": rng.choice([0, 1, 1, 1])}
        out.append((rng.choice(["a", "b", None]) if place % 3 else "hot", own))
    return out


def told(seed, machine):
    """Straight over the rows of each key in order."""
    out = []
    for key in ("hot", "a", "b", None):
        state = machine.start
        for _, row in sorted((x for x in rows(seed, machine) if x[0] == key), key=lambda x: (x[1]["at"], x[1]["place"])):
            state, more = machine.taken(state, row)
            out += [(key, *x) for x in more]
        out += [(key, *x) for x in machine.waits(state, None)[1]]
    return sorted(out, key=str)


def table(spark, seed, machine):
    names = [x.split()[0] for x in machine.columns.split(", ")]
    return spark.createDataFrame([(k, *(r[n] for n in names)) for k, r in rows(seed, machine)], "job string, " + machine.columns)


MACHINES = {"counters": M.counters(), "limiter": M.limiter(8, limits=4), "steady": M.limiter(8, adaptive=False), "verdict": M.verdict(), "retries": M.retries(2, (900, 2100, 4000))}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_fold_over_partitions(spark, name):
    machine = MACHINES[name]
    assert sorted(map(tuple, M.fold(table(spark, 1, machine).repartition(5), "job", machine).collect()), key=str) == told(1, machine)
    assert M.fold(table(spark, 1, machine).limit(0), "job", machine).count() == 0


@pytest.mark.parametrize("name", ["counters", "limiter", "retries", "verdict"])
def test_stream_tells_what_the_fold_tells_in_any_order(spark, tmp_path, name):
    machine = MACHINES[name]
    frame = table(spark, 2, machine)
    own = frame.collect()
    random.Random(5).shuffle(own)
    for i in range(3):  # three files in any order, a batch each
        spark.createDataFrame(own[i::3], frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda s: s.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = state.settled(spark, source, "job", machine)
    assert sorted(map(tuple, got.collect()), key=str) == told(2, machine)


def go(machine, steps):
    state, out = machine.start, []
    for n, step in enumerate(steps):
        state, more = machine.taken(state, {"place": n, **step})
        out += more
    return state, out


def test_counters_have_a_floor():
    _, out = go(M.counters(), [{"at": i, "type": t} for i, t in enumerate(["PageVisited", "PageFailed", "PageDiscovered", "PageParsed", "PageVisited", "PageVisited"])])
    assert [x[2:] for x in out] == [(0, 1, 0, 0), (0, 1, 1, 0), (1, 1, 1, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, 0)]


def test_workers_waits_and_rests():
    limited, fine = {"limited": True, "retry_after_s": None}, {"limited": False, "retry_after_s": None}
    _, out = go(M.limiter(8), [{"at": i * 100, **x} for i, x in enumerate([limited] * 3 + [fine] * 9)])
    assert [x[2] for x in out] == [4, 2, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8] and [x[3] for x in out] == [1000, 2000, 4000, 4000, 4000, 4000, 4000, 4000, 2000, 1000, 1000, 1000]
    _, out = go(M.limiter(8, adaptive=False), [{"at": 0, **x} for x in [limited] * 2 + [fine] * 9])
    assert [x[2] for x in out] == [7] + [6] * 10
    _, out = go(M.limiter(64), [{"at": i * 1000, **limited} for i in range(12)] + [{"at": 12_000 + i, **fine} for i in range(5)] + [{"at": 9000 + 67_500, **fine}])
    assert [x[4] for x in out][8:] == [0] + [9000 + 67_500] * 9 and [x[2] for x in out][-3:] == [1, 1, 2]
    assert go(M.limiter(4), [{"at": 0, "limited": True, "retry_after_s": 9}])[1][0][3] == 9000


def test_verdicts():
    sample = lambda q=5, k=5, d=5, p=5, m=100, w=1: {"queue_size": q, "knowledge_size": k, "discovered": d, "processed": p, "memory_rss": m, "active_workers": w}
    words = lambda xs: [x[2] for x in go(M.verdict(), [{"at": i, **x} for i, x in enumerate(xs)])[1]]
    assert words([sample()] * 14) == ["continue"] * 3 + ["pause_discovery"] * 9 + ["exhausted"] * 2
    assert words([sample(q=i + 1, k=i, d=i, p=i) for i in range(4)] + [sample(q=0, w=0)]) == ["continue"] * 4 + ["complete"]
    assert words([sample(q=0, w=0)]) == ["continue"]
    # new knowledge ends the pause, and the count begins anew
    assert words([sample()] * 5 + [sample(k=6)] * 4) == ["continue"] * 3 + ["pause_discovery"] * 2 + ["continue"] * 3 + ["pause_discovery"]
    # blocked workers are not stable, but stagnant all the same
    assert words([sample(w=0)] * 4)[-1] == "pause_discovery"
    # a queue that moves is stagnant while nothing is learnt; memory does not matter for that
    assert words([sample(q=9 - i, m=100 * (i + 1)) for i in range(4)])[-1] == "pause_discovery"


def test_retries_fall_due():
    fail, good = {"failed": True}, {"failed": False}
    machine = M.retries(2, (100, 1000))
    state, out = go(machine, [{"at": 0, **fail}, {"at": 50, **fail}, {"at": 60, **fail}, {"at": 70, **fail}, {"at": 80, **good}, {"at": 170, **good}])
    assert out == [(60, 2, "failed", 3), (170, 3, "due", 1)] and machine.waits(state, None)[1] == []
    state, out = go(machine, [{"at": 0, **fail}, {"at": 100, **good}])
    assert out == [(100, 0, "due", 1)]
