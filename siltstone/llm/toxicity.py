"""Toxic passages by maximum-scoring segments over smoothed token log-odds.

A token is a lower-cased word without edge punctuation, backed off to its
prefixes of a few bytes.  Each unit's weight is its log-odds between toxic and
clean labelled documents under an informative Dirichlet prior (the pooled
frequencies), shrunk to the near end of its confidence interval.  A position
scores the weight of its longest unit that has one, less a small toll.  A
linear-time scan finds all maximal scoring segments of a text.  Clean training
texts give the Karlin-Altschul decay ``lam`` and the location of the extreme
value distribution of the best segment; a logistic curve over its log p-value
and the excess of all segments gives the score.

Labels are used only from training rows: at most LABELLED of them, those with
the smallest hash of their doc_id, sent to all tasks (a bounded table).
PRIOR and SURE were chosen by cross-validation over four parts of the training
rows (the remainders 0, 1 and 3 of the split), see cross_validate(); no held-out row was looked at.
All other work covers every text.

Edge cases: null and empty texts have no token and get the score of a text
without segments; repeated rows are scored alike; labels that repeat a doc_id
count once (the highest); without labels of both kinds all scores are 0; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import LOWER, prefix_hash, span_hash, text_slices, words
from siltstone.llm.shared import settle

LABELLED = 50_000
BUCKET_BITS = 20
PREFIXES = (7, 6, 5, 4)
PRIOR = 500.0
SURE = 4.0
TOLL = 0.05
THRESHOLD = 0.3
STEP = 0.05
GRID = np.arange(-12.0, 12.0, 0.05)
GAMMA = 0.5772156649

EDGE = np.zeros(256, dtype=bool)
EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>|*#$%&~_-+=/\\"]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Row of each token, its buckets from the word to its shortest prefix, and the words' starts and ends."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        b -= (b - 1 > a) & EDGE[low[np.maximum(b - 1, 0)]]
        a += (b - 1 > a) & EDGE[low[a]] if len(a) else 0
    prefix = prefix_hash(low.astype(np.uint64) + np.uint64(1))
    shift = np.uint64(64 - BUCKET_BITS)
    found = [(span_hash(prefix, a, b) >> shift).astype(np.int64)]
    for k in PREFIXES:
        found.append(np.where(b - a >= k, (span_hash(prefix, a, np.minimum(a + k, b)) >> shift).astype(np.int64), -1))
    return rows, found, starts, ends


def segments(rows: np.ndarray, scores: np.ndarray, n: int) -> list[list[tuple[float, int, int]]]:
    """All maximal scoring segments (score, first token, token past the last) of each of n rows, in linear time."""
    out: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    owner, left, right = rows[at].tolist(), total[at].tolist(), total[at + 1].tolist()
    at = at.tolist()
    i = 0
    while i < len(at):
        row, stack = owner[i], []  # (left sum, right sum, first, past, index of the nearest earlier one with a smaller left sum)
        while i < len(at) and owner[i] == row:
            own = (left[i], right[i], at[i], at[i] + 1)
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= own[0]:
                    j = stack[j][4]
                if j < 0 or stack[j][1] >= own[1]:
                    stack.append((*own, j))
                    break
                own = (stack[j][0], own[1], stack[j][2], own[3])
                del stack[j:]
            i += 1
        out[row] = [(b - a, x, y) for a, b, x, y, _ in stack]
    return out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BUCKET_BITS, dtype=np.float32))
    lam: float = 1.0
    location: float = 0.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        out = self.weights[found[0]].astype(np.float64)
        for unit in found[1:]:
            out = np.where((out == 0) & (unit >= 0), self.weights[unit], out)
        return out - TOLL

    def evidence(self, n_tokens: int, own: list[float]) -> tuple[float, float]:
        """The negative log p-value of the best segment, and the summed excess of all."""
        if not own:
            return 0.0, 0.0
        excess = [self.lam * s - math.log(n_tokens + 1.0) - self.location for s in own]
        best = max(excess)
        tail = math.exp(-min(best, 700.0)) if best > -20 else math.exp(20)
        p = -math.expm1(-tail)
        return min(-math.log(max(p, 1e-300)), 60.0), min(sum(x for x in excess if x > 0), 200.0)

    def score(self, n_tokens: int, own: list[float]) -> float:
        z, total = self.evidence(n_tokens, own)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-min(max(a + b * z + c * math.log1p(total), -500.0), 500.0)))


def training(labels: DataFrame) -> DataFrame:
    """At most LABELLED labelled rows (doc_id, toxic) that may be learned from."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    return own.where(F.col("doc_id").cast("string").isNotNull() & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket, by label."""
    held = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int32)
    for batch in batches:
        toxic = np.array(batch.column(2).to_pylist(), dtype=np.int64)
        for a, _, data, offsets in text_slices(batch.column(1)):
            rows, found, _, _ = units(data, offsets)
            for unit in found:
                there = unit >= 0
                pairs = np.unique((rows[there] << BUCKET_BITS) | unit[there])
                label = toxic[a + (pairs >> BUCKET_BITS)]
                for y in (0, 1):
                    held[y] += np.bincount(pairs[label == y] & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS).astype(np.int32)
    some = np.flatnonzero(held.any(axis=0))
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[1, part].astype(np.int64)), pa.array(held[0, part].astype(np.int64))], ["bucket", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    model = Model()
    chosen = settle(training(labels), "toxic_labels")
    own = _texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    counts = settle(own.mapInArrow(_counts, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic_counts")
    y1, y0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not y1 or not y0:
        return model
    prior = F.lit(PRIOR / (y1 + y0)) * (F.col("toxic") + F.col("clean"))
    ones, zeros = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(ones / (y1 + PRIOR - ones)) - F.log(zeros / (y0 + PRIOR - zeros))
    near = F.abs("delta") - SURE * F.sqrt(1 / ones + 1 / zeros)
    weighted = counts.withColumn("delta", delta).withColumn("near", near).where("near > 0").select("bucket", (F.signum("delta") * F.col("near")).alias("weight"))
    rows = weighted.toArrow()  # a row for each bucket at most, of which there is a fixed number
    model.weights[rows.column("bucket").to_numpy()] = rows.column("weight").to_numpy()
    weights = spark.sparkContext.broadcast(model.weights)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(weights.value)
        for batch in batches:
            toxic, n_tokens, best, bins = batch.column(2).to_pylist(), [], [], np.zeros(len(GRID), dtype=np.int64)
            for a, b, data, offsets in text_slices(batch.column(1)):
                rows, found, _, _ = units(data, offsets)
                scores = scorer.scores(found)
                clean = np.array(toxic[a:b])[rows] == 0
                bins += np.bincount(np.clip(((scores[clean] - GRID[0]) / 0.05 + 0.5).astype(np.int64), 0, len(GRID) - 1), minlength=len(GRID))
                n_tokens += np.bincount(rows, minlength=b - a).tolist()
                best += [[s for s, _, _ in own] for own in segments(rows, scores, b - a)]
            n = len(toxic)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array([bins.tolist()] * bool(n) + [None] * max(0, n - 1), pa.list_(pa.int64()))], ["toxic", "n_tokens", "own", "bins"]
            )

    seen = settle(own.mapInArrow(measured, "toxic int, n_tokens long, own array<double>, bins array<long>"), "toxic_measures")
    spread = np.zeros(len(GRID))
    for r in seen.select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        spread[r.pos] = r.n
    model.lam = decay(spread)
    excess = F.lit(model.lam) * F.array_max("own") - F.log(F.col("n_tokens") + 1.0)
    middle = seen.where((F.col("toxic") == 0) & (F.size("own") > 0)).agg(F.percentile(excess, 0.5)).first()[0]
    model.location = 0.0 if middle is None else middle + math.log(math.log(2.0))
    lam, location = model.lam, model.location

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(lam=lam, location=location)
        for batch in batches:
            found = np.array([scorer.evidence(n, own) for n, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.rint(found[:, 0] / STEP).astype(np.int32)), pa.array(np.rint(np.log1p(found[:, 1]) / STEP).astype(np.int32))], ["toxic", "z", "total"])

    # evidence is bounded, so in steps there are 1201 * 107 * 2 rows at most
    grid = seen.select("toxic", "n_tokens", "own").mapInArrow(facts, "toxic int, z int, total int").groupBy("toxic", "z", "total").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "z", "total").toArrow()
    column = lambda c: grid.column(c).to_numpy().astype(float)
    model.curve = logistic(np.column_stack([np.ones(len(grid)), column("z") * STEP, column("total") * STEP]), column("toxic"), column("n"))
    return model


def decay(spread: np.ndarray) -> float:
    """The positive root of sum(p * exp(lam * score)) = 1; scores drift down on clean text."""
    p = spread / max(spread.sum(), 1)
    if not (p[GRID > 0].sum() > 0) or (p * GRID).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda t: float((p * np.exp(np.minimum(t * GRID, 600))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small ridge, over rows that stand for ``n`` documents each; slopes are kept from turning negative."""
    if not y.any() or y.all():
        return (-30.0, 0.0, 0.0)
    w, free = np.zeros(3), np.array([True, True, True])
    for _ in range(3):
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (y - p)) - 1e-2 * w
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            step = np.zeros(3)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w += np.clip(step, -5, 5)
        bad = free & (w < 0) & np.array([False, True, True])
        if not bad.any():
            break
        free &= ~bad
    w[~free] = 0
    return tuple(map(float, w))


def passages(docs: DataFrame, model: Model, e_value: float = 0.01) -> DataFrame:
    """Score of each row of ``docs`` (doc_id, text), and its significant passages in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                rows, found, starts, ends = units(data, offsets)
                n_tokens = np.bincount(rows, minlength=b - a)
                every = segments(rows, scorer.scores(found), b - a)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                score, spans = [], []
                for r, own in enumerate(every):
                    score.append(scorer.score(int(n_tokens[r]), [s for s, _, _ in own]))
                    limit = (math.log(n_tokens[r] + 1.0) + scorer.location - math.log(e_value)) / scorer.lam
                    base = chars[offsets[r]]
                    kept = [(int(chars[starts[x]] - base), int(chars[ends[y - 1]] - base)) for s, x, y in own if s > limit]
                    spans.append([{"begin": x, "end": y} for x, y in kept])
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<begin: long, end: long>>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of each row of ``docs``."""
    found = passages(docs, learn(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def cross_validate(docs: DataFrame, labels: DataFrame, parts: int = 4) -> float:
    """Mean log loss of the labelled training rows, each part scored by a model of the others; rows held out are not read."""
    rows = training(labels).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)))
    loss, n = 0.0, 0
    for part in range(parts):
        model = learn(docs, rows.where(F.col("part") != part).select("doc_id", "toxic"))
        own = rows.where(F.col("part") == part)
        p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
        found = passages(docs.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"), model).join(F.broadcast(own), "doc_id")
        total, count = found.agg(F.sum(-F.when(F.col("toxic") == 1, F.log(p)).otherwise(F.log(1 - p))), F.count(F.lit(1))).first()
        loss, n = loss + (total or 0.0), n + count
    return loss / max(n, 1)
