"""Text quality without given labels: weak labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text.  Documents with
equal votes are counted together by Spark, so at most 3 ** LABELLERS counts of
votes stand for all documents; from them expectation-maximisation estimates
how often each labeller votes what on good and on bad texts, and the posterior
of each combination of votes.  It starts from the majority of votes, and a prior
of PRIOR texts, whatever the size of the corpus, only keeps rates from 0.
The posteriors are the labels on which a logistic model over hashed byte
trigrams alone is trained, on at most SAMPLE documents and ENTRIES of their
trigrams (those with the smallest hash of their doc_id first); it never sees a vote,
so it also tells texts on which the labellers say nothing.
Every text is then scored whole.

Edge cases: a null or empty text has no words and no trigrams; a text without
trigrams gets the posterior of its votes as score; repeated rows are scored
alike; with votes of only one kind the scores follow the posteriors; very long
texts are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import prefix_hash, span_hash, text_slices, words
from siltstone.llm.shared import settle

SAMPLE = 20_000
BUCKETS = 1 << 16
SCALE = 50.0
EPOCHS = 6
GOOD, BAD, NONE = 2, 1, 0
THRESHOLD = 0.5
#: Texts that the prior stands for, and its rates of no vote, bad and good votes on bad and on good texts.
PRIOR = 2.0
RATES = np.array([[0.3, 0.5, 0.2], [0.3, 0.05, 0.65]])
ENTRIES = 40_000_000

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>{}[]=~^\\"]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3:] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
CLOSES = np.zeros(256, dtype=bool)
CLOSES[[ord(c) for c in ".!?:;\"')"]] = True

#: Name, what is measured; bad above, good below (or the other way round where ``bad`` is smaller).
LABELLERS = (
    ("symbols per word", 0.3, 0.03),
    ("capitals among letters", 0.4, 0.15),
    ("lines said before", 0.3, 0.05),
    ("three-word windows said before", 0.3, 0.05),
    ("words said twice in a row", 0.15, 0.02),
    ("exclamation marks per word", 0.2, 0.02),
    ("lines with a closing sign", 0.25, 0.6),
    ("words without a letter", 0.25, 0.05),
    ("words that end in a symbol", 0.25, 0.03),
    ("words", 8.0, 40.0),
)

WEIGHTS = BUCKETS + 1


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A column for each labeller, a row for each text of a slice."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    n_words = np.bincount(rows, minlength=n)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    per_text = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    ratio = lambda x, y: x / np.maximum(y, 1)
    letters = total(LETTER[data])
    prefix = prefix_hash(data.astype(np.uint64) + np.uint64(1))

    def again(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Of each text, how many hashes are equal to an earlier one."""
        order = np.lexsort((hashes, own))
        same = (own[order][1:] == own[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        return np.bincount(own[order][1:][same], minlength=n)

    hashes = span_hash(prefix, starts, ends)
    full = np.flatnonzero(rows[:-2] == rows[2:]) if len(rows) > 2 else np.zeros(0, np.int64)
    windows = span_hash(prefix_hash(hashes), full, full + 3)
    twice = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    # a line is from its first word to its last
    new = np.ones(len(starts), dtype=bool)
    if len(starts):
        breaks = total(data == 10)
        new[1:] = (rows[1:] != rows[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    n_lines = np.bincount(rows[first], minlength=n)
    closed = np.bincount(rows[first][CLOSES[data[ends[last] - 1]]] if len(first) else first, minlength=n)
    return np.column_stack(
        [
            ratio(per_text(total(SYMBOL[data])), n_words),
            ratio(per_text(total(UPPER[data])), per_text(letters)),
            ratio(again(rows[first], span_hash(prefix, starts[first], ends[last])), n_lines + 2),
            ratio(again(rows[full], windows), n_words + 20),
            ratio(np.bincount(rows[1:][twice], minlength=n) if len(rows) else np.zeros(n), n_words),
            ratio(per_text(total(data == 33)), n_words),
            np.where(n_lines > 0, ratio(closed, n_lines), 1.0),
            ratio(np.bincount(rows[letters[ends] == letters[starts]] if len(rows) else rows, minlength=n), n_words),
            ratio(np.bincount(rows[SYMBOL[data[ends - 1]]] if len(rows) else rows, minlength=n), n_words),
            n_words,
        ]
    ).astype(np.float64)


def votes(measured: np.ndarray) -> np.ndarray:
    """What each labeller says of each text."""
    out = np.zeros(measured.shape, dtype=np.int64)
    for j, (_, bad, good) in enumerate(LABELLERS):
        x = measured[:, j]
        up = bad > good
        out[:, j] = np.where(x > bad if up else x < bad, BAD, np.where(x <= good if up else x >= good, GOOD, NONE))
    # a text without words says nothing of its words
    empty = measured[:, -1] == 0
    out[empty, :-1] = NONE
    return out


def pattern_of(said: np.ndarray) -> np.ndarray:
    return said @ 3 ** np.arange(len(LABELLERS))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def accuracies(said: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over combinations of votes: P(vote | class) as (class, labeller, vote), and P(good).

    Starts from the share of good votes among all, which also names the classes.
    """
    hot = (said[:, :, None] == np.arange(3)).astype(float)
    good = ((said == GOOD).sum(1) + 1.0) / ((said != NONE).sum(1) + 2.0)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.einsum("ci,ijv->cjv", weight, hot) + PRIOR * RATES[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + PRIOR / 2) / (weight.sum() + PRIOR)
        new = posterior(said, table, share)
        if not len(said) or np.abs(new - good).max() < 1e-9:
            break
        good = new
    return table, share


def posterior(said: np.ndarray, table: np.ndarray, share: float) -> np.ndarray:
    logs = np.log(table)[:, np.arange(said.shape[1]), said].sum(axis=2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log(1 - share) - np.log(share), -500, 500)))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether it lies inside one text."""
    n = len(data)
    if n < 3:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    code = np.zeros(n, dtype=np.uint32)
    code[:-2] = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << 8) | (data[2:].astype(np.uint32) << 16)
    inside = np.ones(n + 2, dtype=bool)
    inside[offsets[1:] - 1] = inside[offsets[1:] - 2] = False
    return ((code * np.uint32(2_654_435_761)) >> np.uint32(16)).astype(np.int64), inside[:n]


def fit(samples: list[tuple[np.ndarray, np.ndarray, float]], size: int) -> np.ndarray:
    """Logistic weights (the last one is the constant) by Adagrad over (buckets, shares of the text, label)."""
    w, square = np.zeros(size), np.full(size, 1e-2)
    order = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for i in order.permutation(len(samples)):
            at, x, y = samples[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x * SCALE + w[-1], -30, 30)))
            g = (p - y) * x * SCALE + 1e-5 * w[at]
            square[at] += g * g
            w[at] -= 0.1 * g / np.sqrt(square[at])
            square[-1] += (p - y) ** 2
            w[-1] -= 0.1 * (p - y) / np.sqrt(square[-1])
    return w


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def learn(docs: DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    """Labellers' table, the share of good texts, and the scorer's weights."""
    spark = docs.sparkSession

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern_of(votes(measures(data, offsets))))], ["doc_id", "pattern"])

    seen = settle(_texts(docs).mapInArrow(look, "doc_id long, pattern long"), "votes")
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # 3 ** LABELLERS rows at most
    said, counts = votes_of(np.array([r.pattern for r in counted], dtype=np.int64)), np.array([r.n for r in counted], dtype=float)
    table, share = accuracies(said, counts)
    chosen = settle(seen.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id"), "sample_ids")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for batch in batches:  # in order of the hash
            for at, x, label in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                if held > ENTRIES:
                    break
                at = np.frombuffer(at.as_buffer(), np.uint32).astype(np.int32)
                held += len(at)
                samples.append((at, np.frombuffer(x.as_buffer(), np.float32).copy(), label.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([fit(samples, WEIGHTS).tobytes()], pa.binary())], ["weights"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                label = posterior(votes(measures(data, offsets)), table, share)
                bucket, inside = trigrams(data, offsets)
                at, x = [], []
                for r in range(b - a):
                    own = bucket[offsets[r] : offsets[r + 1]][inside[offsets[r] : offsets[r + 1]]]
                    found, many = np.unique(own, return_counts=True)
                    at.append(found.astype(np.uint32).tobytes())
                    x.append((many / max(len(own), 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(at, pa.binary()), pa.array(x, pa.binary()), pa.array(label)], ["doc_id", "at", "x", "label"])

    # at most SAMPLE rows and about ENTRIES of their entries are held in one task
    sample = _texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, at binary, x binary, label double")
    found = settle(sample, "sample_features").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label", "at").mapInArrow(train, "weights binary").collect()
    return table, share, np.frombuffer(found[0].weights) if found else np.zeros(WEIGHTS)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, posterior of the votes, score (probability of good quality) and kept of each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, share, w = sent.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                after = posterior(votes(measures(data, offsets)), table, share)
                bucket, inside = trigrams(data, offsets)
                value = np.concatenate([[0.0], np.cumsum(np.where(inside, w[bucket], 0.0))])
                count = np.concatenate([[0], np.cumsum(inside)])
                n = count[offsets[1:]] - count[offsets[:-1]]
                z = (value[offsets[1:]] - value[offsets[:-1]]) / np.maximum(n, 1) * SCALE + w[-1]
                out = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), after)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(after), pa.array(out), pa.array(out >= THRESHOLD)], ["doc_id", "posterior", "score", "kept"])

    return _texts(docs).mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")
