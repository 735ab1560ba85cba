"""Language-model scores of whole texts: a word unigram base, and a causal self-attention model over subwords.

One pass over the training documents counts words and pairs of subword ids,
and cuts every text into windows, which all train the model; all of it grows with the
corpus and is summed by Spark.  The attention model starts from the pair
counts and is trained in rounds: workers of about WORKER_WINDOWS windows train
on a part of theirs, and their weights are averaged by a tree of sums.  How many workers
there are, and which windows each has, follows from the windows alone, so scores
do not depend on the cluster.  A second pass scores every text:
windows of ids overlap, each id is scored once, attention is masked and
batched.

Word counts are looked up in two ways: the words of the highest counts, at
most HEAD_WORDS of them, go to all tasks; the others are joined by hash.  Both
give the same counts.  Words are known by 64-bit hashes.

The model's text is the words in order, each after one space, and the end.

Edge cases: a null or empty text is the end alone; without training documents
all counts are 0; a row without doc_id is scored and not learned from; repeated
rows are scored alike; texts of any length are scored whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import attention as A
from siltstone.llm.bytetext import LOWER, mix, prefix_hash, span_hash, text_slices, words
from siltstone.llm.shared import discard, settle
from siltstone.llm.subwords import Memory

HEAD_WORDS = 1 << 19
SHARE = 1  # every window trains
RATES = (0.03, 0.02, 0.01, 0.003)  # one round each
WORKER_WINDOWS = 1 << 16
BATCH = 64
COPIES = 1024
CACHE_WORDS = 500_000
PARTS = 16
FLUSH = 2_000_000
END_CODE, START_CODE, PAD = 50_257, 50_258, 65_535
WORD, PAIR, TRAIN, TEXTS = 0, 1, 2, 3
LOG10 = np.log(10.0)
_encoder: dict[str | None, WordIds] = {}


def white(data: np.ndarray) -> np.ndarray:
    """Where white space of more than one byte starts in UTF-8 (the pattern of pieces knows it, words are not cut at it)."""
    out = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        out[:-1] = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        for lead, second, thirds in ((0xE1, 0x9A, [0x80]), (0xE2, 0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0xE2, 0x81, [0x9F]), (0xE3, 0x80, [0x80])):
            at = np.flatnonzero((a == lead) & (b == second))
            at = at[at + 2 < len(data)]
            out[at[np.isin(data[at + 2], thirds)]] = True
    return out


class WordIds(Memory):
    """Subword ids of whole words, each with a space before it."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # ids whose bytes begin with a space
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, distinct: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.forget()
        known, raw = self.known, low.tobytes()
        out = np.array([known.get(k, -1) for k in distinct.tolist()], dtype=np.int64)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        begin, stop = starts[first[new]], ends[first[new]]
        odd = np.zeros(len(low) + 1, dtype=np.int32)
        np.cumsum(white(low), out=odd[1:])
        odd = odd[stop] > odd[begin]
        # words without white space, in one text: a piece never spans the space between two of them
        plain = np.flatnonzero(~odd)
        size = stop[plain] - begin[plain] + 1
        at = np.cumsum(size) - size
        joined = np.take(low, np.arange(int(size.sum())) + np.repeat(begin[plain] - 1 - at, size), mode="clip")
        joined[at] = 32
        ids = np.array(self.encoding.encode_ordinary(joined.tobytes().decode("utf-8", "replace")), dtype=np.int32)
        out[new[plain]] = self._add_all(distinct[new[plain]], ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids)))
        odd = np.flatnonzero(odd)
        for i, a, b in zip(new[odd].tolist(), begin[odd].tolist(), stop[odd].tolist(), strict=True):
            out[i] = self._add(int(distinct[i]), self.encoding.encode_ordinary(" " + raw[a:b].decode("utf-8", "replace")))
        return out

    def _add_all(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Adds many pieces, whose ids are joined; gives their numbers."""
        k, n = len(self.known), len(keys)
        if len(size) != n:
            raise ValueError(f"{n} words came to {len(size)}")
        if k + n > len(self.at):
            more = np.zeros(max(len(self.at), n), np.int64)
            self.at, self.size = np.concatenate([self.at, more]), np.concatenate([self.size, more])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[k : k + n], self.size[k : k + n] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.known.update(zip(keys.tolist(), range(k, k + n), strict=True))
        return np.arange(k, k + n)


def word_ids(ranks_path: str | None) -> WordIds:
    """One encoder for each worker."""
    if ranks_path not in _encoder:
        import public_tokenizers

        _encoder[ranks_path] = WordIds(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _encoder[ranks_path]


def read(data: np.ndarray, offsets: np.ndarray, coder: WordIds) -> tuple[np.ndarray, ...]:
    """Of a slice of texts: row and distinct-word number of each word, distinct hashes and counts, ids with END_CODE after each text, and their bounds."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    hashes = span_hash(prefix_hash(low.astype(np.uint64) + np.uint64(1)), starts, ends)
    coded = pa.array(hashes).dictionary_encode()
    inverse, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
    counts, first = np.bincount(inverse, minlength=len(distinct)), np.zeros(len(distinct), np.int64)
    first[inverse] = np.arange(len(inverse))  # any place of each word
    ids, size = coder.ragged(coder.numbers(low, starts, ends, distinct, first)[inverse])
    filled = np.concatenate([[0], np.cumsum(size)])
    bounds = filled[np.searchsorted(rows, np.arange(n + 1))]
    ids = np.insert(ids, bounds[1:], END_CODE).astype(np.uint16)
    return rows, inverse, distinct, counts, ids, bounds + np.arange(n + 1)


def _pairs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (before * 2**16 + next) of the pairs in some texts, and their counts."""
    used = np.zeros(1 << 16, dtype=bool)
    used[ids] = used[START_CODE] = True
    there = np.flatnonzero(used)
    m = len(there)
    small = np.cumsum(used) - 1
    own = np.take(small, ids)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[bounds[:-1]] = small[START_CODE]
    before *= m
    before += own
    if m > 4000:
        found, counts = np.unique(before, return_counts=True)
    else:
        counts = np.bincount(before, minlength=m * m)
        found = np.flatnonzero(counts)
        counts = counts[found]
    return (there[found // m] << 16) | there[found % m], counts


def _windows(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The windows of some texts, one a row; with SHARE over 1 one in SHARE, by a hash of the place and what is there.

    A text is cut at an offset of its own, so the windows at its ends may be
    partial (padded with PAD); each id, the end too, is in one window.
    """
    size = np.diff(bounds)
    chain = prefix_hash(ids.astype(np.uint64) + np.uint64(1))
    offset = (mix(span_hash(chain, bounds[:-1], bounds[1:])) % np.uint64(A.WINDOW)).astype(np.int64)
    early = offset > 0
    count = early + np.maximum(0, -(-(size - offset) // A.WINDOW))
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = offset[text] + (number - early[text]) * A.WINDOW
    start, stop = bounds[text] + np.maximum(place, 0), bounds[text] + np.minimum(place + A.WINDOW, size[text])
    if SHARE > 1:
        key = mix(span_hash(chain, start, stop) + (number.astype(np.uint64) << np.uint64(33)) + (size[text].astype(np.uint64) << np.uint64(40)))
        chosen = np.flatnonzero(key % np.uint64(SHARE) == 0)
        start, stop, number = start[chosen], stop[chosen], number[chosen]
    # each with the id before it; what lies behind a text's end is padding
    padded = np.concatenate([[START_CODE], ids, np.full(A.WINDOW, PAD)]).astype("<u2")
    out = np.lib.stride_tricks.sliding_window_view(padded, A.WINDOW + 1)[start]
    out[number == 0, 0] = START_CODE
    partial = np.flatnonzero(stop - start < A.WINDOW)
    out[partial] = np.where(np.arange(A.WINDOW + 1) > (stop - start)[partial, None], PAD, out[partial])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.strides[0])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _rows(column: pa.Array) -> np.ndarray:
    """Windows that _binary() has made bytes of."""
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(data, "<u2", len(column) * (A.WINDOW + 1), first).reshape(-1, A.WINDOW + 1)


def gather(docs: DataFrame, ranks_path: str | None) -> DataFrame:
    """Counts of words and of id pairs, training windows, and numbers of texts, as (kind, key, n, ids)."""

    def rows_of(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.binary())], ["kind", "key", "n", "ids"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, texts = word_ids(ranks_path), 0
        held: dict[int, list] = {WORD: [], PAIR: []}
        size = {WORD: 0, PAIR: 0}
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(0)):
                texts += b - a
                _, _, distinct, counts, ids, bounds = read(data, offsets, coder)
                for kind, part in ((WORD, (distinct.view(np.int64), counts)), (PAIR, _pairs(ids, bounds))):
                    held[kind].append(part)
                    size[kind] += len(part[0])
                    if size[kind] > FLUSH:
                        held[kind] = [merged(held[kind])]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > FLUSH // 2:
                            yield rows_of(kind, *held[kind][0])
                            held[kind], size[kind] = [], 0
                own = _windows(ids, bounds)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TRAIN, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), _binary(own)], ["kind", "key", "n", "ids"])
        for kind, parts in held.items():
            if parts:
                yield rows_of(kind, *merged(parts))
        yield rows_of(TEXTS, np.zeros(1, np.int64), np.array([texts]))

    return docs.select("text").mapInArrow(run, "kind int, key long, n long, ids binary")


def class_of_code(class_of: np.ndarray) -> np.ndarray:
    return np.concatenate([class_of, [A.END, A.START]]).astype(np.int16)


def start_model(raw: DataFrame) -> A.Model:
    """Classes and biases from the counts of id pairs."""
    pairs = raw.where(F.col("kind") == PAIR)
    counts = np.zeros(1 << 16)
    for r in pairs.groupBy((F.col("key") % 65_536).cast("int").alias("id")).agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary at most
        counts[r.id] = r.n
    class_of, other = A.classes(counts[: A.VOCABULARY])
    codes = class_of_code(class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((A.CLASSES + 1) * A.CLASSES)
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = codes[key >> 16].astype(np.int64) * A.CLASSES + codes[key & 65_535]
            held += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=len(held))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found].astype(np.int64))], ["at", "n"])

    summed = pairs.select("key", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each pair of classes at most
    table = np.zeros((A.CLASSES + 1) * A.CLASSES)
    table[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    table = table.reshape(A.CLASSES + 1, A.CLASSES)
    model = A.Model(class_of, other, *A.biases(table))
    model.weights["E"] = A.start_embedding(table)
    return model


def numbered(windows: DataFrame) -> DataFrame:
    """Each window with ``copy``, its number among equal ones; at most COPIES rows of one window are made in a task."""
    counted = windows.groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    few = counted.where(F.col("n") <= COPIES).select("ids", F.explode(F.sequence(zero, F.col("n") - 1)).alias("copy"))
    parts = counted.where(F.col("n") > COPIES).withColumn("at", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.repartition(F.xxhash64("ids", "at"))
    return few.unionByName(parts.select("ids", F.explode(F.sequence("at", F.least(F.col("at") + COPIES, "n") - 1)).alias("copy")))


def train(model: A.Model, every: DataFrame) -> None:
    """Rounds of local training on the workers' windows (ids, copy); weights are averaged by how many windows each worker had."""
    spark = every.sparkSession
    codes = class_of_code(model.class_of)
    places = mix(np.arange(1, A.WINDOW + 2))
    workers = 1 + every.count() // WORKER_WINDOWS
    fan = int(np.ceil(np.sqrt(workers)))
    for turn, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [_rows(batch.column(0)) for batch in batches if batch.num_rows]
            if not got:
                return
            seen = np.concatenate(got)
            # by a hash of what they hold: windows of one text stand apart, and the order of arrival does not matter
            seen = seen[np.argsort(mix(seen.astype(np.uint64) @ places), kind="stable")]
            own = np.where(seen == PAD, -1, codes[np.minimum(seen, START_CODE)])
            local = A.Model(sent.value.class_of, sent.value.other, sent.value.group_bias, sent.value.class_bias, {k: v.copy() for k, v in sent.value.weights.items()})
            A.train(local, own, rate, BATCH)
            parts = np.array_split(A.flat(local.weights).astype(np.float64) * len(own), PARTS)
            worker = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([worker] * PARTS, pa.int64()), pa.array([float(len(own))] * PARTS, pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "worker", "n", "weights"]
            )

        def summed(table: pa.Table) -> pa.Table:
            table = table.sort_by("worker")  # so that sums round alike wherever they are taken
            total = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("weights").combine_chunks()], axis=0)
            return pa.table({"part": table.column("part")[:1], "worker": pa.array([table.column("worker")[0].as_py() // fan], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())]), "weights": pa.array([total.tobytes()], pa.binary())})

        kind = "part int, worker long, n double, weights binary"
        own = every.where(F.pmod(F.xxhash64("ids", F.lit(1)), F.lit(len(RATES))) == turn).repartition(workers, F.xxhash64("ids", "copy")).select("ids")
        sums = own.mapInArrow(run, kind).groupBy("part", F.floor(F.col("worker") / fan)).applyInArrow(summed, kind)
        found = sums.groupBy("part").applyInArrow(summed, kind).orderBy("part").collect()  # PARTS rows
        if found:
            model.weights = A.views(np.concatenate([np.frombuffer(r.weights) / r.n for r in found]).astype(np.float32))
        discard()


def score(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = settle(gather(texts.where(F.col("doc_id").isNotNull() & ~held_out), ranks_path), "lm_counts")
    counts = settle(raw.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "lm_words")
    n_texts = raw.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    # counts by eighths of their power of two: some hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    spread = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    total, distinct = sum(r.n for r in spread) + n_texts, sum(r.words for r in spread) + bool(n_texts)
    room, least = HEAD_WORDS, 1 << 30
    for r in spread:
        room -= r.words
        if room < 0:
            break
        least = r.step
    head = counts.where(step >= least).toArrow()  # HEAD_WORDS rows at most
    keys, numbers = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(keys)
    model = start_model(raw)
    every = settle(numbered(raw.where(F.col("kind") == TRAIN).select("ids")), "lm_windows")
    discard(raw)
    train(model, every)
    discard(every)
    sent = spark.sparkContext.broadcast((keys[order], numbers[order], model))
    scale = total + 0.1 * (distinct + 1)
    end = float(np.log10((n_texts + 0.1) / scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(ranks_path)
        head_keys, head_counts, lm = sent.value
        codes = class_of_code(lm.class_of)
        context, row = TaskContext.get(), 0
        base_row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                n = b - a
                rows, inverse, found, _, ids, bounds = read(data, offsets, coder)
                at = np.minimum(np.searchsorted(head_keys, found), max(len(head_keys) - 1, 0))
                there = head_keys[at] == found if len(head_keys) else np.zeros(len(found), bool)
                logs = np.where(there, np.log10((head_counts[at] + 0.1) / scale), 0.0) if len(head_keys) else np.zeros(len(found))
                known = there[inverse]
                base = np.bincount(rows, weights=logs[inverse], minlength=n)
                n_known = np.bincount(rows[known], minlength=n)
                # the rest, once for each row and word
                rest = np.flatnonzero(~known)
                pair, many = np.unique(rows[rest] * max(len(found), 1) + inverse[rest], return_counts=True)
                own, word = pair // max(len(found), 1), pair % max(len(found), 1)
                cuts = np.searchsorted(own, np.arange(n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(found[word].view(np.int64)), pa.array(many.astype(np.int64))], ["key", "n"]))
                seen = codes[ids]
                value = A.text_score(lm, seen, bounds)
                others = np.flatnonzero(seen == A.OTHER)
                value += np.bincount(np.searchsorted(bounds, others, side="right") - 1, weights=lm.other[ids[others]], minlength=n)
                number = base_row + row + np.arange(n)
                row += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), batch.column(0).slice(a, n), pa.array(np.bincount(rows, minlength=n).astype(np.int64) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(value / LOG10), tail],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail"],
                )

    scored = settle(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<key: long, n: long>>"), "lm_scored")
    rare = scored.select("row", F.explode("tail").alias("x")).select("row", F.col("x.key").alias("key"), F.col("x.n").alias("times"))
    rare = rare.join(counts.where(step < least), "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(scale))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    out = scored.drop("tail").join(rare, "row", "left")
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0)) + int(n_texts > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"),
        "score",
    )
