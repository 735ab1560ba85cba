"""Removal of byte strings that occur more than once, by interval expansion on Burrows-Wheeler transforms.

Any two equal strings of MINIMUM bytes choose the same anchor in themselves:
their leftmost smallest hash of GRAM bytes.  So positions are dealt to tasks
by anchor, and equal strings always meet.

1. Each text is cut into runs of window starts that share an anchor.  A run
   whose anchor is nowhere else holds no repeat.  If all runs of an anchor have
   equal bytes, all their windows repeat.  Both are settled by one aggregation
   with map-side combining; so the inner part of copied text never meets.
2. Of the other anchors, one run for each distinct content is taken.  A task
   builds the transform of the runs of some anchors and expands intervals
   breadth-first by backward extension: level by level it derives where the
   common prefix of neighbouring suffixes has that length, and stops at
   MINIMUM.  What is then not cut apart shares MINIMUM bytes.
3. An anchor with over GROUP distinct runs is not gathered: its windows are
   counted by hash, which gives the same result.
4. Windows found are merged to spans in each text, and the rest is kept.

Hashes have 64 bits; contents are compared under an equal anchor hash.

Edge cases: a null text is empty; texts shorter than MINIMUM bytes have no
window; a text of any length is taken whole, in pieces; rows that repeat both
doc_id and text are copies of each other; a null doc_id is allowed; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import mix, powers, prefix_hash, span_hash, text_slices
from siltstone.llm.shared import discard, join_hot, settle, small_batches

MINIMUM = 200
GRAM = 56
GROUP = 4096  # runs have at most 2 * MINIMUM - GRAM bytes, so a group is about as large as a batch
PIECE = 1 << 19
BATCH = 1 << 19
COUNTED = 1024  # runs whose windows are counted at once
ANCHOR = "h long, whole long, doc long, f long, begin int, count int"
NO_ID = -(1 << 63)


def runs(data: np.ndarray, bounds: np.ndarray, minimum: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: text, first start, number of starts, anchor hash, hash of all bytes.

    ``bounds``: where texts start in ``data``, and its end.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < minimum:
        return none, none, none, none, none
    _, q = powers(n + 1)
    prefix = prefix_hash(data.astype(np.uint64) + np.uint64(1))
    grams = mix((prefix[gram:] - prefix[:-gram]) * q[: n - gram + 1] + np.uint64(gram))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = minimum - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    inside = np.zeros(n + 1, dtype=np.int32)
    long = np.diff(bounds) >= minimum
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - minimum + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(low)])
    if not len(at):
        return none, none, none, none, none
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    first = at[head]
    last = at[np.append(head[1:], len(at)) - 1]
    text = np.searchsorted(bounds, first, side="right") - 1
    return text, first, last - first + 1, grams[anchor[head]].view(np.int64), span_hash(prefix, first, last + minimum).view(np.int64)


def pieces(column: pa.Array, minimum: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes, bounds and place in its text of parts of a text column; a long text comes in overlapping parts."""
    for a, b, data, offsets in text_slices(column, PIECE):
        if len(data) <= 2 * PIECE:
            yield np.arange(a, b), data, offsets, np.zeros(b - a, np.int64)
            continue
        for r in range(a, b):
            own = data[offsets[r - a] : offsets[r - a + 1]]
            for at in range(0, max(1, len(own) - minimum + 1), PIECE):
                part = own[at : at + PIECE + minimum - 1]
                yield np.array([r]), part, np.array([0, len(part)]), np.array([at])


def anchors(docs: DataFrame, minimum: int, gram: int) -> DataFrame:
    """All runs of ``docs`` (doc, f, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds, place in pieces(batch.column(2), minimum):
                text, first, count, h, whole = runs(data, bounds, minimum, gram)
                own = pa.array(rows[text])
                begin = first - bounds[text] + place[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(whole, pa.int64()), batch.column(0).take(own), batch.column(1).take(own), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["h", "whole", "doc", "f", "begin", "count"],
                )

    return docs.select("doc", "f", "text").mapInArrow(run, ANCHOR)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by their first ``depth`` symbols at least, by doubling; only groups not yet told apart are sorted again."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    reach = 63 // bits
    padded = np.concatenate([text.astype(np.uint64), np.zeros(reach, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(reach):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order = np.argsort(key)
    head = np.ones(n, dtype=bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + 1, dtype=np.int64)  # the last one stands for what is past the end
    while True:
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, n))
        rank[order] = np.repeat(starts + 1, size)
        if reach >= depth or len(starts) == n:
            return order
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        own = order[open_]
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + reach, n)].astype(np.uint64)
        by = np.argsort(key)
        order[open_], key = own[by], key[by]
        head[open_[1:]] |= key[1:] != key[:-1]
        reach *= 2


def expand(text: np.ndarray, order: np.ndarray, minimum: int) -> np.ndarray:
    """Whether each suffix shares less than ``minimum`` symbols with the one before it in ``order``; one entry more for the end.

    Breadth-first: the intervals of strings of one length are extended backwards
    by every symbol before them.  Where an extended interval ends and no border
    is known, the common prefix there is as long as the string that was
    extended; only such intervals are extended further.  Symbol 0 ends a string.
    """
    n = len(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    mapped = np.empty(n, dtype=np.int64)
    mapped[by_symbol] = np.arange(n)
    previous, following = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    border = np.zeros(n + 1, dtype=bool)
    border[[0, n]] = True
    left, right = np.array([0]), np.array([n - 1])
    for length in range(minimum):
        size = right - left + 1
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) + np.repeat(left - ends + size, size)
        usable = np.ones(len(inside), dtype=bool) if not length else before[inside] > 0
        lefts = np.sort(mapped[inside[usable & (previous[inside] < np.repeat(left, size))]])
        rights = np.sort(mapped[inside[usable & (following[inside] > np.repeat(right, size))]])
        new = ~border[rights + 1]
        left, right = lefts[new], rights[new]
        border[right + 1] = True
        if not len(left):
            break
    return border


def repeated(strings: list[np.ndarray], minimum: int) -> list[np.ndarray]:
    """For each byte string the starts of those of its substrings of ``minimum`` bytes that occur more than once in all."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    total = int(sizes.sum()) + len(strings)
    text = np.zeros(total, dtype=np.int16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(total, dtype=bool)
    inside[starts + sizes] = False
    raw = np.concatenate(strings) if strings else np.zeros(0, np.uint8)
    used = np.bincount(raw, minlength=256) > 0
    text[inside] = np.cumsum(used)[raw]
    order = suffix_order(text, minimum)
    border = expand(text, order, minimum)
    group = np.cumsum(border[:-1]) - 1
    many = np.bincount(group)[group] > 1
    found = np.sort(order[many])
    own = np.searchsorted(starts, found, side="right") - 1
    place = found - starts[own]
    valid = place + minimum <= sizes[own]
    own, place = own[valid], place[valid]
    cuts = np.searchsorted(own, np.arange(len(strings) + 1))
    return [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def stretches(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of consecutive integers."""
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    head = np.flatnonzero(new)
    return starts[head], np.diff(np.append(head, len(starts)))


FOUND = "doc long, f long, begin int, count int"


def by_transform(snippets: DataFrame, minimum: int) -> DataFrame:
    """Repeated windows of the runs that stand alone, all runs of an anchor being in one partition, next to each other."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        found = repeated([np.frombuffer(x[1], np.uint8) for x in held], minimum)
        out: list[tuple] = []
        for (_, _, doc, f, begin, alone), own in zip(held, found, strict=True):
            if alone and len(own):
                out += [(doc, f, begin + int(a), int(n)) for a, n in zip(*stretches(own), strict=True)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "f", "begin", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[0] != last:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                last = row[0]
        if held and (out := solve(held)) is not None:
            yield out

    own = snippets.select("h", "bytes", "doc", "f", "begin", "alone")
    return own.repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def by_count(snippets: DataFrame, minimum: int) -> DataFrame:
    """The same for anchors with too many runs to gather: windows are counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, COUNTED) for whole in batches for i in range(0, whole.num_rows, COUNTED)):
            # the runs of a slice one after the other; windows that cross from one to the next are left out
            raw = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(raw) and raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            starts = offsets - offsets[0] if len(raw) else np.zeros(1, np.int64)
            count = np.maximum(np.diff(starts) - minimum + 1, 0)
            own = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            at = starts[own] + place
            keys = span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), at, at + minimum).view(np.int64)
            same = pa.array(own)
            begin = batch.column(4).to_numpy()[own] + place
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(same), pa.array(keys), batch.column(2).take(same), batch.column(3).take(same), pa.array(begin.astype(np.int32)), batch.column(5).take(same)], ["h", "key", "doc", "f", "begin", "alone"]
            )

    keyed = snippets.select("h", "bytes", "doc", "f", "begin", "alone").mapInArrow(run, "h long, key long, doc long, f long, begin int, alone boolean")
    twice = keyed.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "key")
    return keyed.where("alone").join(twice, ["h", "key"], "left_semi").select("doc", "f", "begin", F.lit(1).alias("count"))


def snippets_of(docs: DataFrame, wanted: DataFrame, minimum: int) -> DataFrame:
    """The bytes of the runs in ``wanted`` (doc, f, own: array of h, begin, count, alone, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw, own = batch.column(2)[r].as_py().encode(), batch.column(3)[r].values
                begin, count = own.field("begin").to_numpy().tolist(), own.field("count").to_numpy().tolist()
                cut = pa.array([raw[b : b + n + minimum - 1] for b, n in zip(begin, count, strict=True)], pa.binary())
                same = pa.array(np.zeros(len(begin), np.int32) + r)
                yield pa.RecordBatch.from_arrays([own.field("h"), cut, batch.column(0).take(same), batch.column(1).take(same), own.field("begin"), own.field("alone"), own.field("hot")], ["h", "bytes", "doc", "f", "begin", "alone", "hot"])

    # rows that repeat doc and text have the same runs; one of them is enough
    joined = docs.join(wanted, ["doc", "f"]).select("doc", "f", "text", "own")
    return joined.mapInArrow(run, "h long, bytes binary, doc long, f long, begin int, alone boolean, hot boolean")


def windows_found(docs: DataFrame, minimum: int, gram: int, group: int) -> DataFrame:
    """All repeated windows of ``docs`` (doc, f, text) as (doc, f, begin, count)."""
    every = settle(anchors(docs, minimum, gram), "anchors")
    often = every.groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("often > 1")
    often = settle(often.select("h", (F.col("low") != F.col("high")).alias("mixed"), "often"), "anchors_often")
    hits = settle(join_hot(every, often, ["h"]), "anchors_hit")
    discard(every)
    mixed = hits.where("mixed")
    # rows that repeat doc and text count as two
    classes = settle(mixed.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("often"), F.min(F.struct("doc", "f", "begin", "count")).alias("one")), "anchor_classes")
    copied = join_hot(mixed, classes.where("often > 1").select("h", "whole", "often"), ["h", "whole"])
    sizes = settle(classes.groupBy("h").agg((F.count(F.lit(1)) > group).alias("hot"), F.count(F.lit(1)).alias("often")), "anchor_sizes")
    wanted = join_hot(classes.withColumnRenamed("often", "n"), sizes, ["h"]).select("one.doc", "one.f", F.struct("h", F.col("one.begin").alias("begin"), F.col("one.count").alias("count"), (F.col("n") == 1).alias("alone"), "hot").alias("x")).groupBy("doc", "f").agg(F.collect_list("x").alias("own"))
    snippets = settle(snippets_of(docs, wanted, minimum), "snippets")
    found = by_transform(snippets.where("not hot"), minimum).union(by_count(snippets.where("hot"), minimum))
    out = settle(hits.where("not mixed").select("doc", "f", "begin", "count").union(copied.select("doc", "f", "begin", "count")).union(found), "repeats")
    discard(hits, classes, snippets)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("f"), "text")


def covered(begin: np.ndarray, count: np.ndarray, minimum: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that windows cover; spans that touch are one."""
    order = np.argsort(begin, kind="stable")
    a, b = begin[order].astype(np.int64), begin[order].astype(np.int64) + count[order] - 1 + minimum
    reach = np.maximum.accumulate(b)
    head = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    return list(zip(a[head].tolist(), reach[np.append(head[1:], len(a)) - 1].tolist(), strict=True))


def deduplicate(docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    found = windows_found(keyed, minimum, gram, group).groupBy("doc", "f").agg(F.collect_list(F.struct("begin", "count")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, prints = [], [], [], []
            for r in range(batch.num_rows):
                raw, cut = batch.column(1)[r].as_py().encode(), []
                if batch.column(2)[r].is_valid:
                    own = batch.column(2)[r].values
                    cut = covered(own.field("begin").to_numpy(), own.field("count").to_numpy(), minimum)
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in cut))
                spans.append([{"begin": a, "end": b} for a, b in cut])
                prints.append(kept.hexdigest())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(prints, pa.string()), pa.array(spans, kind)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    joined = keyed.join(found, ["doc", "f"], "left").select("doc_id", "text", "own")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")
