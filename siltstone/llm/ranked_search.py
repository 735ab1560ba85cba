"""Ranked lexical search: the best documents for each of many items, by a threshold-seeded join.

1. Documents keep the counts of terms that occur in some item (a bitmap of at
   most BITS_MOST bits lets few others pass; the joins after it are exact).
2. For each term its K-th largest and its largest impact over all documents
   are stored, from the largest of each partition.  K documents reach the
   K-th impact of any of an item's terms, so the largest of those is at most
   the item's K-th score: its threshold.
3. An item's terms go from the rarest to the most frequent.  Where the sum of
   largest impacts from a term on is under the threshold, a document with no
   rarer term of the item cannot be among the best, so only the terms before
   that generate candidates.
4. Each document scores its own candidates from its own counts: what the generating
   terms give, a candidate being dropped where even all the others could not
   lift it to the threshold, then the exact rest.
5. The best K of each task, then of each item, are ranked.

Items are taken in blocks of about BLOCK_TERMS terms, so what is broadcast is
bounded; no pairs but candidates are ever made.  Scores are integers, so the
result does not depend on partitions.  Terms are compared by 64-bit hashes.

Edge cases: a text without terms counts in no statistic and is never found; so
is a null one.  Rows of one item_id are one item with the terms of all of
them, rows without item_id too; an item without terms, or whose terms occur in no
document or weigh 0, has no rows.  Rows that repeat a doc_id are documents of
their own; doc_id may be null, and then comes last among equal scores.  Other columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.bytetext import LOWER, SLICE_BYTES, prefix_hash, span_hash, text_slices, words
from siltstone.llm.shared import join_hot, settle

K = 50
BLOCK_TERMS = 1 << 18
BITS_LEAST, BITS_MOST = 1 << 20, 1 << 27
SALT = 64
#: Numbers of values that a task holds at once.
EXPANDED, HELD = 1 << 21, 1 << 21

#: Bytes that are in no term: ASCII but for digits and letters.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[:128] = True
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term and its row."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, BETWEEN)
    return span_hash(prefix_hash(low.astype(np.uint64) + np.uint64(1)), starts, ends), rows


def hashed_terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms of some rows as hashes with their rows; a long row in parts that end between terms."""
    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        yield _hashes(data, offsets)
        return
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and not BETWEEN[data[end]]:
            end += 1
        yield _hashes(data[at:end], np.array([0, min(end, len(data)) - at]))
        at = end


def counted(data: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each row; then row, hash and count of the terms that ``bits`` may hold, ordered by row and hash."""
    n, kept = np.zeros(len(offsets) - 1, np.int64), []
    for hashes, rows in hashed_terms(data, offsets):
        n += np.bincount(rows, minlength=len(n))
        place = hashes >> np.uint64(65 - len(bits).bit_length() - 6)
        known = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        kept.append((rows[known], hashes[known]))
    rows, hashes = (np.concatenate([x[i] for x in kept]) for i in (0, 1))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(first)
    return n, rows[begin], hashes[begin], np.diff(np.append(begin, len(rows)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of all items, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in text_slices(batch.column(1)):
                for hashes, rows in hashed_terms(data, offsets):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), _text()).mapInArrow(run, "item_id long, term long").distinct()


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the terms' high bits, in words of 64: 64 bits or more for each term, up to BITS_MOST."""
    size = BITS_LEAST
    while size < min(BITS_MOST, 64 * terms.count()):
        size *= 2
    high = F.expr(f"shiftrightunsigned(term, {65 - size.bit_length()})")
    held = terms.groupBy(F.shiftright(high, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {65 - size.bit_length()}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return bits.view(np.uint64)


def postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, n and the terms and counts of each document with a term."""
    told = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                n, rows, hashes, tf = counted(data, offsets, told.value)
                bounds = pa.array(np.searchsorted(rows, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes.view(np.int64), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>")


def impacts(n: np.ndarray, rows: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The part of each posting's score that does not depend on its term."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        share = 50 * n * documents // length
    else:
        share = np.array([50 * int(x) * documents // length for x in n], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + share[rows]))


def unlisted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of each document of a batch of postings; row, term and count of each posting."""
    terms, counts = batch.column(2), batch.column(3)
    rows = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
    return batch.column(1).to_numpy(), rows, terms.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()


def first_of(group: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first ``most`` of their group; ``group`` is ordered."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group)))) < most


def term_statistics(posted: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """term, df and its ``k`` largest impacts (without the term's weight), from the largest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        top, value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            bounds = pa.array(np.append(np.searchsorted(top, terms), len(top)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df), pa.ListArray.from_arrays(bounds, pa.array(value))], ["term", "df", "top"])

        for batch in batches:
            n, rows, own, tf = unlisted(batch)
            new = impacts(n, rows, tf, documents, length)
            top, value = np.append(top, own), np.append(value, new)
            order = np.lexsort((-value, top))
            order = order[first_of(top[order], k)]
            top, value = top[order], value[order]
            found, often = np.unique(own, return_counts=True)
            every, where = np.unique(np.append(terms, found), return_inverse=True)
            terms, df = every, np.bincount(where, np.append(df, often), len(every)).astype(np.int64)
            if len(top) > HELD:
                yield out()
                terms, df, top, value = terms[:0], df[:0], top[:0], value[:0]
        yield out()

    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top")
    parts = posted.mapInArrow(run, "term long, df long, top array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    parts = parts.groupBy("term", "salt").agg(F.sum("df").alias("df"), best)
    return parts.groupBy("term").agg(F.sum("df").alias("df"), best)


def weighed(items: DataFrame, statistics: DataFrame, documents: int, k: int) -> DataFrame:
    """(item_id, term, weight, generates, threshold, rest): rest is the most that all terms of the item that generate no candidates can give."""
    often = items.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    known = often.join(statistics, "term").withColumn("weight", weight).where("weight > 0")
    known = known.select("term", "often", "df", "weight", (F.col("weight") * F.col("top")[0]).alias("most"), F.when(F.size("top") >= k, F.col("weight") * F.element_at("top", k)).otherwise(0).alias("kth"))
    every = Window.partitionBy("item_id")
    on = every.orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_of = join_hot(items, settle(known, "known_terms"), ["term"]).withColumn("threshold", F.greatest(F.max("kth").over(every), F.lit(1)))
    all_of = all_of.withColumn("generates", F.sum("most").over(on) >= F.col("threshold"))
    rest = F.coalesce(F.sum(F.when(~F.col("generates"), F.col("most"))).over(every), F.lit(0))
    return all_of.select("item_id", "term", "weight", "generates", "threshold", rest.alias("rest"))


@dataclass
class Block:
    """Some items: their ids; terms in order with their weights; which items each term generates; which other terms each item has."""

    ids: pa.Array
    terms: np.ndarray
    weights: np.ndarray
    generated: np.ndarray
    generated_at: np.ndarray
    others: np.ndarray
    others_at: np.ndarray
    threshold: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Block:
        code = table.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        item = code.indices.to_numpy()
        columns = {c: table.column(c).to_numpy() for c in ("weight", "generates", "threshold", "rest")}
        terms, first, term = np.unique(table.column("term").to_numpy().view(np.uint64), return_index=True, return_inverse=True)
        n, generates = len(code.dictionary), columns["generates"]
        threshold, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        threshold[item], rest[item] = columns["threshold"], columns["rest"]
        by_term = np.flatnonzero(generates)[np.argsort(term[generates], kind="stable")]
        by_item = np.flatnonzero(~generates)[np.argsort(item[~generates], kind="stable")]
        at = lambda x, m: np.searchsorted(x, np.arange(m + 1))
        return Block(code.dictionary, terms, columns["weight"][first], item[by_term], at(term[by_term], len(terms)), term[by_item], at(item[by_item], n), threshold, rest)


def spread_out(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [begin, begin + count): of which range each place is, and the place."""
    of = np.repeat(np.arange(len(begin)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]


def candidates(block: Block, docs: int, rows: np.ndarray, term: np.ndarray, value: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, item and exact score of each candidate that reaches ``floor`` of its item; postings ordered by row and term (a place in the block's terms)."""
    count = block.generated_at[term + 1] - block.generated_at[term]
    until = np.append(0, np.cumsum(np.bincount(rows, count, docs))).astype(np.int64)
    at = 0
    while at < docs:
        end = max(at + 1, int(np.searchsorted(until, until[at] + EXPANDED, side="right")) - 1)
        a, b = np.searchsorted(rows, [at, end])
        of, place = spread_out(block.generated_at[term[a:b]], count[a:b])
        pair = rows[a:b][of] * len(block.ids) + block.generated[place]
        order = np.argsort(pair, kind="stable")
        pair, part = pair[order], value[a:b][of][order]
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        score = np.add.reduceat(part, begin) if len(begin) else part
        row, item = np.divmod(pair[begin], len(block.ids))
        live = score + block.rest[item] >= floor[item]
        row, item, score = row[live], item[live], score[live]
        keys = rows[a:b] * len(block.terms) + term[a:b]
        others = block.others_at[item + 1] - block.others_at[item]
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(others), np.arange(0, others.sum(), EXPANDED)), len(item)))
        for x, y in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
            of, place = spread_out(block.others_at[item[x:y]], others[x:y])
            wanted = row[x:y][of] * len(block.terms) + block.others[place]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[found] == wanted if len(keys) else np.zeros(0, dtype=bool)
            full = score[x:y].copy()
            np.add.at(full, of[hit], value[a:b][found[hit]])
            good = full >= floor[item[x:y]]
            yield row[x:y][good], item[x:y][good], full[good]
        at = end


def best_of(posted: DataFrame, block: Block, documents: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id and score: of each task the ``k`` best of each item, if they reach its threshold."""
    told = posted.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = told.value
        floor = block.threshold.copy()
        item, score, doc, none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([block.ids.take(pa.array(item)), pa.array(doc, mask=none), pa.array(score)], ["item_id", "doc_id", "score"])

        for batch in batches:
            n, rows, terms, tf = unlisted(batch)
            place = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
            known = block.terms[place] == terms
            value = impacts(n, rows, tf, documents, length)[known] * block.weights[place[known]]
            ids, missing = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for r, i, s in candidates(block, len(batch), rows[known], place[known], value, floor):
                item, score, doc, none = np.append(item, i), np.append(score, s), np.append(doc, ids[r]), np.append(none, missing[r])
                order = np.lexsort((doc, none, -score, item))
                order = order[first_of(item[order], k)]
                item, score, doc, none = item[order], score[order], doc[order], none[order]
                full = np.flatnonzero(np.bincount(item, minlength=len(floor)) >= k)
                floor[full] = np.maximum(floor[full], score[np.searchsorted(item, full, side="right") - 1])
                if len(item) > HELD:
                    yield out()
                    item, score, doc, none = item[:0], score[:0], doc[:0], none[:0]
        yield out()

    return posted.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    wanted = settle(item_terms(items), "item_terms")
    posted = settle(postings(docs, bitmap(wanted.select("term").distinct())), "postings")
    documents, length = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    schema = "item_id long, rank int, doc_id long, score long"
    if not documents:
        return spark.createDataFrame([], schema)
    terms = settle(weighed(wanted, term_statistics(posted, documents, length, k), documents, k), "weighed_terms")
    blocks = -(-terms.count() // block_terms)
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = terms.where(F.col("block") == b).drop("block").toArrow()
        if rows.num_rows:
            found = found.union(settle(best_of(posted, Block.of(rows), documents, length, k), "best"))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
