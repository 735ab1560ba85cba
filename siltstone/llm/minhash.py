"""Near-duplicates by min-max hashing, with every link confirmed on full shingle sets.

Each permutation gives two signature values, the minimum and the maximum of
the permuted shingle hashes, so half as many permutations are evaluated.
BANDS bands of ROWS values are keys, or for a threshold as in SPREADS; at the
threshold a linked pair shares no band with probability (1 - 0.85**6)**24,
about 1 in 100,000, and much less above it; at 80 % with (1 - 0.8**5)**36,
under 1 in a million.

1. Documents with equal sets collapse to one class (a fingerprint of the set).
2. Each class is compared with one other: the most central class of those that
   it shares most bands with.  Components of the links are found.
3. Where a bucket still holds several components, its classes are dealt to
   blocks, and each pair of blocks is compared inside one task, which gives
   back a spanning forest of the links.  So no link between different texts is
   lost, and no pairs are emitted.

No bucket is collected: buckets are aggregated and joined, blocks have about
BLOCK classes and BLOCK_BYTES of sets, and the pairs of blocks are dealt to
tasks in turn.  Keys that many rows share are joined by join_hot(), and a pivot of
many classes is copied, once for about SALT of them.

Edge cases: null, empty or blank texts have no shingles, link with nothing and
are kept; so are rows without doc_id, whose component_id is null; fewer than
five words form one shingle; repeated rows share a class; ties go to the
smallest doc_id; rows with other texts that repeat a doc_id are one document,
linked with whatever one of its texts is linked with; very long texts are taken whole; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import LOWER, mix, prefix_hash, span_hash, text_slices, words
from siltstone.llm.components import components
from siltstone.llm.shared import discard, join_hot, settle, small_batches

WORDS = 5
PERCENT = 85
ROWS = 6
BANDS = 24
SLICE = 1 << 19  # bytes of texts whose shingles are hashed at once
BLOCK = 256
BLOCK_BYTES = 32 << 20
SALT = 1024
# rows and bands up to a threshold in percent
SPREADS = {80: (5, 36), 100: (ROWS, BANDS)}
PERMUTATIONS = max(rows * bands for rows, bands in SPREADS.values()) // 2

with np.errstate(over="ignore"):
    FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    PLACES = mix(np.arange(101, 101 + max(rows for rows, _ in SPREADS.values()), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, in one array ordered within rows, and the rows' bounds in it."""
    low = LOWER[data]
    n = len(offsets) - 1
    starts, ends, rows = words(low, offsets)
    count = np.bincount(rows, minlength=n)
    chain = prefix_hash(span_hash(prefix_hash(low.astype(np.uint64) + np.uint64(1)), starts, ends))
    full = np.flatnonzero(rows[: -(WORDS - 1)] == rows[WORDS - 1 :]) if len(rows) >= WORDS else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < WORDS))
    hashes = np.concatenate([span_hash(chain, full, full + WORDS), span_hash(chain, first[few], first[few] + count[few])])
    own = np.concatenate([rows[full], few]) if len(full) else few
    bits = max(1, n.bit_length())
    order = np.argsort((own.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    hashes, own = hashes[order], own[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    hashes, own = hashes[new], own[new]
    return hashes, np.searchsorted(own, np.arange(n + 1))


def spread(percent: int) -> tuple[int, int]:
    """Rows and bands for a threshold of 80 % or more."""
    if not min(SPREADS) <= percent <= 100:
        raise ValueError(f"no bands for a threshold of {percent} %")
    return SPREADS[min(most for most in SPREADS if percent <= most)]


def band_keys(hashes: np.ndarray, begin: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """The keys of ``bands`` bands for each non-empty set; begin: where each set starts."""
    out = np.zeros((bands, len(begin)), dtype=np.uint64)
    for k in range(rows * bands // 2):
        permuted = hashes * FACTORS[k]
        for j, value in ((2 * k, np.minimum.reduceat(permuted, begin)), (2 * k + 1, np.maximum.reduceat(permuted, begin))):
            out[j // rows] += mix(value) * PLACES[j % rows]
    out += np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return mix(out.reshape(-1)).reshape(bands, -1).T


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, a fingerprint (f, g) of the set and its band keys; null where the set is empty."""
    in_band, bands = spread(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                hashes, bounds = shingle_sets(data, offsets)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                begin = bounds[some]
                keys = np.zeros((b - a, bands), dtype=np.uint64)
                prints = np.zeros((2, b - a), dtype=np.uint64)
                if len(some):
                    keys[some] = band_keys(hashes, begin, in_band, bands)
                    prints[0, some] = np.add.reduceat(mix(hashes + np.uint64(0x5851F42D4C957F2D)), begin)
                    prints[1, some] = np.bitwise_xor.reduceat(mix(hashes * np.uint64(0xDA942042E4DD58B5)), begin)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists],
                    ["doc_id", "n_shingles", "f", "g", "bands"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, f long, g long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id and the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                hashes, bounds = shingle_sets(data, offsets)
                sets = [np.sort(hashes[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["id", "hashes"])

    return _texts(docs).mapInArrow(run, "id long, hashes binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def reaches(both: int | np.ndarray, p: int | np.ndarray, q: int | np.ndarray, percent: int = PERCENT) -> bool | np.ndarray:
    return 100 * both >= percent * (p + q - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, near: how many may have this a) whose full sets reach the threshold; repeated rows only repeat a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(reaches(len(p) + len(q) - len(np.union1d(p, q)), len(p), len(q), percent)))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("p")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("q"))
    # a power of two of copies of each left set
    copies = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("near") / SALT, F.lit(1.0))))).cast("int")
    pairs = pairs.withColumn("copies", copies).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    copied = pairs.select("a", "copies").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).join(left.hint("merge"), "a")
    return pairs.join(right.hint("merge"), "b").join(copied.hint("merge"), ["a", "copies", "salt"]).select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def forest(ids: list[int], component: list[int], block: list[int], sets: list[np.ndarray], crossed: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between components of the members of one group, as many as join them; only between blocks if ``crossed``."""
    n = len(ids)
    size = np.array([len(x) for x in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(inverse)[inverse] > 1  # a hash of one member alone is in no intersection
    rows, columns = np.repeat(np.arange(n), size)[often], inverse[often]
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, len(values), 4096):
        x, y = np.searchsorted(columns, [at, at + 4096])
        if x < y:
            part = np.zeros((n, 4096), dtype=np.float32)
            part[rows[x:y], columns[x:y] - at] = 1
            both += part @ part.T
    linked = reaches(both.astype(np.int64), size[:, None], size[None, :], percent)
    of, sides = np.array(component), np.array(block)
    linked &= of[:, None] != of[None, :]
    if crossed:
        linked &= sides[:, None] != sides[None, :]
    parent = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        x, y = root(component[i]), root(component[j])
        if x != y:
            parent[x] = y
            out.append((ids[i], ids[j]))
    return out


def across(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components within buckets: ``members`` has key, id, component, and how many members and shingles its bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> pa.RecordBatch | None:
            ids, of, blocks = ([x[i] for x in held] for i in (3, 4, 5))
            if len(set(of)) < 2:
                return None
            found = forest(ids, of, blocks, [x[6] for x in held], held[0][1] != held[0][2], percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]) if found else None

        for batch in batches:
            # sets stay in the batch's own memory
            sets_of = (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(6))
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), sets_of, strict=True):
                if held and row[:3] != held[0][:3]:
                    if (out := solve()) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := solve()) is not None:
            yield out

    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") * 8 / BLOCK_BYTES)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "component", "block")
    whole = dealt.join(sets.hint("merge"), "id").select("key", "x", "y", "id", "component", "block", "hashes")
    # one after the other, so that the pairs of blocks of a large bucket are spread evenly
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("key") + F.expr("shiftright(cast(y as long) * (y + 1), 1)") + F.col("x"), F.lit(tasks)).cast("int")
    return whole.repartitionById(tasks, turn).sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text); ``percent`` of the union is shared by a linked pair."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(signatures(docs, percent), "signatures")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = signed.where(linkable).groupBy("f", "g", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count(F.lit(1)).alias("often"))
    classes = settle(classes, "classes")
    keys = classes.select(F.col("rep").alias("id"), "n_shingles", F.explode("bands").alias("key"))
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).where("members > 1")
    often = settle(often.withColumn("often", F.col("members")), "bucket_sizes")
    shared = settle(join_hot(keys.drop("n_shingles"), often, ["key"]), "buckets")
    # the most central class of a bucket shares most buckets with others
    central = shared.groupBy("id").agg(F.sum("members").alias("central"))
    pivots = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("top"), F.max("members").alias("often")).select("key", (-F.col("top.minus")).alias("pivot"), "often")
    pivots = settle(pivots, "pivots")
    tried = join_hot(shared, pivots, ["key"]).where("id != pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("bands"), F.max("members").alias("near"))
    tried = tried.groupBy("id").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("minus"), "near")).alias("top")).select((-F.col("top.minus")).alias("a"), F.col("id").alias("b"), F.col("top.near").alias("near"))
    tried = settle(tried, "tried")
    named = shared.select(F.col("id").alias("doc_id")).distinct()
    # each text once, also where rows repeat a doc_id
    one = docs.join(named.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = settle(full_sets(one), "sets")
    links = settle(confirm(tried, sets, percent), "links")
    labels = components(links)
    told = settle(shared.join(labels, "id", "left").select("key", "id", "members", "shingles", F.coalesce("component", "id").alias("component")), "told")
    mixed = settle(told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("members").alias("often")).where("low != high").select("key", "often"), "mixed")
    more = settle(across(join_hot(told, mixed, ["key"]), sets, percent), "more_links")
    discard(shared, sets)
    if more.limit(1).count():
        labels = components(links.union(more))
    named = classes.select("f", "g", "n_shingles", "rep", "often").join(labels, F.col("rep") == F.col("id"), "left").select("f", "g", "n_shingles", "often", F.coalesce("component", "rep").alias("component"))
    found = join_hot(signed.where(linkable).drop("bands"), settle(named, "classes_named"), ["f", "g", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where(~linkable | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay, and rows that link with nothing."""
    gone = settle(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near_duplicates")
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
