"""Benchmark decontamination by template windows with a check of slot consistency.

Words are folded to lower case (ASCII and Latin-1) without edge punctuation.
Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders.  Windows of WORDS words are hashed twice: as they
stand, and, where they hold a placeholder, as a template.  A bitmap of a fixed
size made of the benchmark's windows lets few others pass, and the rest meet
the benchmark's windows in a hash join.

Windows of one document and item on one diagonal form an alignment.  Template
windows count only if the slots agree over the alignment: each value of the
item stands for one value of the document and the other way round.  A document
is contaminated by an item if half of the item's windows match, or a run of
RUN_WORDS words does.

Items with the same words are one class, named by its smallest item_id.  Items
that differ only in the values of slots are a family, whose templates and
windows without slots are joined once and whose slots are checked once; a
family of over SHARED_ITEMS classes is told by those whose own values the
document has, or else by its smallest.  No window is dropped: those of over
SHARED_ITEMS families are looked up where others of the family matched, or at
once where half of the windows could match without others; only a run of
nothing but such windows, under half of the item, is common wording.

Both are exact with their tables of members.  families() gives the class and
the family of every item, so a document is linked with all members of the
families of its rows.  wording() gives every run of RUN_WORDS words that a
document shares with any item, common or not and whatever the number of items,
once for each run with the smallest item that has it; wording_items() gives
all items of a run.

Edge cases: null and empty texts have no windows and match nothing; items of
fewer than WORDS words are matched whole from SHORTEST words on, and not at
all below, as they would match by chance; repeated document rows give one
result; of several alignments the one with most windows is told; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import mix, prefix_hash, span_hash, text_slices, words
from siltstone.llm.shared import settle

WORDS = 8
SHORTEST = 5
RUN_WORDS = 10
SHARE = 0.5
LITERALS = 3
SHARED_ITEMS = 64
BITMAP_WORDS = 1 << 18
SPAN_SLICE = 1 << 19

NUMBER, UNIT, NAME = 1, 2, 3
# Words for small numbers, and units.
SPELLED = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "mm cm m km metre metres meter meters kilometre kilometres kilometer kilometers inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes ton tons lb lbs pound pounds oz ounce ounces"
    " ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees"
    " kmh mph hz khz mhz w kw kwh v volt volts watt watts joule joules kb mb gb tb"
).split()

EDGE = np.zeros(256, dtype=bool)
EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>|*#$%&~_-+=/\\"]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
NUMERIC = DIGIT.copy()
NUMERIC[[ord(c) for c in ".,:/-"]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".!?:"]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
PLACE = mix(np.arange(11, 15, dtype=np.uint64))
KIND = mix(np.arange(31, 33, dtype=np.uint64))
SPAN_PLACES = mix(np.arange(51, 51 + RUN_WORDS, dtype=np.uint64)) | np.uint64(1)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    low = data + np.where(UPPER[data], 32, 0).astype(np.uint8)
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return low + np.where(capital, 32, 0).astype(np.uint8)


def _hashes_of(said: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(said).encode(), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in said])
    return np.sort(span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), ends - [len(x) for x in said], ends))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and slot type (0: none) of each word."""
    low = fold(data)
    starts, ends, rows = words(low, offsets)
    if not len(starts):
        return rows, np.zeros(0, np.uint64), np.zeros(0, np.int8)
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        b -= (b - 1 > a) & EDGE[low[b - 1]]
        a += (b - 1 > a) & EDGE[low[a]]
    literal = span_hash(prefix_hash(low.astype(np.uint64) + np.uint64(1)), a, b)
    count = lambda table: np.concatenate([[0], np.cumsum(table[low])])
    numeric, digits, lines = count(NUMERIC), count(DIGIT), count(np.arange(256) == 10)
    fused = DIGIT[low[a]] & (b - a <= 8)
    number = ((digits[b] > digits[a]) & (numeric[b] - numeric[a] == b - a)) | fused | np.isin(literal, _hashes_of(SPELLED))
    follows = np.zeros(len(rows), dtype=bool)
    follows[1:] = rows[1:] == rows[:-1]
    before = lambda flags: follows & np.concatenate([[False], flags[:-1]])
    unit = before(number) & np.isin(literal, _hashes_of(UNITS)) & ~number
    opens = ~follows | before(STOP[data[ends - 1]])
    opens[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    second = np.minimum(a + 1, len(data) - 1)
    capital = UPPER[data[a]] & ~UPPER[data[second]] | (data[a] == 0xC3) & (low[second] != data[second])
    name = capital & ~opens & (b - a > 1) & ~number & ~unit
    return rows, literal, (number * NUMBER + unit * UNIT + name * NAME).astype(np.int8)


def windows(rows: np.ndarray, literal: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows of ``size`` words as they stand and as templates, with the first word of each."""
    if len(rows) < size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.astype(np.uint64), none
    full = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])
    tag = np.uint64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    plain = mix(span_hash(prefix_hash(literal), full, full + size) + KIND[0] + tag)
    filled = np.concatenate([[0], np.cumsum(slot > 0)])
    held = filled[full + size] - filled[full]
    some = full[(held > 0) & (held <= size - LITERALS)]
    template = mix(span_hash(prefix_hash(np.where(slot > 0, PLACE[slot], literal)), some, some + size) + KIND[1] + tag)
    return plain, full, template, some


def _rows_of(ids: pa.Array, first: np.ndarray, rows: np.ndarray, literal: np.ndarray, slot: np.ndarray, size: int, keys: np.ndarray, at: np.ndarray, template: bool) -> pa.RecordBatch:
    values, counts = np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    if template and len(at):
        places = at[:, None] + np.arange(size)
        held = slot[places] > 0
        values, counts = literal[places[held]].view(np.int64), held.sum(axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
    place = pa.array((at - first[rows[at]]).astype(np.int64))
    n = len(at)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows[at])), place, pa.array(keys.view(np.int64)), pa.array(np.full(n, template)), pa.array(np.full(n, size, dtype=np.int64)), lists],
        ["id", "place", "key", "template", "size", "slots"],
    )


SCHEMA = "id long, place long, key long, template boolean, size long, slots array<long>"


def document_windows(docs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """The windows of documents whose keys are in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for x, y, data, offsets in text_slices(batch.column(1), SPAN_SLICE):
                rows, literal, slot = tokens(data, offsets)
                first = np.searchsorted(rows, np.arange(y - x))
                ids = batch.column(0).slice(x, y - x)
                for size in sizes:
                    plain, full, template, some = windows(rows, literal, slot, size)
                    for keys, at, kind in ((plain, full, False), (template, some, True)):
                        high = keys >> np.uint64(40)  # 24 bits: which word of the bitmap, and which bit
                        there = (bits[(high >> np.uint64(6)).astype(np.int64)] >> (high & np.uint64(63))) & np.uint64(1) > 0
                        if there.any():
                            yield _rows_of(ids, first, rows, literal, slot, size, keys[there], at[there], kind)

    return _texts(docs, "doc_id").mapInArrow(run, SCHEMA)


def _numbered(values: np.ndarray) -> np.ndarray:
    """The number of each value, counted in the order of first occurrence."""
    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse].astype(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """All windows of benchmark items, a fingerprint of each item's words, and one of its family.

    Items of a family have the same words but for the values of slots, and equal values in the same slots.
    ``slots`` has the numbers of the values of a template window, ``values`` (in one row of an item) the item's values by number;
    ``held`` windows have slots, ``dense`` ones too many for a template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offsets in text_slices(batch.column(1)):
                rows, literal, slot = tokens(data, offsets)
                bounds = np.searchsorted(rows, np.arange(y - x + 1))
                for r in range(y - x):
                    a, b = bounds[r], bounds[r + 1]
                    size = min(WORDS, int(b - a))
                    if size < SHORTEST:
                        continue
                    own, kinds = literal[a:b], slot[a:b]
                    held = kinds > 0
                    numbers = np.zeros(b - a, np.int64)
                    numbers[held] = _numbered(own[held])
                    values = np.zeros(int(numbers.max()) + 1 if held.any() else 0, np.int64)
                    values[numbers[held]] = own[held].view(np.int64)
                    plain, full, template, some = windows(np.zeros(b - a, np.int64), own, kinds, size)
                    whole = lambda words: span_hash(prefix_hash(words), np.array([0]), np.array([b - a])).view(np.int64)[0]
                    with np.errstate(over="ignore"):
                        family = whole(np.where(held, mix(PLACE[kinds] + numbers.astype(np.uint64)), own))
                    filled = np.concatenate([[0], np.cumsum(held)])
                    ids = batch.column(0).slice(x + r, 1)
                    for keys, at, kind in ((plain, full, False), (template, some, True)):
                        found = _rows_of(ids, np.zeros(1, np.int64), np.zeros(b - a, np.int64), numbers.view(np.uint64), kinds, size, keys, at, kind)
                        n, count = len(at), filled[at + size] - filled[at]
                        more = [pa.array(np.full(n, whole(own))), pa.array(np.full(n, family)), pa.array(np.full(n, len(full))), pa.array(count > 0), pa.array(count > size - LITERALS), pa.array([values if i == 0 and not kind else None for i in range(n)], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([*found.columns, *more], [*found.schema.names, "words", "family", "n_windows", "held", "dense", "values"])

    return _texts(items, "item_id").mapInArrow(run, SCHEMA + ", words long, family long, n_windows long, held boolean, dense boolean, values array<long>")


def _spans(texts: DataFrame) -> DataFrame:
    """Every run of RUN_WORDS words of texts (id, text): id, place, and a key that is equal for runs that agree but for the values of slots.

    Equal values must stand in the same slots; where under LITERALS words are no slots, the words themselves make the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offsets in text_slices(batch.column(1), SPAN_SLICE):
                rows, literal, slot = tokens(data, offsets)
                n = len(rows) - RUN_WORDS + 1
                at = np.flatnonzero(rows[:n] == rows[RUN_WORDS - 1 :]) if n > 0 else np.zeros(0, np.int64)
                keys = span_hash(prefix_hash(literal), at, at + RUN_WORDS)
                filled = np.concatenate([[0], np.cumsum(slot > 0)])
                count = filled[at + RUN_WORDS] - filled[at]
                some = np.flatnonzero((count > 0) & (count <= RUN_WORDS - LITERALS))
                places = at[some][:, None] + np.arange(RUN_WORDS)
                own, kinds = literal[places], slot[places]
                first = np.zeros(own.shape, np.uint64)
                for j in range(RUN_WORDS):  # where in the run each value stands first
                    first[:, j] = ((own[:, : j + 1] == own[:, j : j + 1]) & (kinds[:, : j + 1] > 0)).argmax(axis=1)
                with np.errstate(over="ignore"):
                    said = np.where(kinds > 0, mix((PLACE[kinds] + first).reshape(-1)).reshape(own.shape), own)
                    keys[some] = mix((said * SPAN_PLACES).sum(axis=1, dtype=np.uint64) + KIND[1])
                begin = np.searchsorted(rows, np.arange(y - x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x).take(pa.array(rows[at])), pa.array((at - begin[rows[at]]).astype(np.int64)), pa.array(keys.view(np.int64))], ["id", "place", "key"]
                )

    return texts.mapInArrow(run, "id long, place long, key long")


def wording_items(benchmark: DataFrame) -> DataFrame:
    """(wording, item_id): each item with each of its runs of RUN_WORDS words."""
    return _spans(_texts(benchmark, "item_id")).select(F.col("key").alias("wording"), F.col("id").alias("item_id")).distinct()


def wording(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every run of RUN_WORDS words that a document shares with any item, without a limit on how many items have it.

    doc_id, wording, the smallest item_id and the number of the items that have the run, its first place in the document and how often it is there.
    """
    known = settle(wording_items(benchmark).groupBy("wording").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")), "wording")
    found = _spans(_texts(docs, "doc_id")).where("id is not null").withColumnsRenamed({"id": "doc_id", "key": "wording"})
    mine = found.join(known.select("wording"), "wording", "left_semi").groupBy("doc_id", "wording").agg(F.min("place").alias("first_word"), F.count(F.lit(1)).alias("n_times"))
    return mine.join(known, "wording").select("doc_id", "wording", "item_id", "n_items", "first_word", "n_times")


def families(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id, family_id) of every item that can match: the smallest items with the same words, and with the same words but for the values of slots."""
    every = item_windows(benchmark).where("values is not null").select(F.col("id").alias("item_id"), "words", "family").distinct()
    every = settle(every, "members")
    classes, heads = every.groupBy("words").agg(F.min("item_id").alias("class_id")), every.groupBy("family").agg(F.min("item_id").alias("family_id"))
    return every.join(classes, "words").join(heads, "family").select("item_id", "class_id", "family_id")


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _lined(found: DataFrame, owner: str) -> DataFrame:
    """Alignments of documents with families or items, by the shift between their words."""
    return found.groupBy("doc_id", owner, "shift").agg(
        F.collect_set(F.when(~F.col("template"), F.col("item_place"))).alias("plain"),
        F.collect_set(F.when(F.col("template"), F.col("item_place"))).alias("template"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))))).alias("pairs"),
        F.collect_set(F.when(F.col("told"), F.col("item_place"))).alias("own"),
    )


def _aligned(seen: DataFrame, windows: DataFrame, owner: str, also: DataFrame | None = None) -> DataFrame:
    """All windows that documents share with owners of which they hold an indexed window, and with those of ``also``."""
    columns = ["doc_id", owner, "shift", "item_place", "template", "item_slots", "slots", "told"]
    first = seen.join(windows.where("indexed").drop("template"), "key").withColumn("shift", F.col("place") - F.col("item_place"))
    first = settle(first.select(*columns), f"{owner}_windows")
    tried = first.select("doc_id", owner, "shift")
    tried = (tried if also is None else tried.union(also.select("doc_id", owner, "shift"))).distinct()
    rest = tried.join(windows.where("not indexed").drop("template"), owner).withColumn("place", F.col("item_place") + F.col("shift"))
    every = first.union(rest.join(seen, ["doc_id", "key", "place"]).select(*columns))
    return every.groupBy("doc_id", owner, "shift").agg(
        F.collect_set(F.when(~F.col("template"), F.col("item_place"))).alias("plain"),
        F.collect_set(F.when(F.col("template"), F.col("item_place"))).alias("template"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))))).alias("pairs"),
        F.collect_set(F.when(F.col("told"), F.col("item_place"))).alias("own"),
    )


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item class.

    doc_id, item_id, n_matched of n_windows windows, the longest run in words,
    the first and last matched word in the document, slots with other values,
    and the item's family: its smallest item, whose members families() gives.
    """
    spark = docs.sparkSession
    every = settle(item_windows(benchmark), "item_windows")
    items = every.where("values is not null").groupBy("words", "family").agg(F.min("id").alias("item_id"), F.first("values").alias("values"), F.first("n_windows").alias("n_windows"), F.first("size").alias("size"))
    heads = items.groupBy("family").agg(F.min(F.struct("item_id", "words")).alias("head"), F.count(F.lit(1)).alias("members"))
    items = settle(items.join(heads, "family").withColumn("first", F.col("words") == F.col("head.words")).withColumn("family_id", F.col("head.item_id")).drop("head"), "items")
    # windows without slots and templates are looked up by family, others by item
    common = F.col("template") | ~F.col("held")
    every = every.drop("values").distinct().join(items.select("words", "item_id", "first"), "words").where(F.col("id") == F.col("item_id"))
    every = every.where(F.col("first") | ~common).withColumn("owner", F.when(common, F.col("family")).otherwise(F.col("words"))).withColumn("common", common)
    every = every.withColumnsRenamed({"place": "item_place", "slots": "item_slots"})
    spread = every.groupBy("key").agg(F.countDistinct("common", "owner").alias("owners"))
    every = every.join(spread, "key").withColumn("told", F.col("owners") <= SHARED_ITEMS)
    every = settle(every, "owned_windows")
    # owners that could be half matched without a told window are looked up by all of theirs
    places = lambda which: F.count_distinct(F.when(which, F.col("item_place")))
    of_family = every.where("common").groupBy("family").agg(
        F.max("told").alias("family_any"), places(F.col("told") & ~F.col("template")).alias("family_told"), places(~F.col("told")).alias("family_rest"), places(~F.col("template")).alias("family_plain")
    )
    of_item = every.where("not common").groupBy("words").agg(F.max("told").alias("item_any"), places(F.col("told")).alias("item_told"), places(~F.col("told")).alias("item_rest"))
    every = every.join(of_family, "family", "left").join(of_item, "words", "left")
    half = lambda n: n >= SHARE * F.col("n_windows")
    of_owner = F.when(F.col("common"), ~F.col("family_any") | half(F.col("family_rest"))).otherwise(~F.col("item_any") | F.col("dense") | half(F.col("item_rest") + F.coalesce("family_plain", F.lit(0))))
    every = settle(every.withColumn("indexed", F.col("told") | of_owner), "item_keys")
    # at most BITMAP_WORDS rows, whatever the benchmark's size
    high = F.shiftrightunsigned("key", 40)
    held = every.groupBy(F.shiftright(high, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(BITMAP_WORDS, dtype=np.int64)
    bits[[r.word for r in held]] = [r.bits for r in held]
    sizes = sorted(r[0] for r in every.select("size").distinct().collect())  # WORDS - SHORTEST + 1 rows at most
    bitmap = spark.sparkContext.broadcast(bits.view(np.uint64))
    seen = document_windows(docs, bitmap, sizes).where("id is not null").withColumnRenamed("id", "doc_id").drop("size")
    seen = settle(seen.join(every.select("key").distinct(), "key", "left_semi"), "document_windows")
    windows_of = lambda owner: every.where("common" if owner == "family" else "not common").select(owner, "key", "item_place", "item_slots", "template", "told", "indexed")
    families = _aligned(seen, windows_of("family"), "family")
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda x: x[side])))
    agree = (distinct("item") == F.size("pairs")) & (distinct("doc") == F.size("pairs"))
    families = settle(families.withColumn("agree", agree), "families")
    # where slots disagree, plain windows of members that only many items have count as well
    loose = every.where("not common and not indexed").select("family", "words").distinct()
    own = _aligned(seen, windows_of("words"), "words", families.where("not agree").join(loose, "family"))
    items = items.join(of_family, "family", "left").join(of_item, "words", "left")
    items = settle(items.withColumn("n_told", F.coalesce("family_told", F.lit(0)) + F.coalesce("item_told", F.lit(0))).withColumn("any_told", F.coalesce("family_any", F.lit(False)) | F.coalesce("item_any", F.lit(False))), "items")
    shown = families.withColumnsRenamed({"plain": "family_plain_at", "own": "family_own_at"})
    none = F.array().cast("array<long>")
    # of a family of over SHARED_ITEMS items, those whose own values a document has, or else the first
    every_member = shown.join(items.where(F.col("first") | (F.col("members") <= SHARED_ITEMS)), "family")
    whole = _judged(every_member.withColumn("plain", none).withColumn("own", none))
    named = _judged(own.drop("template", "pairs").join(items, "words").join(shown, ["doc_id", "family", "shift"], "left"))
    named = settle(named, "named")
    large = named.where(F.col("members") > SHARED_ITEMS).select("doc_id", "family").distinct()
    told = named.unionByName(whole.where(F.col("members") <= SHARED_ITEMS)).unionByName(whole.where(F.col("members") > SHARED_ITEMS).join(large, ["doc_id", "family"], "left_anti"))
    best = F.max(F.struct("n_matched", "run_words", -F.col("first_word"), "n_windows", "first_word", "last_word", "n_changed_slots")).alias("x")
    told = told.groupBy("doc_id", "item_id", "family_id").agg(best)
    return told.select("doc_id", "item_id", *[F.col(f"x.{c}").alias(c) for c in ("n_matched", "n_windows", "run_words", "first_word", "last_word", "n_changed_slots")], "family_id")


def _judged(lined: DataFrame) -> DataFrame:
    """Alignments that are contaminated: half of all windows or of the told ones match, or a run with a told one is long enough."""
    none = F.array().cast("array<long>")
    both = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none))
    agree = F.coalesce("agree", F.lit(False))
    lined = lined.withColumn("places", F.sort_array(both(both("plain", "family_plain_at"), F.when(agree, F.col("template"))))).withColumn("told_at", both("own", "family_own_at"))
    run = F.aggregate(
        "places",
        F.expr("named_struct('last', -2L, 'run', 0L, 'told', false, 'best', 0L, 'best_told', 0L)"),
        lambda s, x: _step(s, x, F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1).cast("long"), F.array_contains("told_at", x) | (s["told"] & (x == s["last"] + 1)) | ~F.col("any_told")),
    )
    lined = lined.where(F.size("places") > 0).withColumn("run", run).select(
        "doc_id",
        "family",
        "members",
        "item_id",
        "family_id",
        "n_windows",
        F.size("places").cast("long").alias("n_matched"),
        F.size(F.array_intersect("places", "told_at")).alias("n_matched_told"),
        "n_told",
        (F.col("run.best") + F.col("size") - 1).alias("run_words"),
        F.when(F.col("run.best_told") > 0, F.col("run.best_told") + F.col("size") - 1).otherwise(0).alias("run_told"),
        (F.array_min("places") + F.col("shift")).alias("first_word"),
        (F.array_max("places") + F.col("shift") + F.col("size") - 1).alias("last_word"),
        F.when(agree, F.size(F.filter("pairs", lambda x: F.get("values", x["item"].cast("int")) != x["doc"]))).otherwise(0).cast("long").alias("n_changed_slots"),
    )
    half = (F.col("n_matched") >= SHARE * F.col("n_windows")) | ((F.col("n_told") > 0) & (F.col("n_matched_told") >= SHARE * F.col("n_told")))
    return lined.where(half | (F.col("run_told") >= RUN_WORDS))


def _step(s, place, run, told):
    return F.struct(place.alias("last"), run.alias("run"), told.alias("told"), F.greatest(s["best"], run).alias("best"), F.greatest(s["best_told"], F.when(told, run).otherwise(0).cast("long")).alias("best_told"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay.  Rows without doc_id are told apart by their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).bitwiseOR(F.lit(-(1 << 63))))
    found = settle(matches(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_contaminated")).distinct(), "contaminated")
    return docs.join(found, key == found["_contaminated"], "left_anti")
