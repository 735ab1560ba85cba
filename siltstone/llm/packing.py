"""Packing of documents into training windows by Karmarkar-Karp differencing.

Each task encodes its documents and packs them in chunks of CHUNK_TOKENS
tokens.  A document is cut into items: of LONG_ITEM tokens as long as a window
or more of it is left, then of ITEM_TOKENS at most.  Multiway
differencing merges partial partitions, largest difference first, heavy slots
of one onto light slots of the other, into near-equal windows.  If one
exceeds the capacity, the window count rises by one and the merge is redone.
No row leaves its task: there is no shuffle, and memory is bounded by a chunk
plus the longest document.

Edge cases: a null or empty text is the end id alone; a text of any length is
cut; an empty table gives no rows; repeated rows are packed like others; other
columns are ignored; order within a task only decides which window a piece
goes to.  sequence_id is unique: the task's partition number in the high bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytetext import text_slices
from siltstone.llm.subwords import encode_slice, encoder

WINDOW = 2048
LONG_ITEM, ITEM_TOKENS = 1024, 256
CHUNK_TOKENS = 262_144
#: Windows that lack more than this are cut at powers of two instead of padded.
LOOSE = WINDOW // 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_tokens long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items into k slots with near-equal sums by multiway differencing; item numbers by slot."""
    if not sizes:
        return []
    # a partition: (slot sums ascending, their trees); slots with nothing yet are left out
    trees: list[tuple[int, int]] = []  # inner nodes: the two nodes that were put together; leaves are item numbers
    n = len(sizes)
    full = lambda sums: int(sums[-1]) - (int(sums[0]) if len(sums) == k else 0)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    parts = {i: (np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)) for i, s in enumerate(sizes)}
    heapq.heapify(heap)
    at = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (a, p), (b, q) = parts.pop(x), parts.pop(y)
        if len(a) < len(b):
            (a, p), (b, q) = (b, q), (a, p)
        shared = max(0, len(a) + len(b) - k)
        sums, nodes = np.concatenate([a, b[shared:]]), np.concatenate([p, q[shared:]])
        if shared:  # the lightest slots of both meet, in opposing order
            sums[:shared] += b[:shared][::-1]
            for i in range(shared):
                trees.append((int(p[i]), int(q[shared - 1 - i])))
                nodes[i] = n + len(trees) - 1
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[0]
        parts[at] = (sums, nodes)
        heapq.heappush(heap, (-full(sums), at))
        at += 1
    (_, nodes), out = parts.popitem()[1], []
    for root in nodes.tolist():
        stack, own = [root], []
        while stack:
            node = stack.pop()
            if node < n:
                own.append(node)
            else:
                stack.extend(trees[node - n])
        out.append(own)
    return out


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """The fewest near-equal windows that differencing fits under the capacity."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += 1


def pack_chunk(doc_ids: list[int], bounds: np.ndarray, ids: np.ndarray, first: int) -> dict[str, list[int]]:
    """Pieces of one chunk; sequences count from ``first``."""
    out: dict[str, list[int]] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")}
    raw = ids.astype("<u4").tobytes()
    items: list[tuple[int, int, int]] = []  # document, start, length

    def put(doc: int, start: int, length: int, sequence: int, offset: int, tokens: int) -> None:
        base = int(bounds[doc]) + start
        row = (doc_ids[doc], start, length, zlib.crc32(raw[4 * base : 4 * (base + length)]), int(bounds[doc + 1] - bounds[doc]), sequence, offset, tokens)
        for c, v in zip(out, row, strict=True):
            out[c].append(v)

    sequence = first
    for doc in range(len(doc_ids)):
        total, start = int(bounds[doc + 1] - bounds[doc]), 0
        while start < total:
            length = LONG_ITEM if total - start >= WINDOW else min(ITEM_TOKENS, total - start)
            items.append((doc, start, length))
            start += length
    for own in windows([length for _, _, length in items]):
        lack = WINDOW - sum(items[i][2] for i in own)
        limit = WINDOW - lack
        sizes = [limit] if lack <= LOOSE else [1 << b for b in range(11, -1, -1) if limit >> b & 1]
        room, filled = sizes[0], 0
        left = sizes[1:]
        for i in sorted(own):
            doc, start, length = items[i]
            while length:
                if filled == room:
                    sequence, room, filled = sequence + 1, left.pop(0), 0
                take = min(length, room - filled)
                put(doc, start, take, sequence, filled, room)
                start, length, filled = start + take, length - take, filled + take
        sequence += 1
    return out


def pack(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary_path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        doc_ids, parts, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, doc_ids, parts, sizes, held
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
            found = pack_chunk(doc_ids, bounds, np.concatenate(parts), sequence)
            sequence = found["sequence_id"][-1] + 1
            doc_ids, parts, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in found.items()})

        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids, bounds = encode_slice(data, offsets, coder)
                for r in range(a, b):
                    piece = ids[bounds[r - a] : bounds[r - a + 1]]
                    doc_ids.append(own[r])
                    parts.append(piece)
                    sizes.append(len(piece))
                    held += len(piece)
                    if held >= CHUNK_TOKENS:
                        yield flush()
        if doc_ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
