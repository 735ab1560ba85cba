from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing

TEXTS = [None, "", "it's John's can't we'll 'sure", "a  b\n\n c \n", "!'s x's' é'è  12 3 ,,,", "word " * 9000, "日本 語'm ’s", "same", "same", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>start", "end  <|endoftext|>",
         "fused<|endoftext|>words<|endoftext|><|endoftext|>'s", "<|endoftext", "|> <|endoftext|<|endoftext|>|>", "\n <|endoftext|>\n\n x", "endoftext|>"]


def public_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=60))
def test_windows_hold_each_item_once_within_capacity(sizes):
    found = packing.windows(sizes, 512)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 512 for w in found)


def test_differencing_is_near_equal():
    sizes = [8, 7, 6, 5, 4, 3, 3, 2, 2]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 4)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2


def test_pieces_cover_each_id_once(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(docs).collect()
    want = dict(enumerate(public_ids(TEXTS)))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        piece = np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(want[r.doc_id])
    for doc, ids in want.items():
        own = sorted(by_doc[doc], key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r["offset"] == at
            at += r.length
        assert at <= 2048


def test_ids_of_a_whole_table_are_those_of_the_vocabulary_file():
    import pyarrow.parquet as pq

    from siltstone.llm.bytetext import text_slices
    from siltstone.llm.subwords import encode_slice, encoder

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text")
    got = []
    for a, b, data, offsets in text_slices(texts):
        ids, bounds = encode_slice(data, offsets, encoder())
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(b - a)]
    assert got == public_ids(texts.to_pylist())


def test_long_documents_go_through_differencing():
    import zlib as z

    ids = np.arange(300_000) % 50_000
    found = packing.pack_chunk([1, 2], np.array([0, 299_000, 300_000]), ids, 0)
    filled = {}
    for s, n in zip(found["sequence_id"], found["length"], strict=True):
        filled[s] = filled.get(s, 0) + n
    assert sum(filled.values()) == 300_000 and max(filled.values()) <= 2048
    # a sequence is padded to 2048 unless its length is a power of two
    assert sum(n if n & (n - 1) == 0 else 2048 for n in filled.values()) <= 300_000 * 1.03
    assert max(found["length"]) <= packing.LONG_ITEM
    assert found["ids_crc32"][0] == z.crc32(ids[found["start"][0] : found["start"][0] + found["length"][0]].astype("<u4").tobytes())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
