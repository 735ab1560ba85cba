"""Subword ids of whole text columns, each distinct piece encoded once.

A byte-level vocabulary first cuts the text at its special tokens, then into
pieces by a fixed pattern, and encodes each piece by itself.  The cut is done
here with arrays over code points; a piece met before in this worker is not
encoded again.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from siltstone.llm.bytetext import mix, prefix_hash, span_hash

END_ID = 1
CACHE_PIECES = 800_000

# Classes of code points in the pattern: letter, number, white space, other.
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
# The endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            if a < 0xD800 < b:
                out[a:0xD800] = kind
                a = 0xD800
            out[shift(a) : shift(b - 1) + 1] = kind
    return out


@lru_cache(1)
def code_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def piece_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a new piece starts, over the code points of joined texts."""
    n = len(codes)
    kind = classes()[codes]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run_start = np.flatnonzero(start)
    run_end = np.append(run_start[1:], n)
    run_kind = kind[run_start]
    # a white run before another run of its text gives up its last code point
    white = (run_kind == WHITE) & ~border[run_end]
    last = run_end[white] - 1
    start[last] = True
    joins = codes[last] == 32
    start[last[joins] + 1] = False
    # endings after an apostrophe that itself starts a piece
    marks = np.flatnonzero((codes == 39) & start)
    if len(marks):
        texts = np.searchsorted(offsets, marks, side="right") - 1
        limit = offsets[texts + 1]
        for p, end in zip(marks.tolist(), limit.tolist(), strict=True):
            ahead = "".join(map(chr, codes[p + 1 : min(p + 3, end)].tolist()))
            size = 1 if ahead[:1] in ENDINGS else 2 if ahead in ENDINGS else 0
            if size:
                start[p + 1] = False
                if p + 1 + size < end:
                    inner = kind[p + 1 + size]
                    if inner == LETTER:
                        start[p + 1 + size] = True
    return np.flatnonzero(start)


class Memory:
    """Ids of the pieces that a worker has met, up to a bound."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.at = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)

    def _add(self, key: int, ids: list[int]) -> int:
        k = len(self.known)
        if k == len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[key] = k
        return k

    def ragged(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each piece has."""
        size = self.size[numbers]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        index = np.arange(total) + np.repeat(self.at[numbers] - begin, size)
        return self.pool[index], size


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself where it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}


class Encoder(Memory):
    """Encodes joined texts with a vocabulary file of ``tokenizers``, its special tokens included.

    Merges of that vocabulary have the order of their ids, so ``tiktoken`` gives
    the same ids for a piece, in a tenth of the time; the tests hold that.
    """

    def __init__(self, vocabulary_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer, of = Tokenizer.from_file(vocabulary_path), byte_alphabet()
        self.special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.encode() not in self.special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans_of_specials(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens stand in joined texts, leftmost first, none across two texts."""
        if not any(s in raw for s in self.special):
            return []
        found = [m.span() for m in regex.finditer(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), raw, overlapped=True)]
        out: list[tuple[int, int]] = []
        for a, b in found:
            text = int(np.searchsorted(offsets, a, side="right"))
            if b <= offsets[text] and (not out or a >= out[-1][1]):
                out.append((a, b))
        return out

    def pieces(self, data: np.ndarray, at_byte: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece in this encoder's memory; at_byte: where each code point starts in data."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        hashes = span_hash(prefix_hash(code_values()[codes]), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known, raw = self.known, data.tobytes()
        begin, stop = at_byte[starts[first]].tolist(), at_byte[ends[first]].tolist()
        numbers = [known.get(key, -1) for key in distinct.tolist()]
        new = np.flatnonzero(np.array(numbers) < 0).tolist()
        for i in new:
            piece = raw[begin[i] : stop[i]]
            numbers[i] = self._add(int(distinct[i]), [self.special[piece]] if piece in self.special else self.encoding.encode_ordinary(piece.decode()))
        return np.array(numbers, dtype=np.int64)[inverse]


@lru_cache(2)
def encoder(vocabulary_path: str | None = None) -> Encoder:
    import public_tokenizers

    return Encoder(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))


def encode_slice(data: np.ndarray, offsets: np.ndarray, coder: Encoder, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text of a slice of UTF-8 bytes, with END_ID after each if ``end``: (ids, offsets)."""
    lead = (data & 0xC0) != 0x80
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=before[1:])
    at = before[offsets]
    n = len(offsets) - 1
    if len(codes):
        special = before[np.array(coder.spans_of_specials(raw, offsets), dtype=np.int64).reshape(-1, 2)]
        starts = piece_starts(codes, np.unique(np.concatenate([at, special.ravel()])) if len(special) else at)
        if len(special):  # one piece each
            within = np.zeros(len(codes) + 1, dtype=np.int8)
            within[special[:, 0] + 1] = 1
            within[special[:, 1]] -= 1
            starts = starts[np.cumsum(within)[starts] == 0]
        ends = np.append(starts[1:], len(codes))
        at_byte = np.append(np.flatnonzero(lead), len(data))
        ids, size = coder.ragged(coder.pieces(data, at_byte, codes, starts, ends))
        filled = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(size, out=filled[1:])
        bounds = filled[np.searchsorted(starts, at)]
    else:
        ids, bounds = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    if end:
        ids = np.insert(ids, bounds[1:], END_ID)
        bounds = bounds + np.arange(n + 1)
    return ids, bounds
