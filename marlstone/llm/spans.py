"""Vectorised work on UTF-8 text: words, pre-tokens, span hashes, lookup tables.

Python only sees whole Arrow batches.  A batch of texts is one byte array with
offsets; words are (start, end) spans found by array comparisons; a span's
64-bit hash mixes each of its 8-byte blocks with the block's place, so that
equal spans have equal hashes wherever they stand, and no pattern of bytes
makes unequal ones agree more often than chance.  No function here knows about Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one round of array operations; a longer text is one round.
SLICE_BYTES = 1 << 18

U64 = np.uint64
# Character classes.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: The first k bytes of a little-endian block.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_PLACE, _SECOND, _SIZE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)


class Slice:
    """Some whole texts: ``data`` is their UTF-8, text i spans offsets[i]:offsets[i+1]."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1
        self._blocks: np.ndarray | None = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each of the ascending positions lies in."""
        edges = np.searchsorted(positions, self.offsets)
        return np.repeat(np.arange(self.n), np.diff(edges))

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending positions each text holds."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum over its bytes' flags."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def starts_flag(self) -> np.ndarray:
        """Marks the first byte of every non-empty text; one longer than data."""
        flag = np.zeros(len(self.data) + 1, bool)
        flag[self.offsets] = True
        return flag

    def _block(self, at: np.ndarray, left: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        """The 8 bytes at each position, of which ``left`` count, keyed with their number within the span."""
        if self._blocks is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._blocks = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        return (self._blocks[at] & _FIRST_BYTES[np.minimum(left, 8)]) ^ (_PLACE * np.asarray(number + 1, U64))

    def _sums(self, starts: np.ndarray, ends: np.ndarray, mixers: tuple) -> list[np.ndarray]:
        """For each mixer, the sums over each span's blocks."""
        sizes = ends - starts
        block = self._block(starts, sizes, 0)
        out = [f(block) for f in mixers]
        long = np.flatnonzero(sizes > 8)
        if len(long):
            more = (sizes[long] - 1) // 8
            heads = np.cumsum(more) - more
            number = np.arange(int(more.sum())) - np.repeat(heads - 1, more)
            block = self._block(np.repeat(starts[long], more) + 8 * number, np.repeat(sizes[long], more) - 8 * number, number)
            for total, f in zip(out, mixers, strict=True):
                total[long] += np.add.reduceat(f(block), heads)
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans; equal bytes give equal hashes."""
        (total,) = self._sums(starts, ends, (mix,))
        return mix(total + (ends - starts).astype(U64) * _SIZE)

    def checked_hashes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes and, with their lengths, 32 bits of a second, independent one."""
        total, second = self._sums(starts, ends, (mix, _second_mix))
        sizes = (ends - starts).astype(U64) * _SIZE
        return mix(total + sizes), (_second_mix(second ^ sizes) >> U64(32)).astype(np.uint32)


def _second_mix(x: np.ndarray) -> np.ndarray:
    x = x * _SECOND
    x = (x ^ (x >> U64(31))) * _PLACE
    return x ^ (x >> U64(30))


def distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct (hash, check) pairs, and which of them each row is."""
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    if (checks[where][back] != checks).any():  # equal hashes of unequal spans
        both = np.stack([hashes, checks.astype(U64)], axis=1)
        _, where, back = np.unique(both, axis=0, return_index=True, return_inverse=True)
    return where, back.ravel()


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts (null: empty) into slices of whole texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1
        last = min(n, max(last, first + 1))
        a, b = offsets[first], offsets[last]
        yield Slice(first, data[a:b], offsets[first : last + 1] - a)
        first = last


def parts(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, part) of a batch cut into parts of at most ``rows`` rows and, unless it is one row, ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(total, total[first] + size, side="right")) - 1
        last = min(batch.num_rows, first + rows, max(last, first + 1))
        yield first, batch.slice(first, last - first)
        first = last


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(piece: Slice) -> Slice:
    """A-Z to a-z; all else as it is."""
    return Slice(piece.first, _LOWER[piece.data], piece.offsets)


def words(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~_ASCII_SPACE[piece.data]
    edge = piece.starts_flag()
    before = np.empty(len(inside), bool)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within one text, and the index of each run's first word."""
    if len(hashes) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(hashes) - width + 1
    at = np.flatnonzero(docs[:m] == docs[width - 1 :])
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[at + k]
    return mix(out), at


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letters, numbers, white space, others."""
    import unicodedata

    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0x9FFD or 0xAC00 <= c < 0xD7A4:
            table[c] = LETTER
            continue
        if c >= 0x323B0 and c < 0xE0000:
            continue
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The class of the character that each byte belongs to; which bytes continue one (None: none do)."""
    table = _classes()
    out = table[:256][data]
    high = data >= 0x80
    if not high.any():
        return out, None
    follows = (data & 0xC0) == 0x80
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    for least, most, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        at = np.flatnonzero((data >= least) & (data < most)) if most < 0x100 else np.flatnonzero(data >= least)
        if not len(at):
            continue
        code = padded[at] & bits
        for k in range(1, size):
            code = (code << 6) | (padded[at + k] & 0x3F)
        kinds = table[np.minimum(code, 0x10FFFF)]
        for k in range(size):
            out[np.minimum(at + k, len(out) - 1)] = kinds
    return out, follows


def _shift(flags: np.ndarray, by: int) -> np.ndarray:
    """flags moved to the right (by > 0) or left, with zeros moved in."""
    out = np.zeros_like(flags)
    if by > 0:
        out[by:] = flags[:-by]
    else:
        out[:by] = flags[-by:]
    return out


def _contractions(data: np.ndarray, first_quote: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of quotes that begin 's 't 'm 'd 're 've 'll, and the bytes that each of those spans."""
    at = np.flatnonzero(first_quote)
    if not len(at):
        return at, at
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    ends = np.concatenate([edge, np.ones(2, bool)])
    a, b = padded[at + 1].copy(), padded[at + 2].copy()
    a[ends[at + 1]] = 0
    b[ends[at + 2] | ends[at + 1]] = 0
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    size = np.where(one, 2, np.where(two, 3, 0))
    return at[size > 0], size[size > 0]


def byte_level_pretokens(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the matches of the usual byte-level pattern

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,

    found by comparing neighbours: a match begins where the class changes, a
    single blank goes to what follows it, and the last of several white-space
    characters before a word stands apart.
    """
    data = piece.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, follows = byte_classes(data)
    edge = piece.starts_flag()
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    space = kind == SPACE
    # The last character of a white-space run that a word follows in the same text.
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    last = np.flatnonzero(ends_run)
    lead = last
    if follows is not None and len(last):  # from the last byte to the first of that character
        lead = last.copy()
        for _ in range(3):
            lead = np.where(follows[lead], lead - 1, lead)
    starts = change.copy()
    starts[lead] = True
    blank = lead[data[last] == 0x20]  # goes to what follows
    starts[blank + 1] = False
    quote = change & (data == ord("'"))
    if quote.any():
        after_blank = np.zeros(n + 1, bool)
        after_blank[blank + 1] = True
        at, size = _contractions(data, quote & ~after_blank[:-1], edge)
        if len(at):
            starts[at] = True
            for k in range(1, 3):
                starts[at[size > k] + k] = False
            beyond = at + size
            beyond = beyond[beyond < n]
            starts[beyond[~space[beyond] | edge[beyond]]] = True
            # White space after a contraction is split as it is elsewhere: its flags stand.
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    return begin, end


def lone_pretokens(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``."""
    data = piece.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, follows = byte_classes(data)
    edge = piece.starts_flag()
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    number = kind == NUMBER
    starts = change | (number if follows is None else number & ~follows)
    quote = change & (data == ord("'"))
    if quote.any():
        at, size = _contractions(data, quote, edge)
        if len(at):
            for k in range(1, 3):
                starts[at[size > k] + k] = False
            beyond = at + size
            starts[beyond[beyond < n]] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    keep = kind[begin] != SPACE
    return begin[keep], end[keep]


class SpanTable:
    """64-bit hash, with or without a 32-bit check, to small integer, looked up and filled by whole arrays.

    Open addressing in flat arrays.  ``limit`` bounds the entries: when a
    fill would exceed it, ``full`` is true and the owner starts a new table.
    """

    def __init__(self, limit: int = 1 << 20, checked: bool = False) -> None:
        self.limit = limit
        self.size = 1 << (2 * limit - 1).bit_length()
        self.mask = U64(self.size - 1)
        self.keys = np.zeros(self.size, U64)
        self.values = np.zeros(self.size, np.int32)
        self.checks = np.zeros(self.size, np.uint32) if checked else None
        self.count = 0

    def full(self, more: int) -> bool:
        return self.count + more > self.limit

    @staticmethod
    def _key(hashes: np.ndarray) -> np.ndarray:
        return np.where(hashes == 0, U64(1), hashes)

    def _same(self, slot: np.ndarray, held: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None) -> np.ndarray:
        same = held == hashes
        return same if checks is None else same & (self.checks[slot] == checks)

    def find(self, hashes: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """The value of each hash, -1 where it is not held."""
        hashes = self._key(hashes)
        slot = (hashes >> U64(20)) & self.mask
        held = self.keys[slot]
        same = self._same(slot, held, hashes, checks)
        out = np.where(same, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero(~same & (held != 0))
        step = U64(1)
        while len(open_):
            at = (slot[open_] + step) & self.mask
            held = self.keys[at]
            same = self._same(at, held, hashes[open_], None if checks is None else checks[open_])
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (held != 0)]
            step += U64(1)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray, checks: np.ndarray | None = None) -> None:
        """Add distinct hashes that are not held."""
        hashes = self._key(hashes)
        self.count += len(hashes)
        todo = np.arange(len(hashes))
        slot = (hashes >> U64(20)) & self.mask
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]
            if checks is not None:
                self.checks[at[free]] = checks[todo[free]]
            mine = self._same(at, self.keys[at], hashes[todo], None if checks is None else checks[todo])
            self.values[at[mine]] = values[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + U64(1)) & self.mask


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[starts[i] : starts[i] + sizes[i]] for all i, one after another."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    some = sizes > 0
    starts, sizes = starts[some], sizes[some]
    if not len(sizes):
        return data[:0]
    heads = np.cumsum(sizes) - sizes
    out[heads[0]] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + sizes[:-1]) + 1
    np.cumsum(out, out=out)
    return data[out]
