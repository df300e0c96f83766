"""Words of many texts at once: numpy over the bytes of an Arrow string column, with no Python object per word.

A chunk is a run of whole texts laid end to end. Words never cross from one text to the next, and chunks are cut at
texts so that the arrays stay small whatever an Arrow batch holds; one text longer than the limit is a chunk alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes from which a word is hashed by XXH64.
LONG_WORD = 256
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_LIMIT = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit number per byte value; with lower, A-Z have those of a-z."""
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def _space_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alnum_table() -> np.ndarray:
    """Digits, letters and all bytes of characters beyond ASCII; A-Z counts as a-z."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = True
    table[128:] = True
    return table


#: Words split at white space, and words of letters and digits.
SPACE, ALNUM = _space_table(), _alnum_table()
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def strings(column: pa.Array) -> pa.StringArray:
    """column as strings without nulls: a null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of at most limit bytes, or of one text."""
    column = strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per): byte places of the words, and where each text's words begin among them (one more than texts)."""
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


class Hasher:
    """64-bit hashes of words, from running sums of byte codes times powers of an odd base modulo 2**64.

    Such sums have collisions that can be written down, but only among words of about a thousand bytes; words of LONG_WORD bytes or more get XXH64 instead.
    """

    def __init__(self, lower: bool = False, base: int = _BASE):
        self.lower = lower
        self.codes, self.base, self.inverse = _byte_codes(lower), base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, b & _WORD_LIMIT, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grown(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=sums[1:])
        out = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        long_ = np.flatnonzero(ends - starts >= LONG_WORD)
        if len(long_):
            raw = (LOWER_BYTES[data] if self.lower else data).tobytes()
            out[long_] = xxh64(raw, starts[long_], ends[long_], self.base & 0xFFFFFFFF)
        return out


def window_hashes(h: np.ndarray, per: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, valid) of the `size` words from each word on; valid where they lie in one text."""
    n = len(h)
    valid = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if n >= size:
        b = np.uint64(base | 1)
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc *= b
            acc += h[k : k + len(acc)]
        out[: len(acc)] = mixed(acc)
    room = np.repeat(per[1:], np.diff(per)) - np.arange(n)
    valid[:] = room >= size
    return out, valid


def normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The (kept) words, each followed by one space, and where each word begins in that, with the end as last entry.

    `keep` marks words; a dropped word has no length.
    """
    lengths = ends - starts + 1
    if keep is not None:
        lengths = np.where(keep, lengths, 0)
        starts = starts[keep]
        used = lengths[keep]
    else:
        used = lengths
    at = np.concatenate(([0], np.cumsum(lengths)))
    total = int(at[-1])
    if not total:
        return b"", at
    first = np.concatenate(([0], np.cumsum(used)[:-1]))
    source = np.arange(total) + np.repeat(starts - first, used)
    last = first + used - 1
    source[last] = 0
    out = data[source]
    out[last] = 0x20
    return out.tobytes(), at


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: bytes, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the bytes of data between each begin and end, all at once: a step of the hash is taken for all pieces that have it."""
    raw = data + bytes(8)
    at_any = lambda kind, size: np.ndarray((len(raw) - size + 1,), kind, raw, 0, (1,))
    eights, fours, ones = at_any("<u8", 8), at_any("<u4", 4), np.frombuffer(raw, np.uint8)
    mix = lambda lane, value: _turned(lane + value * _P2, 31) * _P1
    at, left = begin.astype(np.int64), (end - begin).astype(np.int64)
    out = np.full(len(at), np.uint64(seed) + _P5)
    long_ = np.flatnonzero(left >= 32)
    if len(long_):
        with np.errstate(over="ignore"):
            starts = [np.uint64(seed) + _P1 + _P2, np.uint64(seed) + _P2, np.uint64(seed), np.uint64(seed) - _P1]
        lanes = [np.full(len(long_), v) for v in starts]
        while len(todo := np.flatnonzero(left[long_] >= 32)):
            rows = long_[todo]
            for k, lane in enumerate(lanes):
                lane[todo] = mix(lane[todo], eights[at[rows] + 8 * k])
            at[rows] += 32
            left[rows] -= 32
        whole = sum(_turned(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18)))
        for lane in lanes:
            whole = (whole ^ mix(np.zeros_like(lane), lane)) * _P1 + _P4
        out[long_] = whole
    out += (end - begin).astype(np.uint64)
    while len(rows := np.flatnonzero(left >= 8)):
        out[rows] = _turned(out[rows] ^ mix(np.zeros(len(rows), np.uint64), eights[at[rows]]), 27) * _P1 + _P4
        at[rows] += 8
        left[rows] -= 8
    if len(rows := np.flatnonzero(left >= 4)):
        out[rows] = _turned(out[rows] ^ (fours[at[rows]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[rows] += 4
        left[rows] -= 4
    while len(rows := np.flatnonzero(left)):
        out[rows] = _turned(out[rows] ^ (ones[at[rows]].astype(np.uint64) * _P5), 11) * _P1
        at[rows] += 1
        left[rows] -= 1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    return out ^ (out >> np.uint64(32))
