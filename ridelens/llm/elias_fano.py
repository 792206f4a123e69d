"""Elias-Fano sequences and array files, in numpy.

A monotone sequence of n numbers below u keeps the low log2(u/n) bits of each
number, rounded up to a machine type (above 32 bits packed), and the high parts
as a unary bit vector.  `find` looks many keys up at once: the zeros of the bit
vector delimit the numbers sharing a high part, and a binary search on the low
bits ends there.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
TYPES = {16: np.uint16, 32: np.uint32}  # widths of low parts that need no packing
MANY = 256  # elements decoded in the time of one search
STRIP = 512  # rows of 64 values unpacked together, within a core's cache
BLOCK = 2  # words of the bit vector per directory entry


def or_into(out: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """OR the bits into their words (ascending, repeated)."""
    if len(word):
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[first]] |= np.bitwise_or.reduceat(bits, first)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """`width` low bits of each value, one after the other, in 64-bit words."""
    if not width or not len(values):
        return np.zeros(2, U64)
    out = np.zeros((len(values) * width + 63) // 64 + 2, U64)
    at = np.arange(len(values), dtype=U64) * U64(width)
    word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
    or_into(out, word, values << shift)
    over = shift + U64(width) > U64(64)
    or_into(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


def low_parts(values: np.ndarray, width: int) -> np.ndarray:
    """`width` low bits of each value, as one of TYPES or packed."""
    return values.astype(TYPES[width]) if width in TYPES else pack_bits(values & U64((1 << width) - 1), width)


def unpack_all(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n values: 64 of them fill `width` words, so each column of such
    rows is one shift of one or two columns of words."""
    out, mask = np.zeros(n, U64), U64((1 << width) - 1)
    if not width:
        return out
    rows = n // 64
    source, target = words[:rows * width].reshape(rows, width), out[:rows * 64].reshape(rows, 64)
    for a in range(0, rows, STRIP):
        strip, to = np.ascontiguousarray(source[a:a + STRIP].T), np.empty((64, min(STRIP, rows - a)), U64)
        for j in range(64):
            word, shift = divmod(j * width, 64)
            np.right_shift(strip[word], U64(shift), out=to[j])
            if shift + width > 64:
                to[j] |= strip[word + 1] << U64(64 - shift)
        to &= mask
        target[a:a + STRIP] = to.T
    out[rows * 64:] = unpack_bits(words, width, np.arange(rows * 64, n))
    return out


def unpack_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U64)
    if width in TYPES:
        return words[index].astype(U64)
    at = index.astype(U64) * U64(width)
    word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
    value = words[word] >> shift
    over = shift + U64(width) > U64(64)
    value[over] |= words[word[over] + 1] << (U64(64) - shift[over])
    return value & U64((1 << width) - 1)


class EliasFano:
    """Arrays: meta (n, low width, number of zeros), low, high, zeros (zeros of
    the bit vector before each block of words)."""

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.n_zeros = (int(x) for x in meta)
        self.low, self.high, self.zeros = low, high, zeros

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of ascending uint64 values."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        width = next((w for w in TYPES if 0 < width <= w), width)
        upper = values >> U64(width)
        n_zeros = (int(upper[-1]) if n else 0) + 1
        words = (n + n_zeros + 63) // 64
        words += -words % BLOCK
        high = np.zeros(words, U64)
        at = upper + np.arange(n, dtype=U64)
        or_into(high, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        ones = np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(axis=1)
        zeros = np.concatenate([[0], np.cumsum(64 * BLOCK - ones)]).astype(np.uint32 if words < 1 << 25 else np.int64)
        return {"meta": np.array([n, width, n_zeros], np.int64),
                "low": low_parts(values, width), "high": high, "zeros": zeros}

    def _place(self, k: np.ndarray, directory: np.ndarray, words: np.ndarray, flip: bool) -> np.ndarray:
        """Position of bit number k (from 0) among the zeros (`flip`) or ones,
        given how many stand before each block."""
        block = np.searchsorted(directory, k, "right") - 1
        rest = k - directory[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            bits = ~words[word] if flip else words[word]
            inside = np.bitwise_count(bits).astype(np.int64)
            on = rest >= inside
            rest = np.where(on, rest - inside, rest)
            word = word + on
        bits = ~words[word] if flip else words[word]
        at = word * 64
        for half in (32, 16, 8, 4, 2, 1):  # halve the window that holds the bit
            low = bits & U64((1 << half) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            on = rest >= count
            rest = np.where(on, rest - count, rest)
            bits = np.where(on, bits >> U64(half), low)
            at += on * half
        return at

    def _zero_at(self, k: np.ndarray) -> np.ndarray:
        return self._place(k, self.zeros, self.high, True)

    def _bucket(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last index of the elements that share a key's high
        part, which must be below the number of zeros."""
        h = (keys >> U64(self.width)).astype(np.int64)
        start = np.zeros(len(h), np.int64)
        later = h > 0
        start[later] = self._zero_at(h[later] - 1) - (h[later] - 1)
        return start, self._zero_at(h) - h

    def _search(self, low_key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First index in [start, end) whose low bits reach the key's."""
        start, end = start.copy(), end.copy()
        open_ = np.flatnonzero(start < end)
        while len(open_):
            mid = (start[open_] + end[open_]) >> 1
            less = unpack_bits(self.low, self.width, mid) < low_key[open_]
            start[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[start[open_] < end[open_]]
        return start

    def _inside(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(keys >> U64(self.width) < U64(self.n_zeros))

    def values(self) -> np.ndarray:
        """All elements."""
        bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little", count=self.n + self.n_zeros).view(bool)
        if self.n_zeros < self.n // 2:  # fewer high parts than elements: repeat each
            ends = np.flatnonzero(~bits) - np.arange(self.n_zeros)
            upper = np.repeat(np.arange(self.n_zeros, dtype=U64) << U64(self.width), np.diff(ends, prepend=0))
        else:
            upper = (np.flatnonzero(bits) - np.arange(self.n)).view(U64)
            upper <<= U64(self.width)
        upper |= self.low[:self.n] if self.width in TYPES else unpack_all(np.asarray(self.low), self.width, self.n)
        return upper

    def _many(self, queries: int) -> bool:
        """Whether decoding everything once costs less than that many searches."""
        return queries * MANY >= self.n

    def lower_bound(self, keys: np.ndarray) -> np.ndarray:
        """Index of the first element >= key."""
        if self._many(len(keys)):
            return _place_all(self.values(), keys)
        out = np.full(len(keys), self.n, np.int64)
        ok = self._inside(keys)
        start, end = self._bucket(keys[ok])
        out[ok] = self._search(keys[ok] & U64((1 << self.width) - 1), start, end)
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """Elements at the indices: the high part is the number of zeros before
        an element's one."""
        index = np.asarray(index, np.int64)
        if self._many(len(index)):
            return self.values()[index]
        ones = np.arange(len(self.zeros), dtype=np.int64) * (64 * BLOCK) - self.zeros
        upper = self._place(index, ones, self.high, False) - index
        return (upper.astype(U64) << U64(self.width)) | unpack_bits(self.low, self.width, index)

    def opened(self, queries: int) -> "EliasFano | np.ndarray":
        """For that many searches in all: the elements, decoded once, if that costs less."""
        return self.values() if self.n and self._many(queries) else self

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        if self._many(len(keys)):
            return _find_all(self.values(), keys)
        ok = self._inside(keys)
        start, end = self._bucket(keys[ok])
        filled = start < end
        ok, start, end = ok[filled], start[filled], end[filled]
        low_key = keys[ok] & U64((1 << self.width) - 1)
        at = self._search(low_key, start, end)
        inside = np.flatnonzero(at < end)  # equal high part; now the low bits
        hit = inside[unpack_bits(self.low, self.width, at[inside]) == low_key[inside]]
        out[ok[hit]] = at[hit]
        return out


def find(where: EliasFano | np.ndarray, keys: np.ndarray) -> np.ndarray:
    """`EliasFano.find`, also among elements already decoded."""
    return where.find(keys) if isinstance(where, EliasFano) else _find_all(where, keys)


def lower_bound(where: EliasFano | np.ndarray, keys: np.ndarray) -> np.ndarray:
    return where.lower_bound(keys) if isinstance(where, EliasFano) else _place_all(where, keys)


def _place_all(every: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """searchsorted in the order of the keys, which walks through the memory."""
    if len(keys) < 1000 or (keys[1:] >= keys[:-1]).all():
        return np.searchsorted(every, keys)
    order, out = np.argsort(keys), np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(every, keys[order])
    return out


def _find_all(every: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(_place_all(every, keys), len(every) - 1)
    return np.where(every[at] == keys, at, -1)


def write_arrays(stream, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON directory, then the arrays at multiples of 8 bytes."""
    entries, at = {}, 0
    for name, a in arrays.items():
        entries[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(entries).encode()
    head += b" " * (-len(head) % 8)
    stream.write(np.array([len(head)], "<u8").tobytes() + head)
    for a in arrays.values():
        stream.write(a.tobytes() + bytes(-a.nbytes % 8))


def read_arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Views into the bytes of such a file (memory-mapped or read)."""
    size = int(raw[:8].view("<u8")[0])
    entries = json.loads(raw[8:8 + size].tobytes())
    return {name: raw[8 + size + at:8 + size + at + n * np.dtype(dtype).itemsize].view(dtype)
            for name, (dtype, at, n) in entries.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}.{part}"] for part in ("meta", "low", "high", "zeros")))


def named(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in EliasFano.build(values).items()}
