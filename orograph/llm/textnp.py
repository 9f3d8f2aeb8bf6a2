"""Array helpers for tasks: words and hashes of a batch of texts, without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A 64-bit value for each byte.
BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: The prime 2**31 - 1, and pairs of bases: a hash is two polynomials modulo the prime, 62 bits together.
PRIME = (1 << 31) - 1
BASES = ((0x2F0B4A17, 0x5C1DE3F9), (0x6B8B4567, 0x327B23C6))


def mod_prime(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**31 - 1, for any 64-bit ``x``."""
    x = (x & U(PRIME)) + (x >> U(31))
    x = (x & U(PRIME)) + (x >> U(31))
    return np.minimum(x, x - U(PRIME))  # below the prime the difference wraps round to a large number


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(max(n, 1), np.uint32)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = mod_prime(out[:take].astype(U) * U(pow(base, done, PRIME)))
        done += take
    return out


_kept: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = powers(base, max(n, 1 << 16))
    return _kept[base]


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit values, from running sums of two polynomials modulo a prime.

    With an even modulus constructible stretches collide whatever the base; a prime has none
    that do not depend on it. ``seed`` picks another pair of bases.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        n = len(values)
        self.sums, self.back = [], []
        for base, part in zip(BASES[seed], (values & U(PRIME), values >> U(33)), strict=True):
            run = np.zeros(n + 1, U)
            part *= power_table(base, n + 1)[:n]
            high = part >> U(31)
            part &= U(PRIME)
            part += high
            np.cumsum(part, out=run[1:])
            self.sums.append(run)
            self.back.append(power_table(pow(base, -1, PRIME), n + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal stretches have equal hashes, wherever they start."""
        one, two = (mod_prime(mod_prime(run[end] - run[start]) * back[start]) for run, back in zip(self.sums, self.back, strict=True))
        return mix64(one | two << U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Give memory that a finished batch has used back to the machine: workers outlive their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batch: pa.RecordBatch, most: int = CHUNK, texts: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, a row at least."""
    _, offs = buffers(batch.column("text") if texts is None else texts)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    release()


class Words:
    """Words (runs of other bytes than the six ASCII white spaces) of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offs = buffers(texts)
        self.n_docs = len(self.offs) - 1
        word = ~SPACE[self.buf]
        first = np.zeros(len(self.buf) + 1, bool)
        first[self.offs] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:-1]
        end = word.copy()
        if len(end):
            end[:-1] &= ~word[1:] | first[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        #: words of document d: bounds[d] .. bounds[d + 1]
        self.bounds = np.searchsorted(self.start, self.offs, "left")

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def hashes(self, table: np.ndarray = BYTE) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        return Prefix(table[self.buf]).of(self.start, self.end)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each distinct word's first use, number of the distinct word at each place), told apart by their bytes."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
        return distinct_stretches(self.buf[inside], np.concatenate([[0], np.cumsum(self.end - self.start)]))

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        return lead[self.end] - lead[self.start]

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each stretch bounds[i] .. bounds[i + 1]; empty ones give 0."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]


def distinct_stretches(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first use, number) of each distinct stretch of bytes between neighbouring offsets; the bytes themselves are compared."""
    n = len(offs) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = pa.large_binary() if offs[-1] >= 1 << 31 else pa.binary()
    offs = np.ascontiguousarray(offs, np.int64 if kind == pa.large_binary() else np.int32)
    found = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return first_uses(codes, len(found.dictionary)), codes


def first_uses(codes: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct key's first use, number of the distinct key at each place)."""
    import pandas as pd

    codes, found = pd.factorize(keys)
    return first_uses(codes, len(found)), codes
