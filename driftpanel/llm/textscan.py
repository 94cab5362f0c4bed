"""Vectorised scans of text columns: words, lines, n-gram hashes.

Everything works on the UTF-8 bytes of a whole Arrow column at once. Hashes are
64 bits: a polynomial over a random byte table, mixed at the end. A polynomial modulo
2^64 is blind to some differences of a thousand places and more, so it is only used over
CHUNK bytes, whose mixed hashes are added, and over few words; runs of any number of words
are hashed modulo two primes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
STEP = 2 << 20  # bytes of text looked at together
CHUNK = 64  # bytes hashed by one polynomial


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GRAM_BASE = 0xD1342543DE82EF95
# Of runs of words: two primes below 2^31, a base and its inverse for each.
PRIMES = (2147483647, 2147483629)
RUN_BASES = (1270390397, 803184221)
RUN_INVERSES = tuple(pow(b, -1, q) for b, q in zip(RUN_BASES, PRIMES, strict=True))
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words between ASCII white space, and words of ASCII letters, digits and all else.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LEADING = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point


class _Powers:
    """Powers of the hash base, as many as the longest column needed so far."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 2 * len(cls.up))
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                row = np.full(size, base, U)
                row[0] = 1
                setattr(cls, name, np.cumprod(row, dtype=U))
        return cls.up[:n], cls.down[: n + 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `step` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + step, "right")))
            to = min(to, at + 60_000)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a column: byte spans, hashes, and the first word of each row."""

    data: np.ndarray
    offsets: np.ndarray
    is_word: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # rows + 1
    hashes: np.ndarray
    prefix: np.ndarray  # prefix sums of the byte hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, starts, ends)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _Powers.of(len(data))
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up, out=prefix[1:])
    return prefix


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span stands."""
    size = ends - starts
    out = mix(plain_hash(prefix, starts, ends) + size.astype(U))
    long = np.flatnonzero(size > CHUNK)
    if len(long):
        n = -(-size[long] // CHUNK)
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n)
        begin = np.repeat(starts[long], n) + k * CHUNK
        end = np.minimum(begin + CHUNK, np.repeat(ends[long], n))
        parts = mix(mix(plain_hash(prefix, begin, end) + (end - begin).astype(U)) + mix((k + 1).astype(U)))
        out[long] = mix(np.add.reduceat(parts, first) + size[long].astype(U))
    return out


def unshift(n: int) -> np.ndarray:
    """What a span's difference of prefixes is multiplied with, by its start."""
    return _Powers.of(n)[1]


def plain_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hash, but neither mixed nor told apart by length: for tables that spread keys themselves."""
    return (prefix[ends] - prefix[starts]) * unshift(len(prefix) - 1)[starts]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = LOWER[data]
    is_word = table[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    prefix = byte_prefix(data)
    return Words(data, offsets, is_word, starts, ends, np.searchsorted(starts, offsets),
                 span_hash(prefix, starts, ends), prefix)


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of words at which n words of the same row begin."""
    total = int(first[-1])
    fits = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    long = counts >= n
    np.add.at(fits, first[:-1][long], 1)
    np.add.at(fits, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:-1]) > 0)


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each position."""
    total = np.zeros(len(at), U)
    for k in range(n):
        total *= U(GRAM_BASE)
        total += hashes[at + k]
    return mix(total + U(n))


def order_by(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by row, then value; ties keep their order."""
    order = np.argsort(values, kind="stable")
    return order[np.argsort(rows[order].astype(np.uint16), kind="stable")]


def distinct_sets(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values without repeats, sorted by row and value."""
    order = order_by(rows, values)
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def repeated(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its value stand twice in its row; did it stand before."""
    order = order_by(rows, values)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (rows[order][1:] == rows[order][:-1]) & (values[order][1:] == values[order][:-1])
    twice, before = np.empty(len(order), bool), np.empty(len(order), bool)
    twice[order] = same[:-1] | same[1:]
    before[order] = same[:-1]
    return twice, before


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a span of n words that begins at one of `at`."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and rows of the \n-split lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    per_row = 1 + np.diff(np.searchsorted(breaks, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)


RUN_POWERS: dict[tuple[int, int], np.ndarray] = {}  # as many as the longest column needed so far


def run_powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo the prime."""
    out = RUN_POWERS.get((base, prime), np.ones(1, U))
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), prime)) % U(prime)])
    RUN_POWERS[base, prime] = out
    return out[:n]


class Sequence:
    """Hashes of any run of words, and of a run without one word, from prefix sums modulo two primes."""

    def __init__(self, hashes: np.ndarray) -> None:
        n, self.fields = len(hashes) + 1, []
        for part, prime, base, inverse in zip((hashes >> U(32), hashes & U(0xFFFFFFFF)), PRIMES, RUN_BASES, RUN_INVERSES, strict=True):
            up = run_powers(base, prime, n)
            prefix = np.zeros(n, U)
            np.cumsum(part % U(prime) * up[:-1] % U(prime), out=prefix[1:])
            self.fields.append((U(prime), up, run_powers(inverse, prime, n), prefix))

    @staticmethod
    def _joined(parts: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        return mix(mix(parts[0] << U(31) | parts[1]) + size.astype(U))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._joined([(prefix[ends] - prefix[starts]) % q * down[starts] % q for q, _, down, prefix in self.fields], ends - starts)

    def without(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As if the word at `at` weren't there."""
        parts = []
        for q, up, down, prefix in self.fields:
            head = (prefix[at] - prefix[starts]) % q * down[starts] % q
            tail = (prefix[ends] - prefix[at + 1]) % q * down[at + 1] % q
            parts.append((head + tail * up[at - starts]) % q)
        return self._joined(parts, ends - starts - 1)


def signed(values: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind) if kind else pa.array(values))
