"""Vectorised words, lines and shingles of whole texts.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  Hashes are polynomial prefix sums over
the UTF-8 bytes, finished by a mixer, so a slice of many documents is hashed by a
handful of numpy passes and never by a loop over words.  The polynomials are taken
modulo two primes with random bases: unlike modulo 2**64 there are no texts that clash
under every base (such as Thue-Morse words), and two different ranges of n bytes clash
with a probability of at most (n / 2**31)**2 over the bases, 2**-62 on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text hashed at once; one longer document is hashed alone, still whole.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: The primes below 2**31, and for each lane of hashes a base modulo either.
_PRIMES = (2147483647, 2147483629)
_BASES = ((1442695041, 1812433253), (1103515245, 1566083941))
#: Bytes up to which sums of 8-bit by 31-bit products fit 64 bits.
_FITS = 1 << 24
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: int, prime: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``prime``."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out, done = np.ones(size, np.uint64), 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += more
        if size > 4 * SLICE_BYTES:
            return out[:n]
        _powers[base, prime] = have = out
    return have[:n]


class Text:
    """Byte-level view of some documents: ``buf`` with ``offsets`` of each document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        solid = ~_SPACE[buf]
        self.solid = solid
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(buf):
            before[1:], after[:-1] = solid[:-1], solid[1:]
            edges = offsets[:-1]
            before[edges[edges < len(buf)]] = False
            edges = offsets[1:]
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n)
        self._sums: dict[tuple[int, int], np.ndarray] = {}

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """62-bit hashes of the byte ranges, mixed over 64 bits; those of either lane are independent of the other's."""
        first, second = (self._residues(starts, ends, base, prime) for base, prime in zip(_BASES[lane], _PRIMES, strict=True))
        return mix((first << np.uint64(31)) + second)

    def _residues(self, starts: np.ndarray, ends: np.ndarray, base: int, prime: int) -> np.ndarray:
        size, modulus = len(self.buf) + 1, np.uint64(prime)
        if (base, prime) not in self._sums:
            terms = _power(base, prime, size)[:-1] * (self.buf.astype(np.uint64) + np.uint64(1))
            if size > _FITS:
                terms %= modulus
            sums = np.empty(size, np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            self._sums[base, prime] = sums
        sums = self._sums[base, prime]
        return (sums[ends] - sums[starts]) % modulus * _power(pow(base, -1, prime), prime, size)[starts] % modulus

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each document at which ``mask`` holds."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        return self.per_doc(self.solid & ((self.buf & 0xC0) != 0x80))

    def symbols(self) -> np.ndarray:
        return self.per_doc(_SYMBOL[self.buf])

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, hash and number of solid bytes of each line split by ``\\n``."""
        cuts = np.flatnonzero(self.buf == 0x0A)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cuts, "right") - 1])[order]
        ends = np.append(starts[1:] - 1, len(self.buf)) if len(starts) else starts
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        ends[last] = self.offsets[1:][doc[last]]
        solid = np.concatenate([[0], np.cumsum(self.solid, dtype=np.int64)])
        return doc, self.hashes(starts, ends), solid[ends] - solid[starts]

    def shingles(self, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and hash of every window of ``n`` words of one document."""
        words = self.word_hashes()
        size = max(0, len(words) - n + 1)
        keep = np.flatnonzero(self.doc[:size] == self.doc[n - 1 :]) if size else np.zeros(0, np.int64)
        total = np.zeros(len(keep), np.uint64)
        for k in range(n):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[keep + k]
        return self.doc[keep], keep, mix(total)


def text_of(strings: list[bytes]) -> Text:
    """``Text`` of documents given as UTF-8."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)])
    return Text(np.frombuffer(b"".join(strings), np.uint8), offsets)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """Consecutive slices of a string column of at most ``most`` bytes or one row; null is ''."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, Text(buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    pa.default_memory_pool().release_unused()


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) in order of document, with their counts."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(doc)))
