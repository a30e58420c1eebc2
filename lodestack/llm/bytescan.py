"""Vectorised scanning of the UTF-8 buffers that Arrow hands to Python.

No Python string is made: a batch column is one byte buffer plus offsets, word
bounds come from table look-ups on the bytes, and the hash of every word comes
from two running polynomial sums, each modulo a prime.  Work goes block by block, so
that memory follows the block and the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time: what fits in a core's cache.
BLOCK = 1 << 16
#: (prime, base): two polynomials of 31 bits each make the hash of a word.
_FIELDS = ((2_147_483_647, 1_389_796_733), (2_147_483_629, 945_177_431))

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = _table(SPACE_BYTES)
#: Words are runs of ASCII letters and digits and of all non-ASCII bytes.
ALPHANUMERIC = _table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A-Z to a-z, all else as it is.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def text_blocks(column: pa.Array, most: int = 8 * BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``most`` bytes.

    Null texts count as empty.  A text over ``most`` bytes is a run of its own.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(ends, ends[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, raw[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and per text the index of its first word (one more at the end)."""
    inside = table[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(inside)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def _powers(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``base`` and of its inverse, up to ``BLOCK``."""
    out = []
    for b in (base, pow(base, -1, prime)):
        powers = np.ones(1, np.uint64)
        while len(powers) <= BLOCK:
            powers = np.concatenate([powers, powers * np.uint64(pow(b, len(powers), prime)) % np.uint64(prime)])
        out.append(powers[: BLOCK + 1])
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (in order, apart), letters A-Z in lower case; a word may span blocks."""
    sums = [np.zeros((2, len(starts)), np.uint64) for _ in _FIELDS]
    first = np.searchsorted(starts, np.arange(0, len(raw) + BLOCK, BLOCK))
    last = np.searchsorted(ends - 1, np.arange(0, len(raw) + BLOCK, BLOCK))
    total = np.zeros(BLOCK + 1, np.uint64)
    carried, scale = [0] * len(_FIELDS), [(1, 1)] * len(_FIELDS)
    for block, left in enumerate(range(0, len(raw), BLOCK)):
        codes = LOWER[raw[left : left + BLOCK]].astype(np.uint64) + np.uint64(1)
        mine, closing = slice(first[block], first[block + 1]), slice(last[block], last[block + 1])
        for i, (prime, base) in enumerate(_FIELDS):
            up, down = _powers(prime, base)
            p, (here, back) = np.uint64(prime), scale[i]
            # Codes under 2^9 times powers under 2^31, 2^16 of them: no overflow.
            np.cumsum(codes * up[: len(codes)], out=total[1 : len(codes) + 1])
            for row, at in ((0, starts[mine] - left), (1, ends[closing] - left)):
                sums[i][row, mine if row == 0 else closing] = (np.uint64(carried[i]) + total[at] % p * np.uint64(here)) % p
            # The start's inverse power, kept in the place of its sum: what is between start and end is all that is wanted.
            if mine.stop > mine.start:
                inverse = down[starts[mine] - left] * np.uint64(back) % p
                sums[i][0, mine] |= inverse << np.uint64(32)
            carried[i] = int((carried[i] + int(total[len(codes)]) % prime * here) % prime)
            scale[i] = (here * int(up[BLOCK]) % prime, back * int(down[BLOCK]) % prime)
    out = np.zeros(len(starts), np.uint64)
    for i, (prime, _) in enumerate(_FIELDS):
        p = np.uint64(prime)
        before, inverse = sums[i][0] & np.uint64(0xFFFFFFFF), sums[i][0] >> np.uint64(32)
        out |= (sums[i][1] + p - before) % p * inverse % p << np.uint64(31 * i)
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text; of fewer words, that of the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(n - width + 1, np.uint64(width * 0x2545F491 + 1))
    for j in range(width):
        out += words[j : n - width + 1 + j] * odd[j]
    return mix(out)
