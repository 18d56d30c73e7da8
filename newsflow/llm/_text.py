"""Vectorised tokenising of Arrow string columns on UTF-8 bytes.

Word classes used here are closed under UTF-8: every byte of a multi-byte character is >= 0x80
and belongs to a word, so byte tables give the same words as the character classes.
Words are identified by a 64-bit hash of their (folded) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time; four arrays of eight bytes per input byte are live meanwhile.
PIECE = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 2**64)
_RANDOM = np.random.default_rng(7).integers(1, 2**64, 256, dtype=U)
_pow: dict[int, np.ndarray] = {}

_ALL = np.arange(256)
FOLD = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding: digits, letters and everything outside ASCII
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((FOLD >= 0x61) & (FOLD <= 0x7A)) | (_ALL >= 0x80)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, PIECE + 1), base, dtype=U)
        step[0] = 1
        have = _pow[base] = np.cumprod(step, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U(0xD6E8FEB86659FD93) + (b ^ U(0xA5A5A5A55A5A5A5A)) * U(_MUL))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)), off


def _pieces(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(lo + PIECE, end)
        while hi < end:
            free = np.flatnonzero(~is_word[data[lo:hi]])
            doc = off[np.searchsorted(off, hi, "right") - 1]
            cut = max(int(free[-1]) + lo + 1 if len(free) else lo, int(doc) if doc > lo else lo)
            if cut > lo:
                hi = cut
                break
            hi = min(hi + PIECE, end)
        yield lo, hi
        lo = hi


def words(texts: pa.Array, is_word: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i+1]]."""
    data, off = utf8(texts)
    table = _RANDOM[FOLD] if fold else _RANDOM
    hashes, starts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(data, off, is_word):
        b = data[lo:hi]
        w = is_word[b]
        n = len(b)
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        edge[off[np.searchsorted(off, lo) : np.searchsorted(off, hi, "right")] - lo] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = w[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = w[1:]
        s = np.flatnonzero(w & (~before | edge[:-1]))
        e = np.flatnonzero(w & (~after | edge[1:])) + 1
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum(table[b] * powers(_MUL, n), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * powers(_INV, n + 1)[s]))
        starts.append(s + lo)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(s, off)


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gives the hash of any byte span of b."""
    total = np.empty(len(b) + 1, U)
    total[0] = 0
    np.cumsum(_RANDOM[b] * powers(_MUL, len(b)), out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(_INV, len(total))[start])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about limit bytes, one row at least."""
    _, off = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j
