"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are taken in stretches of about so many bytes, which bounds the arrays that go with them.
STRETCH = 1 << 17
_KEY = 0x6D6573686C61726B
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15))
#: Longer words are hashed one by one.
_LONG = 64


def class_of(spaces: bytes | None = None, keep: bytes | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, the byte after lower-casing A-Z): all but ``spaces``, or ``keep`` and all bytes from 0x80."""
    word = np.ones(256, dtype=bool)
    if keep is not None:
        word[:128] = False
        word[np.frombuffer(keep, np.uint8)] = True
    if spaces is not None:
        word[np.frombuffer(spaces, np.uint8)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return word[fold], fold


#: Words between ASCII white space, as they stand.
PLAIN = class_of(spaces=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of digits, letters a-z and everything from U+0080, after lower-casing A-Z.
FOLDED = class_of(keep=b"0123456789abcdefghijklmnopqrstuvwxyz", lower=True)


@dataclass
class Words:
    """Words of consecutive texts ``first .. first + len(begins) - 1`` of a column.

    ``hashes``, ``starts`` and ``ends`` (bytes in ``data``) have an entry a word; text ``t`` has the words
    ``begins[t]:stops[t]`` and the bytes ``offsets[t]:offsets[t + 1]``.  ``data`` is lower-cased if the words are, and
    ends in eight bytes of padding."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray
    stops: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; ``data`` ends in eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def _masks(left: np.ndarray) -> np.ndarray:
    """Those bits of eight bytes that belong to a word with so many bytes left."""
    return np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hashes of words, eight bytes at a time; ``data`` as in :func:`_eights`.

    Equal hashes only name candidates: what follows from them is compared word by word (:func:`same_words`)."""
    eights, length = _eights(data), ends - starts
    out = mixed(np.uint64(_KEY) ^ length.astype(np.uint64))
    live = np.flatnonzero(length <= _LONG)
    for k in range(0, _LONG, 8):
        live = live[length[live] > k]
        if not len(live):
            break
        out[live] = mixed(out[live] ^ (eights[starts[live] + k] & _masks(length[live] - k)))
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), _KEY)
    return out


def same_words(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether words are equal byte for byte, pair by pair; ``a`` and ``b`` as in :func:`_eights`."""
    length = a_ends - a_starts
    same = length == b_ends - b_starts
    live, one, two = np.flatnonzero(same), _eights(a), _eights(b)
    for k in range(0, _LONG, 8):
        live = live[length[live] > k]
        if not len(live):
            return same
        good = ((one[a_starts[live] + k] ^ two[b_starts[live] + k]) & _masks(length[live] - k)) == 0
        same[live[~good]] = False
        live = live[good]
    for i in live[length[live] > _LONG].tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_ends[i]], b[b_starts[i] : b_ends[i]])
    return same


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, with null as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def words_of(column: pa.Array, kind: tuple[np.ndarray, np.ndarray], stretch: int = STRETCH) -> Iterator[Words]:
    """Words with 64-bit hashes.  Whole texts only; a text longer than a stretch is a stretch of its own."""
    is_word, fold = kind
    offsets, data = string_parts(column)
    n, first = len(column), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + stretch, "right")) - 1)
        last = min(last, n)
        own = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        inside = is_word[raw]
        # a word begins where one byte is inside and the one before is not, or belongs to another text
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edge = own[:-1][own[:-1] < len(raw)]
        begin[edge] = inside[edge]
        stop = np.zeros(len(raw) + 1, bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:]
        edge = own[1:][own[1:] > 0]
        stop[edge] = inside[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
        padded = np.zeros(len(raw) + 8, np.uint8)
        np.take(fold, raw, out=padded[: len(raw)])
        hashes = word_hashes(padded, starts, ends)
        yield Words(first, padded, own, hashes, starts, ends, np.searchsorted(starts, own[:-1]), np.searchsorted(starts, own[1:]))
        first = last


def grams(hashes: np.ndarray, size: int, at: np.ndarray | None = None, other: bool = False) -> np.ndarray:
    """Hashes of ``size`` consecutive words, from every position (or those given) that has so many after it.

    ``other`` gives a second hash that doesn't depend on the first."""
    if at is None:
        at = np.arange(max(0, len(hashes) - size + 1))
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _STEPS[other] + hashes[at + k]
    return mixed(out)
