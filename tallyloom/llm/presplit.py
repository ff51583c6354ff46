"""Splitting texts into the words of byte-level tokenizers, by whole columns.

The words of a text are the matches of ``PATTERN``. They follow one another without gaps, so only their
starts are needed, and these follow from the kinds of neighbouring characters: a word starts where the kind
(white space, letter, number, other) changes; a space before such a start belongs to it; of several
white-space characters before a word the last stands alone; and an apostrophe that starts a run of others
takes a contraction's letters with it. All of this is array arithmetic over the bytes of a batch, and the
words of a batch are one Arrow array over those same bytes.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-splitting pattern of byte-level BPE vocabularies (a fixed value). The code below gives its matches.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Second (and third) letters of contractions.
_SINGLE, _DOUBLE = b"stmd", (b"re", b"ve", b"ll")
#: Characters with the White_Space property (fixed values).
_SPACES = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16.0 added, which Python's own table (15.1) lacks (fixed values).
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point."""
    of = {"L": _LETTER, "N": _NUMBER}
    out = np.array([of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    out[list(_SPACES)] = _WHITE
    for kind, ranges in ((_LETTER, _NEW_LETTERS), (_NUMBER, _NEW_NUMBERS)):
        for a, z in ranges:
            out[a : z + 1] = kind
    return out


def _kinds_of(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8: that of its character."""
    table = _kinds()
    kinds = table[:256][data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        lead = wide[data[wide] >= 0xC0]
        first = data[lead]
        point, size = np.zeros(len(lead), np.int64), np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            of = np.flatnonzero(size == n)
            at = lead[of]
            p = first[of].astype(np.int64) & mask
            for k in range(1, n):
                p = p << 6 | padded[at + k] & 0x3F
            point[of] = p
        own = table[np.minimum(point, 0x10FFFF)]
        kinds[lead] = own
        for k in (1, 2, 3):
            of = size > k
            at = lead[of] + k
            inside = at < len(data)
            kinds[at[inside]] = own[of][inside]
    return kinds


def starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where words start. data: texts' bytes one after another; ends: where each text ends."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kinds = _kinds_of(data)
    first = np.zeros(n + 1, bool)  # of a text
    first[0] = first[ends] = True
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    after = np.flatnonzero(start[1:] & (kinds[:-1] == _WHITE) & ~first[1:n]) + 1  # a word after white space
    last = after - 1
    space = data[last] == 0x20
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[after[space]] = False
    start[last] = True
    mark = np.flatnonzero((data == 0x27) & start)
    if len(mark):
        padded, edge = np.concatenate((data, np.zeros(3, np.uint8))), np.concatenate((first, np.ones(3, bool)))
        a, b = padded[mark + 1], padded[mark + 2]
        size = np.where(np.isin(a, np.frombuffer(_SINGLE, np.uint8)), 1, 0)
        for x, y in _DOUBLE:
            size[(a == x) & (b == y) & ~edge[mark + 2]] = 2
        size[edge[mark + 1]] = 0
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + 1 + size
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Words:
    """The words of a column: distinct ones (binary), the number of each word, and how many words each
    text has."""

    def __init__(self, column: pa.Array, special: tuple[str, ...] = ()) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
        parts, of = _parts(column, special)
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(parts.buffers()[2], np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        edges = offsets - low
        at = starts(data, edges[1:])
        if of is not None:  # a special token is one word
            whole = of[1]
            inside = np.searchsorted(edges, at, "right") - 1
            at = at[~whole[inside] | (at == edges[inside])]
        bounds = np.append(at, len(data))
        each = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        self.distinct, self.number = each.dictionary, each.indices.to_numpy()
        before = np.searchsorted(at, edges)
        counts = np.diff(before)
        self.counts = counts if of is None else np.bincount(of[0], counts, len(column)).astype(np.int64)


def _parts(column: pa.Array, special: tuple[str, ...]) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray] | None]:
    """Texts with special tokens in them are cut before and after each: the parts; of each, its text and
    whether it is a special token. None for these if no text has any."""
    if not special:
        return column, None
    pattern = "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
    has = pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
    if not has.any():
        return column, None
    cut, names = regex.compile(f"({pattern})".encode()), {s.encode() for s in special}
    parts, of = [], []
    for i, text in enumerate(column.to_pylist()):
        for p in cut.split(text) if has[i] else [text]:
            parts.append(p)
            of.append(i)
    return pa.array(parts, pa.large_binary()), (np.array(of), np.array([p in names for p in parts]))


def flat(values: list[bytes] | pa.Array, counts: np.ndarray) -> pa.Array:
    """Joins neighbours of a binary array: the first counts[0], the next counts[1], ..."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    ends = offsets[np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(ends)), values.buffers()[2]])


def spread(known: np.ndarray, sizes: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has. known: ids of the distinct words one
    after another; sizes: how many each has."""
    places = np.cumsum(sizes) - sizes
    n = sizes[words.number]
    before = np.concatenate(([0], np.cumsum(n)))
    ids = known[np.repeat(places[words.number] - before[:-1], n) + np.arange(before[-1])]
    cuts = before[np.concatenate(([0], np.cumsum(words.counts)))]
    return ids, np.diff(cuts)


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value of each text: its ids, little-endian, as wide as they are given."""
    ends = np.concatenate(([0], np.cumsum(counts))) * ids.itemsize
    data = ids.astype(ids.dtype.newbyteorder("<"), copy=False)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
