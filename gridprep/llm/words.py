"""Words and word shingles of a batch of texts as arrays of 64-bit hashes.

All functions work on the bytes of a whole Arrow column at once. Words are cut at ASCII white space
and A-Z are lower-cased; with `letters_only`, other ASCII signs and the common typographic ones part
words too. Memory is a few bytes for each byte of text, with 64-bit intermediates only for
blocks of `BLOCK` bytes, so one very long text is no special case.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SIGNS = WHITE.copy()
SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = True

_random = np.random.default_rng(20240501)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# one multiplier for each place in a shingle
PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base, count):
    out = np.empty(count, np.uint64)
    out[0] = 1
    done = 1
    while done < count:  # doubling: the second half is the first times base ** done
        more = min(done, count - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_POWERS = _powers(_BASE, BLOCK)
_INVERSES = _powers(_INVERSE, BLOCK)


def mix(x):
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column):
    """The bytes of a string column and the offsets of its rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets, most):
    """Ranges of rows with about `most` bytes each; a longer row has its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _blank_signs(data):
    """Blanks for the typographic signs of U+00A0-00BF, U+2000-207F and U+3000-303F."""
    data = data.copy()
    if len(data) > 1:
        two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0))
        data[two] = data[two + 1] = 32
    if len(data) > 2:
        lead = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3))
        second = data[lead + 1]
        lead = lead[np.where(data[lead] == 0xE2, (second == 0x80) | (second == 0x81), second == 0x80)]
        data[lead] = data[lead + 1] = data[lead + 2] = 32
    return data


def word_bounds(data, offsets, letters_only=False):
    """(starts, ends, word offsets of the rows)."""
    part = (SIGNS if letters_only else WHITE)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = ~part
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = part[:-1]
    starts = np.flatnonzero(inside & (before | first[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = True
        after[:-1] = part[1:]
    ends = np.flatnonzero(inside & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, offsets, letters_only=False, most=None):
    """(mixed hash of every word, or of its first `most` bytes; word offsets of the rows)."""
    if letters_only:
        data = _blank_signs(data)
    starts, ends, word_offsets = word_bounds(data, offsets, letters_only)
    if most is not None:
        ends = np.minimum(ends, starts + most)
    at_start = np.empty(len(starts), np.uint64)
    at_end = np.empty(len(ends), np.uint64)
    back = np.empty(len(starts), np.uint64)
    carry = 0
    for low in range(0, len(data), BLOCK):
        piece = _BYTE[data[low:low + BLOCK]] * _POWERS[:len(data[low:low + BLOCK])]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece, dtype=np.uint64)])
        scale, offset = np.uint64(pow(_BASE, low, 1 << 64)), np.uint64(carry)
        a, b = np.searchsorted(starts, [low, low + BLOCK])
        at_start[a:b] = sums[starts[a:b] - low] * scale + offset
        back[a:b] = _INVERSES[starts[a:b] - low] * np.uint64(pow(_INVERSE, low, 1 << 64))
        a, b = np.searchsorted(ends, [low + 1, low + BLOCK + 1])
        at_end[a:b] = sums[ends[a:b] - low] * scale + offset
        carry = (int(sums[-1]) * int(scale) + carry) % (1 << 64)
    return mix((at_end - at_start) * back), word_offsets


def shingle_hashes(words, word_offsets, size):
    """(hash of every shingle of `size` words, shingle offsets of the rows).

    A row with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    counts = np.diff(word_offsets)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(made)])
    whole = len(words) - size + 1
    if whole > 0:
        sums = np.zeros(whole, np.uint64)
        for place in range(size):
            sums += words[place:place + whole] * PLACES[place]
        every = mix(sums + np.uint64(size))
    else:
        every = np.empty(0, np.uint64)
    keep = np.zeros(len(words) + 1, np.int32)  # starts of whole shingles: not the last size - 1 words of a row
    long = counts >= size
    np.add.at(keep, word_offsets[:-1][long], 1)
    np.add.at(keep, word_offsets[1:][long] - size + 1, -1)
    out = np.empty(offsets[-1], np.uint64)
    target = np.ones(len(out), bool)
    target[offsets[:-1][(counts < size) & (counts > 0)]] = False
    out[target] = every[np.cumsum(keep)[:max(whole, 0)] > 0]
    for row in np.flatnonzero((counts < size) & (counts > 0)):
        n = int(counts[row])
        a = word_offsets[row]
        with np.errstate(over="ignore"):
            out[offsets[row]] = mix(np.array([(words[a:a + n] * PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)]))[0]
    return out, offsets


def distinct(values):
    """The sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def as_signed(values):
    return values.view(np.int64)
