"""Words and their hashes over whole Arrow columns of text, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text stands alone.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(separator) -> np.ndarray:
    return np.array([separator(b) for b in range(256)], bool)


#: Separators: space and the controls 9 to 13.
SPACES = _table(lambda b: b == 32 or 9 <= b <= 13)
#: Separators: all of ASCII but digits and letters.
MARKS = _table(lambda b: b < 128 and not chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: By number of bytes, the part of eight that they fill.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Texts(NamedTuple):
    """A run of texts: rows ``first`` to ``first + len(starts)`` of ``batch``."""

    batch: pa.RecordBatch
    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Words(NamedTuple):
    """Words of a run of texts: byte places, and for each text its first word and the one past its last."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray


def runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[Texts]:
    """The texts of all batches in runs of about ``CHUNK`` bytes; a null text is empty."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        array = array.fill_null("")
        if not len(array):
            continue
        _, places, values = array.buffers()
        offsets = np.frombuffer(places, np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(array):
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
            to = min(max(to, at + 1), len(array))
            low = offsets[at]
            yield Texts(
                batch,
                at,
                data[low : offsets[to]],
                offsets[at:to] - low,
                offsets[at + 1 : to + 1] - low,
            )
            at = to


def split(texts: Texts, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators; no word goes over the end of its text."""
    data = texts.data
    if not data.size:
        none = np.zeros(len(texts.starts), np.int64)
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), none, none)
    apart = separators[data]
    begins, ends = ~apart, ~apart
    fresh = np.zeros(data.size + 1, bool)
    fresh[texts.starts] = True
    fresh[texts.ends] = True
    begins[1:] &= apart[:-1] | fresh[1:-1]
    ends[:-1] &= apart[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    return Words(
        starts,
        np.flatnonzero(ends) + 1,
        np.searchsorted(starts, texts.starts),
        np.searchsorted(starts, texts.ends),
    )


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all bits of each 64-bit value over all of it."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= _ODD
    values ^= values >> np.uint64(29)
    return values


def salts(places: np.ndarray) -> np.ndarray:
    """A 64-bit value for each place."""
    return mix((places.astype(np.uint64) + np.uint64(1)) * _ODD)


def sequences(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash per stretch ``values[first:last]``, of its values in order and their number.

    Each value is mixed with its place before the sum, which no pattern of values cancels.
    """
    sizes = last - first
    before = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(before, sizes)
    held = values[place + np.repeat(first, sizes)]
    total = np.zeros(held.size + 1, np.uint64)
    np.cumsum(mix(held ^ salts(place)), out=total[1:])
    return mix(total[before + sizes] - total[before] + sizes.astype(np.uint64) * _ODD)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(data.size + 1, "<u8", padded, strides=(1,))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    sizes = ends - starts
    eight = eights(data)
    # the number of bytes tells zeros at the end from none
    out = mix(mix(eight[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _ODD)
    long = np.flatnonzero(sizes > 8)
    parts = (sizes[long] - 1) >> 3
    last = np.cumsum(parts)
    place = np.arange(parts.sum()) - np.repeat(last - parts, parts)
    at = np.repeat(starts[long] + 8, parts) + 8 * place
    left = np.minimum(np.repeat(ends[long], parts) - at, 8)
    out[long] = mix(out[long] + sequences(mix(eight[at] & _MASKS[left]), last - parts, last))
    return out


def hashes(texts: Texts, words: Words, fold_case: bool) -> np.ndarray:
    """One 64-bit hash per word."""
    return spans(LOWER[texts.data] if fold_case else texts.data, words.starts, words.ends)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring values, also of those that cross texts."""
    n = values.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = salts(np.arange(size)) | np.uint64(1)
    total = values[:n] * factors[0]
    for k in range(1, size):
        total += values[k : n + k] * factors[k]
    return mix(total)


def strings(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes (eight at least) from every place that has so many."""
    n = data.size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = mix(eights(data))
    places = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    total = np.zeros(n, np.uint64)
    for place, factor in zip(places, salts(np.arange(len(places))) | np.uint64(1)):
        total += eight[place : n + place] * factor
    return mix(total)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def cell(texts: Texts, column: str) -> pa.Array:
    """A column of the rows of this run."""
    array = texts.batch.column(texts.batch.schema.get_field_index(column))
    return array.slice(texts.first, len(texts.starts))
