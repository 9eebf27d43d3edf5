"""Terms of word lists inside a task: words coded by number, pairs of words by two numbers.

No term is built as a string before it is known to be kept: the words of a part of the rows
are looked up once each, and pairs go by the numbers of their words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that a task takes apart together, give or take one row.
SEGMENT_WORDS = 1 << 21
#: Words that are looked up together.
LOOKUP_WORDS = 1 << 20


def lengths(rows) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(rows, most: int) -> Iterator[tuple[int, object]]:
    """``rows`` in parts of at most ``most`` words, each with its first place; a longer row stands alone."""
    upto = np.cumsum(lengths(rows))
    first = 0
    while first < len(rows):
        before = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
        yield first, rows.slice(first, last - first)
        first = last


def single_words(terms: list[str]) -> dict[str, int]:
    return {term: k for k, term in enumerate(terms) if " " not in term}


def word_pairs(terms: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The words of all pairs, numbered; the pairs as numbers of both words, sorted; their terms."""
    numbers: dict[str, int] = {}
    sides = [(term.partition(" "), k) for k, term in enumerate(terms) if " " in term]
    for (left, _, right), _ in sides:
        numbers.setdefault(left, len(numbers))
        numbers.setdefault(right, len(numbers))
    pairs = np.array([numbers[left] * len(numbers) + numbers[right] for (left, _, right), _ in sides], np.int64)
    order = np.argsort(pairs)
    return numbers, pairs[order], np.array([k for _, k in sides], np.int64)[order]


def known_terms(rows, words: dict[str, int], pairs) -> tuple[np.ndarray, np.ndarray]:
    """The known terms of ``rows``, and the row of each. Every different word is looked up once."""
    row = np.repeat(np.arange(len(rows)), lengths(rows))
    coded = rows.flatten().dictionary_encode()
    different, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    one = np.array([words.get(w, -1) for w in different], np.int64).take(place)
    known = one >= 0
    if pairs is None or not len(pairs[1]):
        return one[known], row[known]
    numbers, keys, terms = pairs
    number = np.array([numbers.get(w, -1) for w in different], np.int64).take(place)
    left = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (row[:-1] == row[1:]))
    key = number.take(left) * len(numbers) + number.take(left + 1)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys.take(at) == key
    return (
        np.concatenate([one[known], terms.take(at[hit])]),
        np.concatenate([row[known], row.take(left[hit])]),
    )


def _segments(batches) -> Iterator[object]:
    """Word lists gathered from ``batches``, or cut from them, by ``SEGMENT_WORDS``."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        for _, some in parts(batch.column(0), SEGMENT_WORDS):
            own = int(lengths(some).sum())
            if held and n + own > SEGMENT_WORDS:
                yield pa.concat_arrays(held)
                held, n = [], 0
            held.append(some)
            n += own
    if held:
        yield pa.concat_arrays(held)


def _counted(code: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes, in how many rows each is, and how often."""
    different = None
    if len(code) and int(code.max()) >= (1 << 62) // max(n_rows, 1):
        different, code = np.unique(code, return_inverse=True)
    key = np.sort(code * n_rows + row)
    if not len(key):
        return key, key, key
    fresh = np.append(True, key[1:] != key[:-1])
    term = key // n_rows
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    code = term[first]
    return (
        code if different is None else different[code],
        np.add.reduceat(fresh.astype(np.int64), first),
        np.diff(np.append(first, len(key))),
    )


def frequent_in_segments(batches, least: int, bigrams: bool):
    """``(term, df, ctf)`` of each term that a segment of the rows has ``least`` times or more,
    as counted in the segment, and a row without a term for each segment."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for rows in _segments(batches):
        row = np.repeat(np.arange(len(rows)), lengths(rows))
        coded = rows.flatten().dictionary_encode()
        number, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        code, df, ctf = _counted(number, row, len(rows))
        keep = ctf >= least
        code = code[keep]
        found = [(words.take(pa.array(code)), df[keep], ctf[keep])]
        if bigrams and len(code):
            # A pair is not in the text more often than either of its words.
            own = np.full(len(words), -1, np.int64)
            own[code] = np.arange(len(code))
            number = own[number]
            left = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (row[:-1] == row[1:]))
            pair, df, ctf = _counted(number[left] * len(code) + number[left + 1], row[left], len(rows))
            keep = ctf >= least
            a, b = (words.take(pa.array(code[x])) for x in np.divmod(pair[keep], len(code)))
            found.append((pc.binary_join_element_wise(a, b, " "), df[keep], ctf[keep]))
        for terms, df, ctf in [*found, (pa.array([None], pa.string()), np.ones(1), np.ones(1))]:
            yield pa.RecordBatch.from_arrays(
                [terms.cast(pa.string()), pa.array(df, pa.int64()), pa.array(ctf, pa.int64())], ["term", "df", "ctf"]
            )


def counts_of(batches, terms: int, state):
    """``(ix, df, ctf)`` of the known terms in all rows of a task."""
    import pyarrow as pa

    words, pairs = state
    df, ctf = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for batch in batches:
        for _, rows in parts(batch.column(0), LOOKUP_WORDS):
            ids, row = known_terms(rows, words, pairs)
            entry, _ = entries_of(ids, row, terms)
            ctf += np.bincount(ids, minlength=terms)
            df += np.bincount(entry % terms, minlength=terms)
    used = np.flatnonzero(ctf)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(df[used], pa.int64()), pa.array(ctf[used], pa.int64())], ["ix", "df", "ctf"]
    )


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on in seven bits a byte, and how many bytes each takes."""
    values = values.astype(np.uint64)
    size = 1 + sum((values >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 9))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        more = (size[some] > k + 1).astype(np.uint64) << np.uint64(7)
        out[start[some] + k] = (values[some] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out, size


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``data``, and where each ends."""
    end = np.flatnonzero(data < 128) + 1
    start = np.append(0, end[:-1])
    size = end - start
    out = np.zeros(len(end), np.int64)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[some] |= (data[start[some] + k] & 127).astype(np.int64) << 7 * k
    return out, end


def binaries(data: np.ndarray, size: np.ndarray):
    """A binary array whose values are the runs of ``size`` bytes of ``data``."""
    import pyarrow as pa

    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array one after the other, and how many each value has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return data, np.diff(ends).astype(np.int64)


def packed_entries(length: np.ndarray, ix: np.ndarray, tf: np.ndarray):
    """``(gaps, more)`` of rows of ``length`` entries: the distance of each term from the one
    before, doubled, and one more if the row has it more than once; and for each of those how
    often beyond two."""
    row = np.repeat(np.arange(len(length)), length)
    often = tf > 1
    out = []
    for values, of in ((2 * gaps_of(length, ix) + often, row), (tf[often] - 2, row[often])):
        data, size = packed(values)
        out.append(binaries(data, np.bincount(of, weights=size, minlength=len(length)).astype(np.int64)))
    return out


def gaps_of(length: np.ndarray, ix: np.ndarray) -> np.ndarray:
    """The distance of each term from the one before in its row, of the first from 0."""
    gap = np.diff(ix, prepend=0)
    first = (np.cumsum(length) - length)[length > 0]
    gap[first] = ix[first]
    return gap


def from_gaps(length: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The terms of rows from their distances."""
    total = np.append(0, np.cumsum(gap))
    return total[1:] - np.repeat(total[np.cumsum(length) - length], length)


def packed_counts(ids: np.ndarray, row: np.ndarray, n: int, terms: int):
    """The same for the term of each word or pair of ``n`` rows, in any order."""
    entry, count = entries_of(ids, row, terms)
    row, term = np.divmod(entry, terms)
    return packed_entries(np.bincount(row, minlength=n), term, count)


def run_lengths(size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many numbers each run of ``size`` bytes has, by where numbers end."""
    upto = np.searchsorted(end, np.cumsum(size), "right")
    return np.diff(np.append(0, upto))


def unpacked_counts(gaps, more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many entries each row has, their terms in order and how often each is there."""
    data, size = bytes_of(gaps)
    value, end = unpacked(data)
    length = run_lengths(size, end)
    tf = np.ones(len(value), np.int64)
    tf[(value & 1) == 1] = unpacked(bytes_of(more)[0])[0] + 2
    return length, from_gaps(length, value >> 1), tf


def weighed(length: np.ndarray, ix: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of entries, each row of norm one. Terms numbered by group are ``len(idf)`` apart."""
    row = np.repeat(np.arange(len(length)), length)
    weight = (1.0 + np.log(tf)) * idf[ix % max(len(idf), 1)]
    return weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(length)))[row]


def entries_of(ids: np.ndarray, row: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """``row * terms + id`` of the entries of each row, in order, and how often each is there."""
    key = np.sort(row * terms + ids)
    if not len(key):
        return key, key
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.diff(np.append(first, len(key)))
