"""Vectorised text primitives shared by the corpus operators: words, lines and rolling hashes over Arrow buffers.

Everything works on the UTF-8 bytes of one Arrow batch at a time, so memory follows the batch and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.session import discard, with_package, written  # noqa: F401

#: Bytes of text that are worked on together: their arrays stay near a core's cache.
CHUNK_BYTES = 1 << 18

#: Hashes are polynomials modulo this prime, at two bases that have nothing to do with each other. Modulo a power of two, texts of a thousand bytes
#: are known that differ and collide at every base; here a pair of texts collides at one base with a chance of their length in 2**61, at both in 2**122.
PRIME = (1 << 61) - 1
_BASES = (0x1B873593CC9E2D51 % PRIME, 0x0F3A6D4E85EBCA6B % PRIME)
_powers = {x: np.ones(1, np.uint64) for base in _BASES for x in (base, pow(base, -1, PRIME))}

_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)

#: Word separators: the space and the characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tune(spark) -> None:
    """Arrow batches small enough that a batch of long texts stays within a Python worker's memory."""
    with_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_key(row_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(row_id.cast("string"), F.lit("=")), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary")))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> _61)
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers under it, from products of halves."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    cross = ah * bl
    cross += al * bh
    ah = ah * bh
    ah <<= np.uint64(1)  # 2**62 is 2
    ah += cross >> _30  # and 2**61 is 1
    cross &= _LOW30
    cross <<= _31
    ah += cross
    ah += al * bl
    return reduced(ah)


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; one table per base is kept for the life of the worker."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), PRIME)))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial prefix hashes modulo PRIME at one of the two bases, so that any span's hash costs two look-ups."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.base = _BASES[which]
        power = power_table(self.base, n)
        if values.dtype == np.uint8 and n < 1 << 23:
            # The sums of products fit as they are.
            v = values.astype(np.uint64)
            v += np.uint64(1)
            high, low = np.cumsum(v * (power >> _31)), np.cumsum(v * (power & _LOW31))
            low += high >> _30
            high &= _LOW30
            high <<= _31
            low += high
            self.prefix = np.concatenate([np.zeros(1, np.uint64), reduced(low)])
            return
        if values.dtype.itemsize < 8:
            v = values.astype(np.uint64)
            v += np.uint64(1)
            high, low = v * (power >> _31), v * (power & _LOW31)
            low += high >> _30
            high &= _LOW30
            high <<= _31
            low += high
            term = reduced(low)
        else:
            term = times(reduced(values), power)
        high = np.cumsum(term >> _31)
        term &= _LOW31
        low = np.cumsum(term)
        low += high >> _30
        high &= _LOW30
        high <<= _31
        low += high
        self.prefix = np.concatenate([np.zeros(1, np.uint64), reduced(low)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Well-mixed 64-bit hashes of values[start:end]."""
        inverse = power_table(pow(self.base, -1, PRIME), len(self.prefix))
        whole = times(reduced(self.prefix[end] + (_P - self.prefix[start])), inverse[start])
        return mix(whole + np.asarray(end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` bytes of text each; one longer text is a slice of its own."""
    _, offsets = text_buffer(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


class Words:
    """Spans of the words of a buffer, maximal runs of bytes that part nothing (`[^\\x20\\x09-\\x0D]+` unless told otherwise); a word never crosses a row's end."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE):
        inside = ~parts[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[offsets] = True
        last = first[1:].copy()
        if len(buf):
            last[:-1] |= ~inside[1:]
            first[1:-1] |= ~inside[:-1]
        self.start = np.flatnonzero(inside & first[:-1])
        self.end = np.flatnonzero(inside & last) + 1
        self.row = rows_of(offsets, self.start)


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; rows are split at line feeds, and an empty row has one empty line."""
    cuts = np.flatnonzero(buf == 10)
    each = np.bincount(rows_of(offsets, cuts), minlength=len(offsets) - 1) + 1
    after = np.cumsum(each)
    start, end = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
    inner = np.ones(len(start), bool)
    inner[after - each] = False
    start[~inner], start[inner] = offsets[:-1], cuts + 1
    inner[:] = True
    inner[after - 1] = False
    end[~inner], end[inner] = offsets[1:], cuts
    return start, end, np.repeat(np.arange(len(each)), each)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (one entry more than bytes)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def repeated(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over hashes at both bases: the pair occurs at least twice; an equal one comes earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if (check[order][1:] != check[order][:-1])[same].any():
        order = np.lexsort((check, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (check[order][1:] == check[order][:-1])
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(length.sum())
