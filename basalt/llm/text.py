"""Words, lines and their hashes for whole Arrow string columns, without a Python loop over rows.

A column is handled in chunks of about ``CHUNK_BYTES`` of UTF-8 at whole
documents, so memory is bounded by the chunk or by one document.
Words are maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 8191
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(salt) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


ODD = U64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a cell.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class Cells:
    """The up to eight bytes that begin anywhere in some data, as integers."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
        padded[: len(data)] = data
        self.words = padded.view("<u8")

    def at(self, places: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        cell, shift = places >> 3, (places & 7).astype(U64) << U64(3)
        # Two shifts for the second part: one by 64 is not defined.
        both = (self.words[cell] >> shift) | (self.words[cell + 1] << U64(1) << (U64(63) - shift))
        return both & FIRST_BYTES[sizes]

    def mixed(self, places: np.ndarray, sizes: np.ndarray | int, number: np.ndarray | int) -> np.ndarray:
        """What the ``number``-th cell of a range adds to the range's hash."""
        return mix(self.at(places, sizes) ^ mix(np.atleast_1d(number).astype(U64) + U64(1)))


def finished(total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(total ^ (np.atleast_1d(sizes).astype(U64) * ODD))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes give equal hashes wherever they lie.

    Cells of eight bytes are scrambled with their number and summed. No sum of
    powers of one base is involved, so texts of regular structure do not cancel out.
    """
    cells, sizes = Cells(data), ends - starts
    total = cells.mixed(starts, np.minimum(sizes, 8), 0)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] + 7 >> 3) - 1
        owner = np.repeat(long, more)
        heads = np.cumsum(more) - more
        number = np.arange(len(owner)) - np.repeat(heads, more) + 1
        at = starts[owner] + 8 * number
        total[long] += np.add.reduceat(cells.mixed(at, np.minimum(ends[owner] - at, 8), number), heads)
    return finished(total, sizes)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(left * ODD + right)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n, _ = len(column), column.type
    _, where, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about ``size`` bytes, one row at least."""
    data, offsets = utf8(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1), i + CHUNK_ROWS, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of some documents, in order.

    starts, ends: byte ranges; first: n + 1 offsets of documents in words; doc: each word's document.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = SPACE):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets = data, offsets
        self.solid = solid = ~between[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = solid[edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        stops[edges] = solid[edges]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = range_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that begin an n-word window of one document, and the windows' hashes."""
        count = len(self.starts) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        if not hasattr(self, "_levels"):
            self._levels = [self.hashes]  # of 1, 2, 4, .. words
        total, done = None, 0
        for k in range(n.bit_length()):
            if k == len(self._levels):
                last, half = self._levels[-1], 1 << (k - 1)
                self._levels.append(joined(last[:-half], last[half:]))
            if n >> k & 1:
                part = self._levels[k][done : done + count]
                total = part if total is None else joined(total, part)
                done += 1 << k
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return at, total[at]


def sums(mask: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Sums of a mask or of numbers over index ranges."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[highs] - total[lows]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is there again anywhere, and whether an earlier one is equal."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:]] = same
        again[order[1:]] |= same
        again[order[:-1]] |= same
    return again, later


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbours that are equal."""
    heads = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *heads.tolist(), len(values)] if len(values) else []
    return list(zip(edges[:-1], edges[1:], strict=True))


def covered(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of n that begins at one of ``at``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1) if len(at) < 64 else np.add(edge[:size], np.bincount(at, minlength=size), out=edge[:size])
    if len(at):
        edge[: size + 1] -= np.bincount(np.minimum(at + n, size), minlength=size + 1).astype(np.int32)
    return np.cumsum(edge[:size]) > 0


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return at + np.arange(total)


Batches = Iterable[pa.RecordBatch]


def map_columns(
    df: DataFrame, text: str, fields: T.StructType, measure: Callable[[pa.RecordBatch], tuple[list, np.ndarray | None]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with the columns that ``measure`` returns for each batch, rows kept where its mask says so.

    Columns of df that have the name of a new one are replaced.
    """
    new = set(fields.names) | set(drop)
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(kept + list(fields))
    keep_names, text_at = [f.name for f in kept], df.columns.index(text)
    limit_batches(df)
    arrow = to_arrow_schema(schema)
    at = [df.columns.index(n) for n in keep_names]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, mask = measure(batch.column(text_at))
            out = [batch.column(i) for i in at] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(at) :], strict=True)]
            done = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(out, arrow, strict=True)], names=list(arrow.names))
            yield done if mask is None else done.filter(pa.array(mask))

    return df.mapInArrow(run, schema)


def limit_batches(df: DataFrame) -> None:
    """Keep the Arrow batches that reach Python small where nothing else is set: rows can be long."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
