"""Packing token sequences as a cutting-stock problem: column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .bpe import vocabulary
from .cut import cut

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first
#: The linear program ends within this part of its lower bound.
GAP = 2e-4
#: It also ends after so many pivots a length, whatever is left to gain: all pieces are placed all the same.
MOST_PIVOTS = 8
#: Fractions from which a pattern's count may be rounded up; each is tried. Above 1: none.
ROUND_UP = (2.0, 0.5)


class Knapsack:
    """By dynamic programming: the multiset of lengths within each room up to ``size`` that has the largest total value."""

    def __init__(self, values: np.ndarray, size: int):
        """``values`` by length, from 0 to ``size``; -inf where a length is not to be used."""
        self.best, self.choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)
        for room in range(1, size + 1):
            total = values[1 : room + 1] + self.best[room - 1 :: -1]
            k = int(total.argmax())
            self.best[room] = self.best[room - 1]
            if total[k] > self.best[room] + 1e-13:
                self.best[room], self.choice[room] = total[k], k + 1

    def column(self, room: int) -> Counter:
        out: Counter = Counter()
        while room > 0:
            if length := int(self.choice[room]):
                out[length] += 1
            room -= max(length, 1)
        return out


class CuttingStock:
    """A revised simplex over patterns that cover a histogram of lengths, begun from patterns of one length each.

    No BLAS or LAPACK: their threads may hang in a process that has started a JVM.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, size: int):
        self.lengths, self.size, n = lengths, size, len(lengths)
        # Tiny differences in demand keep the basis from degenerating, and the pivots from going in circles.
        self.demand = demand * (1 + 1e-9 * np.modf(np.arange(1, n + 1) * 0.618)[0])
        self.place = np.full(size + 1, -1)
        self.place[lengths] = np.arange(n)
        each = size // lengths
        self.columns = [Counter({int(r): int(m)}) for r, m in zip(lengths, each, strict=True)]
        self.plain = np.ones(n, bool)  # the column is still one of a single length
        self.counts, self.inverse, self.duals = self.demand / each, np.diag(1.0 / each), 1.0 / each
        self.least = float((demand * lengths).sum()) / size
        self.pivots = 0

    @property
    def total(self) -> float:
        return float(self.counts.sum())

    @property
    def spent(self) -> bool:
        return self.pivots >= MOST_PIVOTS * len(self.lengths)

    def price(self, values: np.ndarray, usable: np.ndarray) -> Knapsack:
        table = np.full(self.size + 1, -np.inf)
        table[self.lengths[usable]] = values[usable]
        return Knapsack(table, self.size)

    def enter(self, column: Counter) -> bool:
        """Take a pattern into the basis, if the duals say that it improves the total."""
        at, many = self.place[list(column)], np.array(list(column.values()), float)
        worth = float((self.duals[at] * many).sum())
        if worth <= 1 + 1e-9:
            return False
        step = np.einsum("ij,j->i", self.inverse[:, at], many)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(self.counts, 0) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        row = self.inverse[out] / step[out]
        self.duals = self.duals + (1 - worth) * row
        rows, cols = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
        if 3 * len(cols) < len(row):
            self.inverse[np.ix_(rows, cols)] -= step[rows, None] * row[cols]
        else:
            self.inverse[rows] -= step[rows, None] * row
        self.inverse[out] = row
        self.counts -= ratio[out] * step
        self.counts[out] = ratio[out]
        self.columns[out], self.plain[out] = column, False
        self.pivots += 1
        if self.pivots % 256 == 0:
            self.refresh()
        return True

    def refresh(self) -> None:
        """Where rounding errors add up, begin again from the basis itself."""
        covered = np.zeros(len(self.lengths))
        for column, x in zip(self.columns, self.counts.tolist(), strict=True):
            covered[self.place[list(column)]] += x * np.array(list(column.values()), float)
        if np.abs(covered - self.demand).max() > 1e-6 * max(1.0, self.demand.max()):
            matrix = np.zeros((len(self.lengths),) * 2)
            for j, column in enumerate(self.columns):
                matrix[self.place[list(column)], j] = list(column.values())
            self.inverse = inverted(matrix)
            self.counts, self.duals = np.einsum("ij,j->i", self.inverse, self.demand), self.inverse.sum(axis=0)

    def open_up(self) -> None:
        """Long steps first: around the longest length whose own pattern is in the basis, the best fill by such lengths.

        Priced by length; among equal fills by the squares of lengths, which
        spare the short ones that fill any room, and a little by how many
        pieces are left. Every pattern still enters by the duals and a pivot.
        """
        done, part = np.zeros(len(self.lengths), bool), self.lengths / self.size
        while len(alive := np.flatnonzero(self.plain & ~done & (self.counts > 1e-9))) and not self.spent:
            longest = int(self.lengths[alive[-1]])
            usable = np.zeros(len(self.lengths), bool)
            usable[alive] = True
            left = np.maximum(self.counts, 0) * (self.size // self.lengths)
            tie = 0.5 / self.size * part**2 * np.minimum(left / left[alive].max(), 1) ** 0.1  # below one token of fill, all in all
            column = self.price(part + tie, usable).column(self.size - longest)
            column[longest] += 1
            if not self.enter(column):
                done[alive[-1]] = True

    def solve(self, gap: float) -> CuttingStock:
        """Price patterns by the duals until none improves, or no whole sequence can be saved, or the rest is within ``gap`` of a lower bound, or MOST_PIVOTS are made."""
        self.open_up()
        everything = np.ones(len(self.lengths), bool)
        while not self.spent and self.total > self.least * (1 + gap) and np.ceil(self.total - 1e-6) > np.ceil(self.least - 1e-6):
            priced = self.price(self.duals, everything)
            value = float(priced.best[self.size])
            if (self.duals >= 0).all():
                self.least = max(self.least, float((self.demand * self.duals).sum()) / max(value, 1.0))
            if value <= 1 + 1e-9 or not self.enter(priced.column(self.size)):
                break
        return self


def inverted(columns: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination, the largest pivots first."""
    n = len(columns)
    work = np.concatenate((columns, np.eye(n)), axis=1)
    for k in range(n):
        best = k + int(np.abs(work[k:, k]).argmax())
        if best != k:
            work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[k]
    return work[:, n:].copy()


def first_fit(items: list[int], size: int) -> Counter:
    """First-fit decreasing, best room first; patterns with their counts."""
    rooms: dict[int, list[list[int]]] = defaultdict(list)
    open_rooms = np.zeros(size + 1, np.int64)
    for item in items:
        at = np.flatnonzero(open_rooms[item:])
        room = int(at[0]) + item if len(at) else size
        row = rooms[room].pop() if len(at) else []
        open_rooms[room] -= bool(len(at))
        row.append(item)
        rooms[room - item].append(row)
        open_rooms[room - item] += 1
    return Counter(tuple(sorted(Counter(r).items(), reverse=True)) for rows in rooms.values() for r in rows)


def rounded(program: CuttingStock, histogram: dict[int, int], least_part: float) -> Counter:
    """Whole numbers of the program's patterns, then first-fit decreasing for the pieces that they leave.

    Counts are rounded down; of the parts above, those of ``least_part`` or
    more give one pattern more each, the largest first, while its pieces last.
    """
    left, out = dict(histogram), Counter()

    def take(column: Counter, times: int) -> None:
        times = min([times, *(left[r] // a for r, a in column.items())])
        if times > 0:
            out[tuple(sorted(column.items(), reverse=True))] += times
            for r, a in column.items():
                left[r] -= a * times

    whole = np.floor(program.counts + 1e-4).astype(np.int64)
    part = program.counts - whole
    for j in np.flatnonzero(whole > 0).tolist():
        take(program.columns[j], int(whole[j]))
    for j in np.argsort(-part, kind="stable").tolist():
        if part[j] >= least_part:
            take(program.columns[j], 1)
    out.update(first_fit([r for r in sorted(left, reverse=True) for _ in range(left[r])], program.size))
    return out


def integer_patterns(histogram: dict[int, int], size: int, gap: float = GAP) -> list[tuple[Pattern, int]]:
    """Patterns and counts that hold each length exactly as often as the histogram does.

    The linear program's counts are rounded at several thresholds, and the
    rounding of fewest sequences is taken. Lengths lie in 1..size, so the
    program has ``size`` rows at most, whatever the number of documents.
    """
    left = {r: n for r, n in histogram.items() if n and r < size}
    out: Counter = Counter()
    if left:
        lengths = np.array(sorted(left))
        program = CuttingStock(lengths, np.array([left[r] for r in lengths.tolist()], float), size).solve(gap)
        out = min((rounded(program, left, p) for p in ROUND_UP), key=lambda c: c.total())
    if histogram.get(size):
        out[((size, 1),)] += histogram[size]
    return sorted(out.items(), reverse=True)


class Slots:
    """Where the k-th piece of each length goes: the patterns laid out as runs of sequence ids."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, taken, base = [], Counter(), 0
        for pattern, times in patterns:
            offset = 0
            for length, each in pattern:
                rows.append((length, taken[length], each, base, offset))
                taken[length] += each * times
                offset += length * each
            base += times
        self.sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.base, self.offset = table.T
        self.keys = self.length << 48 | self.first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces by length and rank among pieces of that length."""
        row = np.searchsorted(self.keys, length << 48 | rank, "right") - 1
        k = rank - self.first[row]
        return self.base[row] + k // self.each[row], self.offset[row] + k % self.each[row] * length


PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Each text is encoded and ended by ``end_id``; it is cut at every ``size``
    ids. Full pieces fill a sequence each. The rest are packed by patterns from
    the histogram of their lengths, and within a length by their order in the
    input's partitions. Patterns come from a linear program by column
    generation: a knapsack, priced by the duals, proposes each pattern that
    enters the basis. Nothing but that histogram (``size`` numbers) reaches
    the driver, and nothing but the patterns, bounded by ``size`` too, goes
    back. Ranks come from counts by partition and length, so a length that
    many documents share needs no single task.

    A null or empty text is its end id alone. Keys pass as they are: nulls and
    repeated keys give a row for each of their pieces. No other column of docs
    is read. Texts of any length are cut and packed whole. An empty input gives
    no rows.
    """
    vocab = vocabulary(docs.sparkSession, path)
    key_type = docs.schema[key]
    fields = [key_type, *PIECE, T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    narrow = docs.select(key, text)
    tx.limit_batches(narrow)

    def pieces(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for i, _, data, offsets in tx.chunks(batch.column(1)):
                ids, bounds = vocab.value.encode(data, offsets)
                n = np.diff(bounds) + 1
                raw = np.insert(ids, bounds[1:], end_id).astype("<u4")
                first = bounds[:-1] + np.arange(len(n))
                cuts = -(-n // size)
                owner = np.repeat(np.arange(len(n)), cuts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
                length = np.minimum(n[owner] - start, size)
                at = (first[owner] + start).tolist()
                view = memoryview(raw.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at, length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                group = np.searchsorted(ranked, ranked)
                rank = np.zeros(len(length), np.int64)
                rank[order] = np.arange(len(length)) - group + seen[ranked]
                seen += np.bincount(length, minlength=size + 1)
                columns = [batch.column(0).take(pa.array(owner + i)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(n[owner]), pa.array(np.full(len(owner), part)), pa.array(rank)]
                if with_ids:
                    edges = np.append(np.cumsum(length) - length, length.sum()).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(raw.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    cutting = cut(narrow.mapInArrow(pieces, T.StructType(fields)))
    counts = cutting.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in cutting.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(integer_patterns(histogram, size))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    ranked = cutting.join(shift, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    extra = ["ids"] if with_ids else []
    out = T.StructType([key_type, *PIECE, *(f for f in fields if f.name == "ids"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            where, offset = slots.place(length.astype(np.int64), rank.astype(np.int64))
            kept = batch.select([key, *(f.name for f in PIECE), *extra])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(where), pa.array(offset)], names=out.names)

    return ranked.select(key, *(f.name for f in PIECE), *extra, "_rank").mapInArrow(place, out)
