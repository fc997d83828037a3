"""Near-duplicate documents: SetSketch registers in bands, joint estimates by likelihood, then full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .cut import cut
from .graph import components

SHINGLE = 5
#: Registers: BANDS groups of ROWS. Two sets of similarity 0.85 miss all bands with probability 2e-7.
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Ratio of the exponential spacing, and rate of the exponential hash values.
SPACING, RATE = 1.02, 20.0
FACTORS, SHIFTS = tx.seeds(REGISTERS, 5) | np.uint64(1), tx.seeds(REGISTERS, 6)
#: Estimates this far below the threshold (over four standard errors of REGISTERS registers) are not verified.
MARGIN = 0.13
#: Members of a bucket that one task compares with as many others.
CELL = 512
#: Classes of exact copies with one in so many rows, or more, are few enough to broadcast, ...
HOT_PART = 1024
#: ... and have so many members at least.
HOT_LEAST = 1000
#: Bits of a shingle's hash; the others number the documents of a chunk.
HASH_BITS = 64 - tx.CHUNK_ROWS.bit_length()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and n + 1 offsets. Fewer words than a shingle make one."""
    words, n = tx.Words(data, offsets, lower=True), len(offsets) - 1
    at, h = words.windows(shingle)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(shingle - 1):  # the k-th word of all those that have one
            has = words.counts[short] > k
            own[has] = tx.mix(own[has] + words.hashes[words.first[short[has]] + k])
        doc, h = np.concatenate((doc, short)), np.concatenate((h, own))
    keep = np.uint64(HASH_BITS)
    keys = np.sort((doc.astype(np.uint64) << keep) | (h >> (np.uint64(64) - keep)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << keep)
    return keys & ((np.uint64(1) << keep) - np.uint64(1)), bounds


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set: truncated minima of exponential hash values on a scale spaced by powers of SPACING.

    Registers of a union are the element-wise maxima.
    """
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    if len(full):
        mixed = tx.mix(values)
        for i in range(REGISTERS):
            least = np.minimum.reduceat(mixed * FACTORS[i] + SHIFTS[i], bounds[full])
            e = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(SPACING)), 0, 65535)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from their registers and sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], 1)[:, 0]


def linked_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row for each row of docs.

    Texts are lower-cased in A-Z; a set holds the distinct 5-word shingles, or
    the whole of fewer words. Sets with ``100 * intersection >= percent *
    union`` are linked; component_id is the smallest key that links reach, and
    the document with it is kept.

    Equal sets become one (their smallest key). Sets that share a band of
    registers meet in a bucket, where each is paired with the bucket's two
    hubs: the member that shares most buckets, and the smallest key. Pairs
    whose estimate comes near the threshold are verified on the full sets.
    In buckets of three or more whose members are not all linked yet, all pairs
    of different components are estimated from registers alone, in cells of
    CELL by CELL; only members that have a near partner there come again with
    their texts, and are verified, so that no link in a bucket depends on the hubs.

    Null or wordless texts and null keys link with nothing: their component is
    their own key and they are kept. Rows of one key share its fate; if their
    texts differ, that of the smallest 64-bit hash stands for the key. Ties of a
    similarity need no rule: only the threshold counts. Texts of any length are
    taken whole. Other columns of docs are not read. An empty input gives no rows.
    """
    id_type = docs.schema[key].dataType
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    tx.limit_batches(narrow)
    fields = T.StructType([T.StructField("id", id_type), T.StructField("t", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n", "d1", "d2")), T.StructField("registers", T.BinaryType())])

    def sketch(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tx.chunks(batch.column(1)):
                values, bounds = shingle_sets(data, offsets)
                total = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(np.stack((tx.mix(values), tx.mix(values ^ np.uint64(0x5A5A))), axis=1), axis=0, dtype=np.uint64)))
                digest = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
                rows = registers(values, bounds)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), j - i, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), binary], names=fields.names)

    sketches = cut(narrow.mapInArrow(sketch, fields))
    real = sketches.where("n > 0 AND id IS NOT NULL")
    classes = cut(real.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = real.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").groupBy("id").agg(F.min(F.struct("t", "n", "registers")).alias("s"))
    signs = cut(reps.select("id", "s.n", "s.registers"))

    def bands(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(unpack(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], names=["bucket", "id"])

    entries = signs.select("id", "registers").mapInArrow(bands, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", id_type)]))
    # Buckets of one member are most of them: only others go on.
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("lowest")).where("members > 1")
    members = cut(entries.join(shared, "bucket"))
    popular = members.groupBy("id").agg(F.sum("members").alias("popular"))
    members = cut(members.join(popular, "id"))
    hubs = members.groupBy("bucket").agg(F.max(F.struct("popular", "id"))["id"].alias("hub"))
    with_hub = members.join(hubs, "bucket")
    pairs = ordered(with_hub.select("id", F.explode(F.array("lowest", "hub")).alias("other")))
    # Whole texts of those that share a bucket, compressed; every later step reads these.
    whole = narrow.where("id IS NOT NULL").join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("t", "text"))["text"].alias("text"))
    texts = cut(compressed(whole, id_type))
    first = cut(verified(near_pairs(pairs, signs, percent), texts, percent))
    labels = components(first)

    state = members.join(labels, "id", "left").select("bucket", "id", "members", F.coalesce("component", "id").alias("component"))
    open_buckets = state.where("members > 2").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    active = cut(state.join(open_buckets, "bucket").join(signs, "id"))
    # Registers first; texts go only with those that have a near partner in another component.
    wanted = cut(cell_members(active, id_type, percent).distinct())
    members_left = wanted.groupBy("bucket").agg(F.count("*").alias("members"))
    rest = cut(cell_links(active.drop("members").join(wanted, ["bucket", "id"]).join(members_left, "bucket").join(texts, "id"), id_type, percent))
    if not rest.isEmpty():
        labels = components(first.union(rest))
    found = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("d1", "d2", "n", "copies", F.coalesce("component", "rep").alias("component"))
    out = with_classes(sketches.drop("registers", "t"), cut(found))
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the component of their class; the classes that hold much of all rows, HOT_PART at most, come by broadcast."""
    sets = ["d1", "d2", "n"]
    total = classes.agg(F.sum("copies")).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_PART + 1)
    hot = classes.where(F.col("copies") >= least).select(*sets, F.col("component").alias("hot"))
    cold = classes.where(F.col("copies") < least).drop("copies")
    if hot.isEmpty():
        return rows.join(cold, sets, "left")
    rows = rows.join(F.broadcast(hot), sets, "left")
    there = rows.where("hot IS NOT NULL").withColumnRenamed("hot", "component")
    return there.unionByName(rows.where("hot IS NULL").drop("hot").join(cold, sets, "left"))


def unpack(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, REGISTERS), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each band of registers, different between bands."""
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(ROWS):
        keys = tx.mix(keys ^ rows[:, k::ROWS].astype(np.uint64) + np.uint64(1))
    return keys ^ tx.seeds(BANDS, 7)[None, :]


def unpack_sets(packed: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    import zstandard

    big = zstandard.ZstdDecompressor()
    texts = pa.array([big.decompress(p) for p in packed], pa.binary()).cast(pa.large_string())
    out: list[np.ndarray] = []
    for _, _, data, offsets in tx.chunks(texts):
        values, bounds = shingle_sets(data, offsets)
        out += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_pairs(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimated similarity is not clearly below the threshold."""
    side = lambda c: signs.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    # Sizes alone rule out many: the smaller set holds the intersection.
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3)]
            good = estimate(unpack(batch.column(4)), unpack(batch.column(5)), *n) >= percent / 100 - MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(keep, pairs.schema)


def compressed(texts: DataFrame, id_type: T.DataType) -> DataFrame:
    def squeeze(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            small = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([small.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "packed"])

    return texts.mapInArrow(squeeze, T.StructType([T.StructField("id", id_type), T.StructField("packed", T.BinaryType())]))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that the full shingle sets of both texts confirm."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("t_b")), "b")
    joined = joined.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("t_a")), "a").select("a", "b", "t_a", "t_b")

    def confirm(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (unpack_sets(batch.column(c).to_pylist()) for c in (2, 3))
            good = [linked_sets(x, y, percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(confirm, pairs.schema)


def dealt_to_cells(state: DataFrame, *columns: str) -> DataFrame:
    """Members of a bucket by cell (bucket, _low, _high): large buckets are dealt to cells of CELL by CELL members."""
    spread = F.when(F.col("members") > CELL, F.ceil(F.col("members") / CELL)).otherwise(1)
    part = F.pmod(F.xxhash64("id", F.lit(11)), spread)
    # A member meets part j in the cell (min, max) of its own part and j.
    dealt = state.withColumn("_parts", spread).withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)))
    return dealt.select("bucket", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"), "_part", "id", "component", "n", "registers", *columns)


def near_in_cell(table: pa.Table, comp: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a cell sorted by id: rows, their partners in other components whose estimate comes near, and the estimates.

    Pairs that share an earlier band are left to that band's bucket.
    """
    rows, n, part = unpack(table["registers"].combine_chunks()), table["n"].to_numpy().astype(float), table["_part"].to_numpy()
    low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
    keys = band_keys(rows)
    band = int((keys == np.uint64(table["bucket"][0].as_py() % (1 << 64))).all(axis=0).argmax())
    right = np.flatnonzero(part == high)
    for i in np.flatnonzero(part == low).tolist():
        those = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        those = those[those > i] if low == high else those
        # Equal registers bound the estimate closely enough to skip most.
        those = those[(rows[those] == rows[i]).sum(axis=1) >= REGISTERS * (percent / 100 - MARGIN - 0.05)]
        those = those[~(keys[those, :band] == keys[i, :band]).any(axis=1)]
        if len(those):
            fit = estimate(np.broadcast_to(rows[i], (len(those), REGISTERS)), rows[those], np.full(len(those), n[i]), n[those])
            good = fit >= percent / 100 - MARGIN
            if good.any():
                yield i, those[good], fit[good]


def sorted_cell(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.take(pa.compute.sort_indices(table["id"]))
    return table, np.unique(table["component"].to_numpy(), return_inverse=True)[1]


def cell_members(state: DataFrame, id_type: T.DataType, percent: int) -> DataFrame:
    """(bucket, id) of the members with a near partner in another component of their bucket: a row a member and cell, no pairs."""

    def meet(table: pa.Table) -> pa.Table:
        table, comp = sorted_cell(table)
        used = np.zeros(len(comp), bool)
        for i, those, _ in near_in_cell(table, comp, percent):
            used[i] = used[those] = True
        return table.select(["bucket", "id"]).filter(pa.array(used))

    out = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", id_type)])
    return dealt_to_cells(state).groupBy("bucket", "_low", "_high").applyInArrow(meet, out)


def cell_links(state: DataFrame, id_type: T.DataType, percent: int) -> DataFrame:
    """Links (a, b) that join different components within a bucket.

    A cell verifies its near pairs on the full sets, the nearest first, leaving
    out those that links found before already join.
    """

    def meet(table: pa.Table) -> pa.Table:
        table, comp = sorted_cell(table)
        found = list(near_in_cell(table, comp, percent))
        empty = np.zeros(0, np.int64)
        a = np.concatenate([np.full(len(x), i) for i, x, _ in found]) if found else empty
        b = np.concatenate([x for _, x, _ in found]) if found else empty
        near = np.concatenate([x for _, _, x in found]) if found else empty
        used = np.unique(np.concatenate((a, b)))
        sets = dict(zip(used.tolist(), unpack_sets(table["packed"].take(pa.array(used)).to_pylist()), strict=True))
        parent = list(range(int(comp.max()) + 1))

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links: list[tuple[int, int]] = []
        for k in np.argsort(-near, kind="stable").tolist():
            x, y = root(int(comp[a[k]])), root(int(comp[b[k]]))
            if x != y and linked_sets(sets[int(a[k])], sets[int(b[k])], percent):
                parent[x] = y
                links.append((int(a[k]), int(b[k])))
        x, y = (table["id"].take(pa.array([p[e] for p in links], pa.int64())) for e in (0, 1))
        return pa.table({"id": x, "other": y})

    out = T.StructType([T.StructField("id", id_type), T.StructField("other", id_type)])
    return ordered(dealt_to_cells(state, "packed").groupBy("bucket", "_low", "_high").applyInArrow(meet, out))
