"""Removing word passages that an earlier document holds: suffix automata of just the reference passages that each block of documents needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import text as tx
from .cut import partitions, text_bytes

WINDOW = 13
#: Bytes of text that make a block of documents.
BLOCK_BYTES = 512 << 10
#: Bytes of text whose fingerprints a task sorts and sends at a time.
CELL_BYTES = 6 << 20
#: A window that so many blocks of a cell hold is hot: one of them alone stands for the cell.
HOT = 16
#: A block sends a passage to so many others at most; they pass it on.
FAN = 64


class SuffixAutomaton:
    """All subsequences of some passages of words, with the smallest owner of each state.

    Built online, one transition table a state; passages share the states of
    what they have in common.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 63]

    def add(self, passage: list[int], owner: int) -> None:
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for word in passage:
            p = last
            if (q := nxt[p].get(word)) is not None:
                if length[q] != length[p] + 1:
                    q = self._clone(p, q, word)
                last = q
            else:
                last = len(nxt)
                nxt.append({})
                length.append(length[p] + 1)
                own.append(1 << 63)
                link.append(0)
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = last
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[last] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            own[last] = min(own[last], owner)

    def _clone(self, p: int, q: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.owner.append(1 << 63)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def finish(self, window: int) -> None:
        """Pass owners up the links, and find each state's ancestor that stands for the last ``window`` words."""
        order = np.argsort(self.length, kind="stable").tolist()
        for v in reversed(order[1:]):
            p = self.link[v]
            if self.owner[v] < self.owner[p]:
                self.owner[p] = self.owner[v]
        self.anchor = list(range(len(self.link)))
        for v in order[1:]:
            if self.length[self.link[v]] >= window:
                self.anchor[v] = self.anchor[self.link[v]]

    def ends(self, words: list[int], window: int, before: int) -> list[int]:
        """Matching statistics: positions where a window ends whose words some passage of an owner below ``before`` holds."""
        nxt, link, length = self.next, self.link, self.length
        out, v, n = [], 0, 0
        for i, word in enumerate(words):
            while v and word not in nxt[v]:
                v = link[v]
                n = length[v]
            if (q := nxt[v].get(word)) is not None:
                v, n = q, n + 1
                if n >= window and self.owner[self.anchor[v]] < before:
                    out.append(i)
        return out


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in as many bits each as the largest needs: by planes of bytes, the high ones last, then the bits beyond."""
    bits = max(1, int(values.max()).bit_length()) if len(values) else 1
    whole, rest = divmod(bits, 8)
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    top = np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1, bitorder="little")[:, :rest]) if rest else np.zeros(0, np.uint8)
    return struct.pack("<BI", bits, len(values)) + raw[:, :whole].T.tobytes() + top.tobytes()


def unpack_ints(data: bytes, at: int) -> tuple[np.ndarray, int]:
    bits, n = struct.unpack_from("<BI", data, at)
    whole, rest = divmod(bits, 8)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = np.frombuffer(data, np.uint8, whole * n, at).reshape(whole, n).T
    at += whole * n
    if rest:
        size = -(-rest * n // 8)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=rest * n).reshape(n, rest)
        out[:, whole] = np.packbits(flat, axis=1, bitorder="little")[:, 0] if n else 0
        at += size
    return out.view("<u8").reshape(-1), at


def unpack_all(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        values, at = unpack_ints(data, at)
        out.append(values)
    return out


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the 64-bit fingerprints."""
    return (prints >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def least_of(bucket: int, buckets: int) -> np.uint64:
    """A bound below all fingerprints of a bucket; buckets from ``buckets`` on are of cells' hot windows, of any fingerprint."""
    return np.uint64((bucket << 32) // buckets << 32 if bucket < buckets else 0)


def senders(group: np.ndarray, keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows ask for their window's words, and the row each asks; rows lie by group (equal windows), then by key.

    Equal keys have a rank. A row asks one of rank (own rank - 1) // FAN: of a
    smaller key, so that whom it asks does hold the window before it. The first
    asks itself if its block has more documents of the window.
    """
    new = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    step = new | np.append(True, keys[1:] != keys[:-1])[: len(group)]
    first_rank = np.flatnonzero(step)
    rank = np.cumsum(step) - 1
    base = np.maximum.accumulate(np.where(new, rank, 0))
    own = rank - base
    wants = np.flatnonzero((own > 0) | more)
    return wants, np.where(own[wants] > 0, first_rank[base[wants] + np.maximum(own[wants] - 1, 0) // FAN], wants)


def first_of_each(prints: np.ndarray, block: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, by print, that hold the smallest key of each (print, block), and whether the block has more keys of it."""
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    same = p[1:] == p[:-1]
    if not same.any():
        return order, np.zeros(len(order), bool)
    tied = np.zeros(len(p), bool)
    tied[1:] |= same
    tied[:-1] |= same
    rows = order[tied]
    order[tied] = rows[np.lexsort((key[rows], block[rows], prints[rows]))]
    p, b, k = prints[order], block[order], key[order]
    new = np.append(True, (p[1:] != p[:-1]) | (b[1:] != b[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order)) - 1
    return order[heads], k[tails] != k[heads]


def keys_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as integers (0 for null), and which are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False))
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64), there


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, layout: bool = False, cell_bytes: int = CELL_BYTES, bucket_bytes: int = 2 << 20,
) -> DataFrame:
    """Every row of docs, its text without the words of earlier documents' passages, with n_words and n_removed.

    A word goes if a window of ``window`` consecutive words covers it whose
    sequence also begins in a document of a smaller key. Windows are those of
    the input. The text becomes the kept words joined by one space; with
    ``layout``, the removed words and the white space after them are cut out
    and all else stays as it is.

    Documents are dealt to blocks by key and text. 64-bit fingerprints of the
    windows, each block's once, meet in buckets, where the documents of a
    fingerprint are ranked by key. Each block asks one of a smaller key for the
    passage (a run of such windows, as text); as a tree, so that no block
    answers more than FAN others for a window. There a suffix automaton of the
    passages reads the documents: it alone decides, on whole words, so that
    equal fingerprints of different words remove nothing; they can only hide a
    passage, with n windows about n * n / 2**64 of them. A cell of
    ``cell_bytes`` of text sends each bucket one row; a window that HOT of its
    blocks hold goes to its bucket once, and is ranked in a bucket of the cell's
    own. Buckets hold the fingerprints of about ``bucket_bytes`` of text. Both
    small suit small executors; with tens of terabytes, raise them together
    (128 MB and 16 MB, say), so that rows stay well filled: a row's share is the
    cell's fingerprints over the buckets.

    Keys are integers. Null keys own nothing and lose nothing: their rows are
    not shuffled. Rows of one key take nothing from each other; a repeated row
    loses what each of its copies does. Null texts count as empty and stay null.
    A text of any length is taken whole, in memory. Columns of docs named n_words
    or n_removed are replaced, _block is taken; others pass unchanged. An empty
    input gives no rows.
    """
    size = text_bytes(docs, text)
    parts = partitions(docs, size)
    blocks = max(parts, min(-(-size // BLOCK_BYTES), 1 << 30))
    buckets = max(parts, min(-(-size // bucket_bytes), 1 << 29))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "_block")]
    tx.limit_batches(docs)
    # One exchange, read three times.
    block = F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("_block")
    dealt = docs.where(F.col(key).isNotNull()).select(*names, block).repartition(parts, "_block")
    key_at, text_at, block_at = names.index(key), names.index(text), len(names)

    def send(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        prints, doc, keys, places, held, cell = [], [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def packed(p, d, more, base, key_of, block_of) -> bytes:
            docs_there, own = np.unique(d, return_inverse=True)
            zigzag = (key_of[docs_there] << 1) ^ (key_of[docs_there] >> 63)
            return b"".join(map(pack_ints, (np.diff(p - base, prepend=np.uint64(0)), own, more, zigzag.view(np.uint64), block_of[docs_there])))

        def flush() -> Iterator[pa.RecordBatch]:
            key_of, block_of = np.concatenate(keys), np.concatenate(places)
            p, d = np.concatenate(prints), np.concatenate(doc)
            rows, more = first_of_each(p, block_of[d], key_of[d])
            p, d = p[rows], d[rows]
            out: list[tuple[int, bytes]] = []
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, int)
            hot = np.repeat(np.diff(np.append(heads, len(p))) >= HOT, np.diff(np.append(heads, len(p))))
            if hot.any():
                number = buckets + int(tx.mix(np.array([part << 20 | cell]))[0] % np.uint64(buckets))
                out.append((number, packed(p[hot], d[hot], more[hot], least_of(number, buckets), key_of, block_of)))
                at = np.flatnonzero(hot)
                at = at[np.lexsort((key_of[d[at]], p[at]))]
                least = np.zeros(len(p), bool)
                least[at[np.append(True, p[at[1:]] != p[at[:-1]])]] = True
                # Its own further documents are served in the cell's bucket.
                more = more & ~hot
                p, d, more = p[~hot | least], d[~hot | least], more[~hot | least]
            number = bucket_of(p, buckets)
            for a, b in tx.runs(number):
                out.append((int(number[a]), packed(p[a:b], d[a:b], more[a:b], least_of(int(number[a]), buckets), key_of, block_of)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            key_all, there = keys_of(batch.column(key_at))
            block_all = batch.column(block_at).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tx.chunks(batch.column(text_at)):
                words = tx.Words(data, offsets)
                at, p = words.windows(window)
                good = there[i:j][words.doc[at]]
                base = sum(map(len, keys))
                prints.append(p[good])
                doc.append(words.doc[at][good] + base)
                keys.append(key_all[i:j])
                places.append(block_all[i:j].astype(np.int64))
                held += len(data)
                if held >= cell_bytes:
                    yield from flush()
                    prints, doc, keys, places, held, cell = [], [], [], [], 0, cell + 1
        if prints:
            yield from flush()

    def match(table: pa.Table) -> pa.Table:
        """Of one bucket: for each fingerprint in two documents or more, who asks whom."""
        parts_ = [unpack_all(x) for x in table["packed"].to_pylist()]
        low = np.concatenate([np.cumsum(x[0]) for x in parts_])
        keys = np.concatenate([((x[3] >> np.uint64(1)) ^ (np.uint64(0) - (x[3] & np.uint64(1)))).view(np.int64)[x[1].astype(np.int64)] for x in parts_])
        block = np.concatenate([x[4][x[1].astype(np.int64)] for x in parts_]).astype(np.int64)
        more = np.concatenate([x[2] for x in parts_]) > 0
        order = np.argsort(low, kind="stable")
        lone = np.append(True, low[order][1:] != low[order][:-1])
        single = lone & np.append(lone[1:], True)
        rows = order[~single | more[order]]
        rows = rows[np.lexsort((keys[rows], low[rows]))]
        low, keys, block, more = low[rows], keys[rows], block[rows], more[rows]
        wants, owner = senders(low, keys, more)
        order = np.argsort(block[owner], kind="stable")
        wants, owner = wants[order], owner[order]
        there = block[owner]
        zigzag = ((keys << 1) ^ (keys >> 63)).view(np.uint64)
        out = [(int(there[a]), b"".join(map(pack_ints, (np.diff(low[wants[a:b]], prepend=np.uint64(0)), block[wants[a:b]].astype(np.uint64), zigzag[owner[a:b]])))) for a, b in tx.runs(there)]
        bucket = table["bucket"][0].as_py()
        return pa.table({"_block": pa.array([x for x, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "packed": pa.array([x for _, x in out], pa.binary())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of a block that is asked: the passages, a row for each run of windows and asking block."""
        empty = pa.table({"_block": pa.array([], pa.int32()), "owner": pa.array([], pa.int64()), "passage": pa.array([], pa.string())})
        if not right.num_rows or not left.num_rows:
            return empty
        asked = [(b, unpack_all(x)) for b, x in zip(right["bucket"].to_pylist(), right["packed"].to_pylist(), strict=True)]
        prints = np.concatenate([np.cumsum(x[0]) + least_of(b, buckets) for b, x in asked])
        wants = np.concatenate([x[1] for _, x in asked]).astype(np.int64)
        owners = np.concatenate([((x[2] >> np.uint64(1)) ^ (np.uint64(0) - (x[2] & np.uint64(1)))).view(np.int64) for _, x in asked])
        order = np.argsort(prints, kind="stable")
        prints, wants, owners = prints[order], wants[order], owners[order]
        keys, there = keys_of(left.column(key_at))
        out = []
        for i, j, data, offsets in tx.chunks(left.column(text_at)):
            words = tx.Words(data, offsets)
            at, p = words.windows(window)
            low, high = np.searchsorted(prints, p), np.searchsorted(prints, p, "right")
            size = np.where(there[i:j][words.doc[at]], high - low, 0)
            ask = tx.gather(low, size)
            place = np.repeat(at, size)
            good = owners[ask] == keys[i:j][words.doc[place]]
            ask, place = ask[good], place[good]
            order = np.lexsort((place, wants[ask]))
            ask, place = wants[ask[order]], place[order]
            if len(place):
                new = np.append(True, (ask[1:] != ask[:-1]) | (place[1:] > place[:-1] + 1) | (words.doc[place[1:]] != words.doc[place[:-1]]))
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(place)) - 1
                raw = data.tobytes()
                for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                    out.append((int(ask[a]), int(keys[i + words.doc[place[a]]]), raw[words.starts[place[a]] : words.ends[place[b] + window - 1]].decode()))
        return pa.table({"_block": pa.array([x for x, _, _ in out], pa.int32()), "owner": pa.array([x for _, x, _ in out], pa.int64()), "passage": pa.array([x for _, _, x in out], pa.string())}) if out else empty

    fields = T.StructType([f for f in docs.schema.fields if f.name in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(fields)

    def trim(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of a block: its documents, read by the automaton of the passages sent to it."""
        automaton, known, hashes = None, {}, np.zeros(0, np.uint64)
        if right.num_rows and left.num_rows:
            automaton = SuffixAutomaton()
            for owner, passage in sorted(set(zip(right["owner"].to_pylist(), right["passage"].to_pylist(), strict=True))):
                automaton.add([known.setdefault(w, len(known)) for w in passage.encode().split()], owner)
            automaton.finish(window)
            vocabulary = b" ".join(known)
            hashes = np.sort(tx.Words(np.frombuffer(vocabulary, np.uint8), np.array([0, len(vocabulary)])).hashes)
        return without(left, automaton, known, hashes)

    def without(left: pa.Table | pa.RecordBatch, automaton: SuffixAutomaton | None, known: dict[bytes, int], hashes: np.ndarray) -> pa.Table:
        keys, _ = keys_of(left.column(key_at))
        texts, totals, removed = [], [], []
        for i, j, data, offsets in tx.chunks(left.column(text_at)):
            words = tx.Words(data, offsets)
            gone = np.zeros(len(words.starts), bool)
            if automaton is not None:
                member = hashes[np.minimum(np.searchsorted(hashes, words.hashes), len(hashes) - 1)] == words.hashes
                # Runs of known words of one document, as long as a window at least.
                stop = ~member
                cuts = np.flatnonzero(np.append(True, (words.doc[1:] != words.doc[:-1]) | (stop[1:] != stop[:-1]))) if len(stop) else np.zeros(0, int)
                ends = np.append(cuts[1:], len(stop))
                raw = data.tobytes()
                for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                    if b - a >= window and member[a]:
                        run = [known.get(w, -1) for w in raw[words.starts[a] : words.ends[b - 1]].split()]
                        found = np.array(automaton.ends(run, window, int(keys[i + words.doc[a]])), np.int64)
                        if len(found):
                            gone[a:b] |= tx.covered(b - a, found - (window - 1), window)
            counts = tx.sums(gone, words.first[:-1], words.first[1:])
            totals.append(words.counts)
            removed.append(counts)
            texts += kept_texts(words, gone, counts, layout)
        column = pa.array(texts, pa.string())
        source = left.column(text_at)
        if source.null_count:
            column = pa.compute.if_else(source.is_null(), pa.scalar(None, pa.string()), column)
        numbers = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (totals, removed)]
        out = [left.column(k) for k in range(len(names))]
        out[text_at] = column
        return pa.Table.from_arrays([*out, *numbers], names=list(arrow.names)).cast(arrow)

    def unkeyed(batches: tx.Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from without(batch, None, {}, np.zeros(0, np.uint64)).to_batches()

    sent = dealt.mapInArrow(send, "bucket int, packed binary")
    # A window takes some seven bytes there, about what a word does in its text.
    sent = sent.repartition(partitions(docs, 2 * size), "bucket")
    requests = sent.groupBy("bucket").applyInArrow(match, "_block int, bucket int, packed binary")
    by_block = dealt.groupBy("_block")
    passages = by_block.cogroup(requests.groupBy("_block")).applyInArrow(answer, "_block int, owner long, passage string")
    trimmed = by_block.cogroup(passages.groupBy("_block")).applyInArrow(trim, fields)
    return trimmed.union(docs.where(F.col(key).isNull()).select(*names).mapInArrow(unkeyed, fields))


def kept_texts(words: tx.Words, gone: np.ndarray, counts: np.ndarray, layout: bool) -> list[str]:
    """Each document's text without the words that are gone."""
    raw, out = words.data.tobytes(), []
    bounds = words.offsets.tolist()
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        text = raw[bounds[d] : bounds[d + 1]]
        if layout:
            if counts[d]:
                # Cut from each removed word to the next word, or to the end.
                begins = words.starts[a:b][gone[a:b]].tolist()
                nexts = np.append(words.starts[a + 1 : b], bounds[d + 1])[gone[a:b]].tolist()
                parts, at = [], bounds[d]
                for s, e in zip(begins, nexts, strict=True):
                    parts.append(raw[at:s])
                    at = e
                text = b"".join(parts) + raw[at : bounds[d + 1]]
            out.append(text.decode())
        elif counts[d]:
            out.append(b" ".join([w for w, g in zip(text.split(), gone[a:b].tolist(), strict=True) if not g]).decode())
        else:
            out.append(b" ".join(text.split()).decode())
    return out
