"""Byte-level BPE by speculation: greedy longest matches, a vectorised test of adjacent pairs, exact merging of what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import text as tx

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
NEVER = np.int64(1) << 40
#: Distinct words that a worker keeps encoded; beyond it, it starts anew.
CACHE_WORDS = 1 << 19
#: Words of more bytes are encoded one by one, with a heap: rounds over all words suit short ones.
LONG_WORD = 64


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        out[np.fromiter(map(ord, regex.findall(pattern, points)), np.int64)] = kind
    out[32] = SPACE
    return out


class HashTable:
    """Integers by integer keys, looked up a whole array at a time; open addressing at a low load."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            slot = self._slot(keys[todo], self.probes)
            # The first of those that want a free slot takes it.
            free = self.keys[slot] == -1
            slots, which = np.unique(slot[free], return_index=True)
            taken = todo[np.flatnonzero(free)[which]]
            self.keys[slots], self.values[slots] = keys[taken], values[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, NEVER where a key is not there."""
        out, todo = np.full(len(keys), NEVER), None
        for probe in range(self.probes):
            part = keys if todo is None else keys[todo]
            slot = self._slot(part, probe)
            there = self.keys[slot]
            hit, open_ = there == part, (there != part) & (there != -1)
            if todo is None:
                out[hit] = self.values[slot[hit]]
                todo = np.flatnonzero(open_)
            else:
                out[todo[hit]] = self.values[slot[hit]]
                todo = todo[open_]
            if not len(todo):
                break
        return out


class Vocabulary:
    """The tables of one tokenizer file; small, of fixed size, sent to the workers by broadcast."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, alphabet = d["model"], byte_alphabet()
        if d.get("normalizer") or model.get("byte_fallback") or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE is supported")
        self.special = {a["content"].encode(): a["id"] for a in d["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in d["added_tokens"]):
            raise ValueError("added tokens that take neighbours with them are not supported")
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for word, i in vocab.items():
            self.token[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word
        self.byte_id = np.zeros(256, np.int64)
        for i in vocab.values():
            if len(self.token[i]) == 1:
                self.byte_id[self.token[i][0]] = i
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank, i
            if self.born[i] < 0:
                self.born[i], self.left[i], self.right[i] = rank, vocab[a], vocab[b]
        self.pairs = HashTable(np.array([(a << 32) | b for a, b in self.merge], np.int64), np.array([r for r, _ in self.merge.values()], np.int64))
        self.made = np.array([i for _, i in self.merge.values()], np.int64)  # by rank
        # A token may be proposed only if exact merging of its own bytes gives it.
        self.whole = {t: i for i, t in enumerate(self.token) if t and (len(t) == 1 or self.exact(t) == [i])}
        self.longest = max(map(len, self.whole))
        ids = np.array(list(self.whole.values()), np.int64)
        sizes = np.array([len(t) for t in self.whole], np.int64)
        joined = np.frombuffer(b"".join(self.whole), np.uint8)
        begins = np.cumsum(sizes) - sizes
        self.tokens = HashTable(tx.range_hashes(joined, begins, begins + sizes).view(np.int64), ids)
        self.classes = character_classes()
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    # --- words -----------------------------------------------------------------

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, with a heap over a linked list: n log n for any length."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if m := self.merge.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        whole, out, at, n = self.whole, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (i := whole.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find((a << 32) | b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a then b leaves the boundary between them.

        The parts that meet at the boundary are walked back in time, undoing the
        later of their merges; a pair of them that would merge before either is
        taken up inside its own token breaks the boundary.
        """
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        x_taken, y_taken = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            rank = self.pair_rank(x, y)
            bad = (rank < x_taken) & (rank <= y_taken) & (rank < NEVER)
            ok[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            undo = bx > by
            x_taken, y_taken = np.where(undo, bx, x_taken), np.where(undo, y_taken, by)
            more = ~bad & ((bx >= 0) | (by >= 0))
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
            live, x, y, x_taken, y_taken = live[more], x[more], y[more], x_taken[more], y_taken[more]
        return ok

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: ids and their words, in order.

        A round takes the next token of each word that is not done: lengths are
        tried from the longest down, by the hash of the bytes.
        """
        cells = tx.Cells(data)
        at, word = starts.copy(), np.arange(len(starts))
        ids, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            room = np.minimum(ends[word] - at, self.longest)
            # before[k]: the sum over the first k cells of each word's rest, as far as it has them.
            before = [np.zeros(len(word), np.uint64)]
            for k in range((int(room.max()) - 1) // 8):
                before.append(before[-1] + cells.mixed(np.minimum(at + 8 * k, len(data)), 8, k))
            token, todo = np.full(len(word), -1, np.int64), np.arange(len(word))
            for size in range(int(room.max()), 0, -1):
                fit = todo[room[todo] >= size]
                if len(fit):
                    k = (size - 1) // 8
                    total = before[k][fit] + cells.mixed(at[fit] + 8 * k, size - 8 * k, k)
                    found = self.tokens.find(tx.finished(total, size).view(np.int64))
                    hit = found < NEVER
                    token[fit[hit]] = found[hit]
                    todo = todo[token[todo] < 0]
            ids.append(token)
            owners.append(word)
            at = at + self.lengths[token]
            more = at < ends[word]
            at, word = at[more], word[more]
        flat, owner = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        return self.bytes[tx.gather(self.places[ids], self.lengths[ids])]

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words at once: each round merges every word's pair of lowest rank, where it stands, leftmost first."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = ends - starts
        ids = self.byte_id[data[tx.gather(starts, sizes)]]
        owner = np.repeat(np.arange(len(starts)), sizes)
        out_ids, out_owner = [], []
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_rank(ids[inner], ids[inner + 1])
        while len(ids):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(heads, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, heads), count)
            done = least == NEVER
            out_ids.append(ids[done])
            out_owner.append(owner[done])
            ids, owner, rank, least = ids[~done], owner[~done], rank[~done], least[~done]
            here = np.flatnonzero(rank == least)
            if not len(here):
                break
            # Of a run of overlapping pairs (a a a), every other one.
            run = np.append(True, (here[1:] != here[:-1] + 1) | (owner[here[1:]] != owner[here[:-1]]))
            first = np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - first) % 2 == 0]
            ids[here] = self.made[rank[here]]
            keep = np.ones(len(ids), bool)
            keep[here + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, rank, here = ids[keep], owner[keep], rank[keep], place[here]
            for p in (here, here[here > 0] - 1):
                inside = (p + 1 < len(ids)) & (owner[np.minimum(p + 1, len(ids) - 1)] == owner[p])
                rank[p[~inside]] = NEVER
                rank[p[inside]] = self.pair_rank(ids[p[inside]], ids[p[inside] + 1])
        flat, owner = np.concatenate(out_ids), np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and each word's count. Very long words go one by one."""
        short = np.flatnonzero(ends - starts <= LONG_WORD)
        flat, owner = self.propose(data, starts[short], ends[short])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails = np.zeros(len(short), bool)
        # A token found by its hash must spell the word; its length is the word's share by construction.
        sizes = (ends - starts)[short]
        wrong = self.spelled(flat) != data[tx.gather(starts[short], sizes)]
        if wrong.any():
            fails[np.repeat(np.arange(len(short)), sizes)[wrong]] = True
        fails[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        again = np.flatnonzero(fails)
        good = ~fails[owner]
        parts, owners = [flat[good]], [short[owner[good]]]
        if len(again):
            flat, owner = self.merge_all(data, starts[short[again]], ends[short[again]])
            parts.append(flat)
            owners.append(short[again[owner]])
        for w in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            word = data[starts[w] : ends[w]].tobytes()
            ids = np.array(self.greedy(word), np.int64)
            if not self.compatible(ids[:-1], ids[1:]).all():
                ids = np.array(self.exact(word), np.int64)
            parts.append(ids)
            owners.append(np.full(len(ids), w))
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(starts))

    # --- texts -----------------------------------------------------------------

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where the words of the usual pre-tokenizer pattern begin, and which are special tokens (id or -1).

        The pattern: contractions, then letters, numbers or others with one
        space before, then white space but for the character before a word.
        """
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = data[lead].astype(np.int32)
        for high, low, n, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
            at = np.flatnonzero((point >= high) & (point < low))
            if len(at):
                value = data[lead[at]].astype(np.int32) & mask
                for k in range(1, n + 1):
                    value = (value << 6) | (data[lead[at] + k] & 0x3F)
                point[at] = -value  # negative, so that later rounds leave it
        point = np.abs(point)
        kind = self.classes[point]
        n = len(lead)
        cut = np.zeros(n + 1, bool)  # a document or segment begins here, or the end
        cut[np.searchsorted(lead, offsets[:-1])] = True
        cut[n] = True
        special_at: list[tuple[int, int, int]] = []
        if self.special:
            raw = data.tobytes()
            for content, i in self.special.items():
                p = raw.find(content)
                while p >= 0:
                    doc_end = offsets[np.searchsorted(offsets, p, "right")]
                    if p + len(content) <= doc_end:
                        s, e = np.searchsorted(lead, [p, p + len(content)])
                        special_at.append((int(s), int(e), i))
                        cut[s] = cut[e] = True
                    p = raw.find(content, p + len(content))
        run = np.minimum(kind, BLANK)
        begins = cut[:n].copy()
        begins[1:] |= run[1:] != run[:-1]
        ends = np.append(begins[1:], True) if n else begins  # the run's last character
        # The last of some white space before a word stands alone, or joins the word if it is a space.
        last = np.flatnonzero(ends & (run == BLANK) & ~cut[1:])
        token = begins.copy()
        token[last] = True
        token[last[kind[last] == SPACE] + 1] = False
        quote = np.flatnonzero((point == 39) & token & ends & ~cut[1:])
        quote = quote[~cut[quote + 1]]
        if len(quote):
            padded = np.concatenate((point, np.zeros(3, point.dtype)))
            c1, c2 = padded[quote + 1], np.where(cut[np.minimum(quote + 2, n)], 0, padded[quote + 2])
            short = np.isin(c1, [ord(c) for c in "stmd"])
            long = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            token[quote[short | long] + 1] = False
            for at in (quote[short] + 2, quote[long] + 3):
                token[at[at < n]] = True
        ids = np.full(n, -1, np.int64)
        for s, e, i in special_at:
            token[s:e] = False
            token[s], ids[s] = True, i
        at = np.flatnonzero(token)
        return lead[at], ids[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the n + 1 offsets of documents in them."""
        starts, special = self.split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        keys = tx.range_hashes(data, starts, ends)
        keys[special >= 0] ^= np.uint64(0x5EC1A1)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.reset()
        there = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[there] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            at = first[new]
            plain = special[at] < 0
            flat, counts = self.encode_words(data, starts[at[plain]], ends[at[plain]])
            size = np.ones(len(new), np.int64)
            size[plain] = counts
            place = self.filled + np.cumsum(size) - size
            total = int(size.sum())
            while self.filled + total > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[tx.gather(place[plain], counts)] = flat
            self.pool[place[~plain]] = special[at[~plain]]
            self.filled += total
            where = np.searchsorted(self.keys, unique[new])
            self.keys = np.insert(self.keys, where, unique[new])
            self.at, self.size = np.insert(self.at, where, place), np.insert(self.size, where, size)
        slot = np.searchsorted(self.keys, unique)[inverse]
        sizes = self.size[slot]
        ids = self.pool[tx.gather(self.at[slot], sizes)]
        if not np.array_equal(self.spelled(ids), data):
            # Words of equal hashes but other bytes: none is taken from the cache.
            plain = special < 0
            flat, counts = self.encode_words(data, starts[plain], ends[plain])
            sizes = np.ones(len(starts), np.int64)
            sizes[plain] = counts
            ids, place = np.zeros(int(sizes.sum()), self.pool.dtype), np.cumsum(sizes) - sizes
            ids[place[~plain]] = special[~plain]
            ids[tx.gather(place[plain], counts)] = flat
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the offsets of ids in them."""
        return self.spelled(ids), np.concatenate(([0], np.cumsum(self.lengths[ids])))


_LOADED: dict[str, Broadcast] = {}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's tables on all workers; the file is read on the driver alone."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    key = f"{spark.sparkContext.applicationId}:{hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in _LOADED:
        _LOADED[key] = spark.sparkContext.broadcast(Vocabulary(spec))
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
TEXT = T.StructType([T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode_text(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of docs with its ``ids``. Null and empty texts have none (an empty list).

    A column of docs named ``ids`` is replaced; all else passes unchanged, row by row.
    Texts of any length are encoded whole, one text in memory at least; an empty table gives no rows.
    """
    vocab = vocabulary(docs.sparkSession, path)

    def measure(column):
        lists, sizes = [], []
        for _, _, data, offsets in tx.chunks(column):
            ids, bounds = vocab.value.encode(data, offsets)
            lists.append(ids.astype(np.int32))
            sizes.append(np.diff(bounds))
        at = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1)
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))], None

    return tx.map_columns(docs, text, IDS, measure)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Every row with the text ``decoded`` of its ids; bytes that are not UTF-8 become U+FFFD. A null list gives null."""
    vocab = vocabulary(rows.sparkSession, path)

    def measure(column):
        out = []
        for row in column.to_pylist():
            out.append(None if row is None else vocab.value.decode(np.array(row, np.int64))[0].tobytes().decode("utf-8", "replace"))
        return [out], None

    return tx.map_columns(rows, ids, TEXT, measure)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of docs with its number of ids, and the hashes of its ids and of the text decoded from them.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    Null texts count as empty. Texts of any length are encoded whole, one text
    in memory at least; an empty table gives no rows. Columns of docs named like
    a new one are replaced; all else passes unchanged, row by row, so ties and
    repeated rows need no rule. Nothing is shuffled.
    """
    vocab = vocabulary(docs.sparkSession, path)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def rows(column) -> Iterator[tuple[int, str, str]]:
        for _, _, data, offsets in tx.chunks(column):
            ids, bounds = vocab.value.encode(data, offsets)
            decoded, places = vocab.value.decode(ids)
            raw = ids.astype("<u4")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = decoded[places[a] : places[b]].tobytes()
                yield b - a, sha(raw[a:b].tobytes()), sha(part.decode("utf-8", "replace").encode())

    def measure(column):
        found = list(rows(column))
        return [list(x) for x in zip(*found, strict=True)] or [[], [], []], None

    return tx.map_columns(docs, text, DIGEST, measure)
