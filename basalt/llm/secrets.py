"""Secret scans: certain kinds by pattern, weak parts of a credential only where complementary parts lie near."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
#: Weak candidates: each alone may be anything.
LONG = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]{0,20}://[^\x00-\x20\"'<>]{4,}|(?<![A-Za-z0-9.-])(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}(?!\d)")
LOGIN = re.compile(rb"""(?i:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""")
#: Kinds in the order that ties of a start are listed in.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "weak_endpoint")
SPAN = T.StructType([
    T.StructField("start", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("end", T.LongType()),
])
FIELDS = T.StructType([
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_linked", T.LongType()),
    T.StructField("secret_spans", T.ArrayType(SPAN)),
])


def hex_runs(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of 24 or more lower-case hex digits, none across two documents."""
    on = np.concatenate(([False], HEX[data], [False])).astype(np.int8)
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    far = ends - starts >= 24
    out = []
    for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True):
        cuts = offsets[(offsets > s) & (offsets < e)].tolist()
        out += [(a, b) for a, b in zip([s, *cuts], [*cuts, e], strict=True) if b - a >= 24]
    return out


def strong(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, kind, start byte, end byte) of the certain kinds in one chunk."""
    raw, found = data.tobytes(), []
    doc = lambda at: int(np.searchsorted(offsets, at, "right")) - 1
    for i in np.unique(np.searchsorted(offsets, np.flatnonzero((data == 58) | (data == 61)), "right") - 1).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        found += [(i, 0, a + m.start(), a + m.end()) for m in ASSIGN.finditer(raw[a:b]) if m.end(2) - m.start(2) >= 6]
    at = raw.find(b"AKIA")
    seen = -1
    while at >= 0:
        i = doc(at)
        if i != seen:
            seen, a, b = i, int(offsets[i]), int(offsets[i + 1])
            found += [(i, 1, a + m.start(), a + m.end()) for m in ACCESS.finditer(raw[a:b]) if m.end() - m.start() >= 20]
        at = raw.find(b"AKIA", int(offsets[i + 1]))
    return found + [(doc(s), 2, s, e) for s, e in hex_runs(data, offsets)]


def entropy(value: bytes) -> float:
    counts = np.array(list(Counter(value).values())) / len(value)
    return float(-(counts * np.log2(counts)).sum())


def near(these: np.ndarray, those: np.ndarray, scope: int) -> np.ndarray:
    """Interval join as a semi-join: which of the (start, end) rows lie within ``scope`` of any of the others.

    ``those`` is sorted by start and may overlap or nest: of the intervals that
    begin no later, the one that ends last decides, else the next to begin. No
    pairs are made.
    """
    if not len(these) or not len(those):
        return np.zeros(len(these), bool)
    after = np.searchsorted(those[:, 0], these[:, 0], "right")
    right = those[np.minimum(after, len(those) - 1), 0] - these[:, 1]
    left = these[:, 0] - np.maximum.accumulate(those[:, 1])[np.maximum(after - 1, 0)]
    return ((after < len(those)) & (right <= scope)) | ((after > 0) & (left <= scope))


def linked(text: bytes, base: list[tuple[int, int, int]], scope: int, min_entropy: float) -> list[tuple[int, int, int]]:
    """Weak (kind, start, end) parts that have their complements within ``scope`` bytes, off the base spans."""
    taken = sorted((s, e) for _, s, e in base)
    table = np.array(taken, np.int64).reshape(-1, 2)

    def free(s: int, e: int) -> bool:
        return not len(table) or not bool(((table[:, 0] < e) & (table[:, 1] > s)).any())

    ends = np.array([(m.start(), m.end()) for m in ENDPOINT.finditer(text)], np.int64).reshape(-1, 2)
    logins = np.array([m.span(1) for m in LOGIN.finditer(text) if free(*m.span(1))], np.int64).reshape(-1, 2)
    touches = lambda rows, m: bool(((rows[:, 0] < m.end()) & (rows[:, 1] > m.start())).any())
    before = lambda m: text[max(m.start() - 1, 0) : m.start()]
    # Of an endpoint, only the values of its query; the value of a login is no secret beside itself.
    secrets = np.array(
        [(m.start(), m.end()) for m in LONG.finditer(text)
         if free(*m.span()) and re.search(rb"\d", m[0]) and re.search(rb"[A-Za-z]", m[0]) and entropy(m[0]) >= min_entropy
         and (before(m) == b"=" or not touches(ends, m)) and (before(m) not in (b"=", b".") or not touches(logins, m))], np.int64,
    ).reshape(-1, 2)
    access = np.array(sorted((s, e) for k, s, e in base if k == 1), np.int64).reshape(-1, 2)
    known = np.array(sorted((s, e) for k, s, e in base if k != 1), np.int64).reshape(-1, 2)
    ids = np.array(sorted(map(tuple, np.concatenate((access, logins)).tolist())), np.int64).reshape(-1, 2)
    # A secret needs an identifier; an identifier needs a secret; an endpoint needs both, as does a pair's report.
    a = secrets[near(secrets, ids, scope)]
    strong_or_linked = np.array(sorted(map(tuple, np.concatenate((a, known)).tolist())), np.int64).reshape(-1, 2)
    b = logins[near(logins, strong_or_linked, scope)]
    c = ends[near(ends, strong_or_linked, scope) & near(ends, ids, scope)]
    c = np.array([x for x in c.tolist() if free(*x)], np.int64).reshape(-1, 2)
    return [(k, s, e) for k, rows in ((3, a), (4, b), (5, c)) for s, e in rows.tolist()]


def scan_chunk(data: np.ndarray, offsets: np.ndarray, scope: int, min_entropy: float) -> list[list[tuple[int, int, int]]]:
    """For each document the (start, kind, end) spans in code points, ordered."""
    by_doc: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for i, kind, s, e in strong(data, offsets):
        by_doc[i].append((kind, s - int(offsets[i]), e - int(offsets[i])))
    # Weak parts link only to an identifier: an access id, or one that follows a ":" or "=".
    marks = np.unique(np.searchsorted(offsets, np.flatnonzero((data == 58) | (data == 61)), "right") - 1).tolist()
    for i in sorted({*marks, *(i for i, x in enumerate(by_doc) if any(k == 1 for k, _, _ in x))}):
        raw = data[offsets[i] : offsets[i + 1]]
        by_doc[i] += linked(raw.tobytes(), by_doc[i], scope, min_entropy)
    for i, spans in enumerate(by_doc):
        if spans:
            raw = data[offsets[i] : offsets[i + 1]]
            at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            by_doc[i] = sorted((int(at[s]), k, int(at[e])) for k, s, e in spans)
    return by_doc


def secret_scan(docs: DataFrame, text: str = "text", scope: int = 200, min_entropy: float = 3.5) -> DataFrame:
    """Every row of docs with counts of its secrets and their spans.

    secret_spans holds {start, kind, end} in code points, by start, then kind as
    in KINDS. Certain kinds: assign (a keyword, ``:`` or ``=``, and 6 or more
    characters), access (``AKIA`` and 16 or more capitals or digits) and hex (24
    or more lower-case digits); those of one kind never overlap. Weak parts
    (mixed strings of 20 or more characters with ``min_entropy`` bits a
    character, logins, endpoints) count only within ``scope`` bytes of their
    complement: a secret near an identifier, a login near a secret, an endpoint
    near both. A document is the widest scope. Texts of any length are scanned
    whole; an empty table gives no rows.

    Null and empty texts have no spans (an empty list). Columns of docs named
    like a new one are replaced; all else passes unchanged, row by row, so ties
    and repeated rows need no rule. Nothing is shuffled.
    """

    def measure(column):
        rows = [r for _, _, data, offsets in tx.chunks(column) for r in scan_chunk(data, offsets, scope, min_entropy)]
        counts = [[sum(k == kind for _, k, _ in r) for r in rows] for kind in range(3)]
        weak = [sum(k > 2 for _, k, _ in r) for r in rows]
        return [*counts, weak, [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in r] for r in rows]], None

    return tx.map_columns(docs, text, FIELDS, measure)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", scope: int = 200, min_entropy: float = 3.5) -> DataFrame:
    """docs with each maximal run of overlapping secret spans of its text replaced by ``mask``.

    No row is dropped and no column added; a null text stays null, an empty one
    empty. Each row is judged alone, as by ``secret_scan``.
    """
    import pyarrow as pa

    def clean(column):
        texts, k = column.to_pylist(), 0
        for _, _, data, offsets in tx.chunks(column):
            for spans in scan_chunk(data, offsets, scope, min_entropy):
                if spans:
                    out, at, x = [], 0, texts[k]
                    for s, _, e in spans:
                        if s >= at:
                            out += [x[at:s], mask]
                        at = max(at, e)
                    texts[k] = "".join(out) + x[at:]
                k += 1
        return [pa.array(texts, pa.string())], None

    fields = T.StructType([T.StructField(text, T.StringType())])
    columns = docs.columns
    return tx.map_columns(docs.withColumn("_secret_text", F.col(text)), "_secret_text", fields, clean, drop=("_secret_text",)).select(*columns)
