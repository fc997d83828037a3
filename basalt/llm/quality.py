"""Quality rules: how much of a text repeats itself, by rolling hashes of n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as tx

#: n-gram lengths, with the largest part of the characters that duplicated n-grams may hold. Limits fall with the
#: length: words in repeated longer n-grams lie in repeated shorter ones too, so at one limit only the shortest would decide.
NGRAM_LIMITS = ((5, 0.18), (6, 0.17), (7, 0.16), (8, 0.15), (9, 0.14), (10, 0.13))
#: The largest part of the characters in lines equal to an earlier one.
LINE_LIMIT = 0.15
FIELDS = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")),
    *(T.StructField(f"dup_{n}gram_chars", T.LongType()) for n, _ in NGRAM_LIMITS),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
])
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def measure_chunk(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of FIELDS for the documents of one chunk, without the verdicts."""
    words, n = tx.Words(data, offsets), len(offsets) - 1
    out = {"n_words": words.counts.astype(np.int64)}
    point = words.solid & ((data & 0xC0) != 0x80)
    out["word_chars"] = tx.sums(point, offsets[:-1], offsets[1:])
    out["n_symbols"] = tx.sums(SYMBOL[data], offsets[:-1], offsets[1:])
    salt = tx.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_doc = np.minimum(np.searchsorted(offsets, starts, "right") - 1, n - 1)
    if n and len(breaks) and (late := breaks + 1 >= offsets[np.searchsorted(offsets, breaks, "right")]).any():
        # A break that ends its document begins an empty line there, which holds no word.
        starts = np.sort(np.concatenate((offsets[:-1], breaks[~late] + 1)))
        line_doc = np.minimum(np.searchsorted(offsets, starts, "right") - 1, n - 1)
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[line_doc + 1]) if n else starts
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(data) else ends
    chars = tx.sums(point, starts, np.maximum(ends, starts))
    real = np.flatnonzero(chars > 0)
    _, later = tx.repeats(tx.range_hashes(data, starts[real], ends[real]) ^ salt[line_doc[real]])
    dup = real[later]
    out["n_dup_lines"] = np.bincount(line_doc[dup], minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[dup], weights=chars[dup], minlength=n).astype(np.int64)

    word_chars = tx.sums(point, words.starts, words.ends)
    candidates = None
    for size, _ in NGRAM_LIMITS:
        at, keys = words.windows(size)
        if candidates is not None:  # a longer n-gram repeats only where its shorter head does
            live = candidates[at]
            at, keys = at[live], keys[live]
        again, _ = tx.repeats(keys ^ salt[words.doc[at]])
        candidates = np.zeros(len(words.starts), bool)
        candidates[at[again]] = True
        cover = tx.covered(len(words.starts), at[again], size)
        if size == 5:
            out["n_repeat_words"] = tx.sums(cover, words.first[:-1], words.first[1:])
        out[f"dup_{size}gram_chars"] = tx.sums(np.where(cover, word_chars, 0), words.first[:-1], words.first[1:])
    return out


def verdicts(m: dict[str, np.ndarray], max_symbols: float, max_dup_lines: float) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    bad = (m["n_symbols"] > max_symbols * m["n_words"]) | (m["dup_line_chars"] > max_dup_lines * chars)
    for size, limit in NGRAM_LIMITS:
        bad |= m[f"dup_{size}gram_chars"] > limit * chars
    return failed, ~failed & ~bad


def quality_rules(
    docs: DataFrame, text: str = "text", max_symbols: float = 0.1, max_dup_lines: float = LINE_LIMIT, only_kept: bool = False,
) -> DataFrame:
    """Every row of docs with its repetition counts and the verdict ``kept``.

    n_repeat_words counts words in 5-word windows that the text holds at least
    twice; dup_Ngram_chars the code points of words in N-word windows held at
    least twice; dup_line_chars those of lines equal to an earlier line.
    A text fails the base rules with fewer than 10 words or with over a fifth
    of its words repeated. It is kept if it passes them, has at most
    ``max_symbols`` of ``#*$%&|<>`` a word, at most ``max_dup_lines`` of its
    characters in repeated lines, and stays within NGRAM_LIMITS.

    Null and empty texts count as 0 words and fail. Columns of docs named like
    a new one are replaced; all others, nulls included, pass unchanged, and so
    does the number of rows (with only_kept: the kept ones alone remain, and no
    column is added). Texts of any length are measured whole; an empty table
    gives no rows. Each row is judged alone: ties and repeated rows need no
    rule. Nothing is shuffled.
    """

    def measure(column):
        parts = [measure_chunk(data, offsets) for _, _, data, offsets in tx.chunks(column)]
        m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {f.name: np.zeros(0, np.int64) for f in FIELDS}
        failed, kept = verdicts(m, max_symbols, max_dup_lines)
        if only_kept:
            return [], kept
        return [m[f.name] for f in list(FIELDS)[:-2]] + [failed, kept], None

    return tx.map_columns(docs, text, T.StructType([]) if only_kept else FIELDS, measure)
