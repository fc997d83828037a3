"""DuckDB SQL for the queries that SQL can express, each over whole tables and texts."""

from __future__ import annotations

from .quality import LINE_LIMIT, NGRAM_LIMITS

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def grams(n: int) -> str:
    """The window of n words that begins at a row of ``word``: NULL where the document ends before."""
    return "x" + "".join(f" || ' ' || lead(x, {k}) OVER o" for k in range(1, n))


_SIZES = [n for n, _ in NGRAM_LIMITS]
_LIMITS = " OR ".join(f"dup_{n}gram_chars > {limit} * greatest(word_chars, 1)" for n, limit in NGRAM_LIMITS)
QUALITY = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
    windows AS (SELECT doc_id, i, x, {", ".join(f"{grams(n)} AS g{n}" for n in _SIZES)} FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    repeated AS (SELECT doc_id, i, x, {", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS r{n}" for n in _SIZES)} FROM windows),
    covered AS (SELECT doc_id, length(x) AS c, {", ".join(f"max(CASE WHEN r{n} THEN i ELSE -100 END) OVER o > i - {n} AS c{n}" for n in _SIZES)} FROM repeated WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (
        SELECT doc_id, count(*) FILTER (WHERE c5) AS n_repeat_words, {", ".join(f"coalesce(sum(c) FILTER (WHERE c{n}), 0) AS dup_{n}gram_chars" for n in _SIZES)}
        FROM covered GROUP BY doc_id),
    lines AS (SELECT doc_id, l, count(*) - 1 AS more FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
    dup AS (SELECT doc_id, sum(more) AS n_dup_lines, sum(more * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM lines GROUP BY doc_id),
    m AS (
        SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
               {", ".join(f"CAST(coalesce(dup_{n}gram_chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n, _ in NGRAM_LIMITS)}
        FROM d LEFT JOIN grams USING (doc_id) LEFT JOIN dup USING (doc_id)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR dup_line_chars > {LINE_LIMIT} * greatest(word_chars, 1) OR {_LIMITS}) AS kept FROM f
"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, y FROM reach JOIN both_ways ON x = other),
    components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents JOIN components ON id = doc_id LEFT JOIN sizes USING (doc_id)
"""

SUBSTRINGS = rf"""
    WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
    windows AS (SELECT doc_id, i, x, {grams(13)} AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    judged AS (SELECT doc_id, i, x, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS late FROM windows),
    covered AS (SELECT doc_id, i, x, max(CASE WHEN late THEN i ELSE -100 END) OVER (PARTITION BY doc_id ORDER BY i) > i - 13 AS gone FROM judged),
    kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM covered GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SEARCH = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, v.vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE = {
    "op1_quality_rules": QUALITY,
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_top_k": SEARCH,
}
