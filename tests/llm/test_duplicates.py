"""Near copies, repeated passages and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import bpe, graph, neardup, packing, quality, secrets, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def check_near(spark, docs):
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1))).collect()
    want = components(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.component_id == r.doc_id)
    return rows


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_of_one_text(spark):
    """A large family whose members are linked to some, not to others."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = [(i, edited(rng, base, rng.randrange(8))) for i in range(150)] + [(500 + i, " ".join(f"z{rng.randrange(50)}" for _ in range(60))) for i in range(20)]
    check_near(spark, docs)


def test_near_cells_of_large_buckets(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, edited(rng, base, 1 + rng.randrange(6))) for i in range(60)]
    monkeypatch.setattr(neardup, "CELL", 16)
    check_near(spark, docs)


def test_near_hot_class(spark, monkeypatch):
    """Classes of many copies come by broadcast, others by a shuffle: the same rows either way."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(4)]
    docs = [(i, " ".join(base[0])) for i in range(40)] + [(100 + i, edited(rng, base[i % 4], i % 3)) for i in range(40)] + [(None, None), (7, None), (8, "")]
    monkeypatch.setattr(neardup, "HOT_LEAST", 5)
    check_near(spark, [d for d in docs if d[0] not in (7, 8) or d[1] is not None and d[1]])
    assert neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).count() == len(docs)


def test_near_repeated_keys_with_other_texts(spark):
    """One text stands for a key of several, the same each time; all rows of the key get one component."""
    rng = random.Random(3)
    a, b = ([f"{c}{i}" for i in range(60)] for c in "xy")
    docs = [(2, " ".join(a)), (2, " ".join(b)), (5, edited(rng, a, 1)), (6, edited(rng, b, 1)), (1, "other words altogether here now")]
    found = [sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rng.sample(docs, 5), "doc_id long, text string")).collect())) for _ in range(2)]
    assert found[0] == found[1] and len({r[2] for r in found[0] if r[0] == 2}) == 1


def test_near_odd_rows(spark):
    docs = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (11, "É a b c d e"), (12, "é a b c d e"), (None, "one two"), (4, "x " * 9000), (3, "x x x x x x"), (2, "a b c d e f"), (1, "a b c d e f")]
    rows = {r.doc_id: r for r in check_near(spark, docs)}
    assert rows[8].component_id == 8 and rows[9].component_id == 8 and rows[5].n_shingles == 0 and rows[2].component_id == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0


def test_near_on_the_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_near(spark, docs)


def test_near_triples(spark):
    """C is linked to B alone; where A, the smallest id, has most buckets, no hub pairs B with C."""
    docs = []
    for k in range(40):  # four of them lose C without a comparison of all pairs
        a = [f"w{k}x{i}" for i in range(204)]
        b = a[:-4] + [f"b{k}x{i}" for i in range(4)]
        c = [f"c{k}x{i}" for i in range(13)] + b[13:-2] + ["c", "d"]
        docs += [(3 * k + i, " ".join(w)) for i, w in enumerate((a, b, c))]
    check_near(spark, docs)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 50, 3000).astype(np.uint64)
    b = np.concatenate((a[:2000], rng.integers(0, 1 << 50, 1000).astype(np.uint64)))
    rows = neardup.registers(np.concatenate((a, b, np.union1d(a, b))), np.cumsum([0, len(a), len(b), len(np.union1d(a, b))]))
    assert (np.maximum(rows[0], rows[1]) == rows[2]).all()
    assert abs(neardup.estimate(rows[:1], rows[1:2], np.array([3000.0]), np.array([3000.0]))[0] - 0.5) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (None, 3), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def trimmed(docs, window=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first: dict = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_passages_by_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(10, 40))] for _ in range(6)]
    docs = [(None, "n " * 30), (-5, "x y " * 20), (900, None), (901, ""), (902, "a " * 4000), (903, "a " * 50)]
    for i in range(80):
        words: list[str] = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            words += p[rng.randrange(5) :] if rng.random() < 0.7 else [f"u{rng.randrange(1000)}" for _ in range(12)]
        docs.append((i, rng.choice(["  ", "\n", " \t"]).join(words)))
    docs += docs[10:14]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "extra": F.lit(1)})
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == trimmed(docs)


@pytest.mark.parametrize("seed", range(2))
def test_hot_passages_by_brute_force(spark, monkeypatch, seed):
    """Passages that most documents hold, in many blocks and cells: windows are ranked by cell, and passed on as a tree."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 200)
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "FAN", 2)
    rng = random.Random(seed)
    hot = [[f"h{k}x{i}" for i in range(30)] for k in range(3)]
    docs = []
    for i in rng.sample(range(1000), 160):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        for p in rng.sample(hot, rng.randrange(3)):
            words += p[rng.randrange(8) :]
        docs.append((i, " ".join(words)))
    docs += docs[:3] + [(docs[5][0], docs[6][1]), (None, " ".join(hot[0])), (None, " ".join(hot[0])), (None, None)]
    for cell in (600, 1 << 20):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), cell_bytes=cell).collect()), key=repr)
        assert got == trimmed(docs)


def test_nobody_answers_many():
    rng = np.random.default_rng(4)
    for _ in range(100):
        group = np.sort(rng.integers(0, 4, 200))
        keys = rng.integers(0, 150, 200)
        order = np.lexsort((keys, group))
        group, keys, more = group[order], keys[order], rng.random(200) < 0.2
        wants, asked = substrings.senders(group, keys, more)
        assert (group[wants] == group[asked]).all()
        least = np.array([keys[group == g].min() for g in group])
        assert set(wants.tolist()) == set(np.flatnonzero((keys > least) | more).tolist())
        assert all(k < keys[w] or (k == least[w] and a == w) for w, a, k in zip(wants.tolist(), asked.tolist(), keys[asked].tolist(), strict=True))
        ranks = {(int(group[a]), int(keys[w])) for w, a in zip(wants, asked, strict=True) if a == 0}
        assert len(ranks) <= substrings.FAN + 1


def test_passages_on_the_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df).collect()), key=repr)
    assert got == trimmed([tuple(r) for r in df.collect()])


def test_passages_of_windows_alike_in_half_their_hash(spark):
    """Two passages whose window hashes agree in the upper 32 bits and modulo 64: each has its own owner."""
    import pyarrow as pa

    from basalt.llm import text as tx

    words = np.random.default_rng(2).integers(0, 1 << 30, 2_000_000).tolist()
    (_, _, data, offsets), = tx.chunks(pa.array([" ".join(map(str, words))], pa.large_string()))
    at, h = tx.Words(data, offsets).windows(13)
    half = (h >> np.uint64(32) << np.uint64(6)) | (h & np.uint64(63))
    order = np.argsort(half)
    same = np.flatnonzero(half[order[1:]] == half[order[:-1]])
    pairs = [(at[order[k]], at[order[k + 1]]) for k in same[:5].tolist()]
    assert pairs
    docs = []
    for n, pair in enumerate(pairs):
        x, y = (" ".join(map(str, words[i : i + 13])) for i in pair)
        docs += [(3 * n, x), (3 * n + 1, y), (3 * n + 2, y)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 13 * (i % 3 == 2) for i in range(len(docs))}


def test_passages_keep_the_layout(spark):
    p = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"a\n\n{p}\nb"), (2, f"c\n  {p}\n\nd  e"), (3, "same \n layout")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.remove_repeats(docs, layout=True).collect()}
    assert got == {1: f"a\n\n{p}\nb", 2: "c\n  d  e", 3: "same \n layout"}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_packed_integers():
    rng = np.random.default_rng(0)
    for bits in (0, 1, 3, 7, 8, 9, 12, 17, 47, 63, 64):
        for n in (0, 1, 7, 100):
            values = [rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64) for _ in range(3)]
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(substrings.unpack_all(b"".join(map(substrings.pack_ints, values))), values, strict=True))


def test_automaton_by_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        passages = [([rng.randrange(3) for _ in range(rng.randrange(4, 20))], rng.randrange(10)) for _ in range(rng.randrange(1, 5))]
        automaton = substrings.SuffixAutomaton()
        for p, owner in passages:
            automaton.add(p, owner)
        automaton.finish(4)
        text, before = [rng.randrange(3) for _ in range(30)], rng.randrange(11)
        want = [i for i in range(3, 30) if any(o < before and text[i - 3 : i + 1] == p[k : k + 4] for p, o in passages for k in range(len(p) - 3))]
        assert automaton.ends(text, 4, before) == want


# --- the pipeline ---------------------------------------------------------------------------------------


def by_brute_force(docs):
    """(doc_id, doc_tokens, digest of ids) that the stages leave, by plain code for each."""
    from tokenizers import Tokenizer

    import pyarrow as pa

    from basalt.llm import text as tx

    kept = []
    for i, t in docs:
        m = {k: v for _, _, d, o in tx.chunks(pa.array([t or ""])) for k, v in quality.measure_chunk(d, o).items()}
        if quality.verdicts(m, 0.1, quality.LINE_LIMIT)[1][0]:
            kept.append((i, t))
    comp = components(kept)
    kept = [(i, t) for i, t in kept if comp[i] == i]
    removed = {i: (n, gone) for i, n, gone, _ in trimmed(kept)}
    first: dict = defaultdict(lambda: 1 << 62)
    for i, t in kept:
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first[tuple(w[k : k + 13])], i)
    out, tokenizer = {}, Tokenizer.from_file(bpe.default_path())
    for i, t in kept:
        n, gone = removed[i]
        if n == gone:
            continue
        spans = [m.span() for m in WORD.finditer(t)]
        w, drop = [t[a:b] for a, b in spans], set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                drop |= set(range(k, k + 13))
        nexts = [s for s, _ in spans[1:]] + [len(t)]
        text, at = "", 0
        for k in sorted(drop):
            text, at = text + t[at : spans[k][0]], nexts[k]
        text += t[at:]
        found = next(secrets.scan_chunk(d, o, 200, 3.5)[0] for _, _, d, o in tx.chunks(pa.array([text])))
        clean, at = "", 0
        for s, _, e in found:
            if s >= at:
                clean += text[at:s] + "[secret]"
            at = max(at, e)
        out[i] = tokenizer.encode(clean + text[at:], add_special_tokens=False).ids + [0]
    return out


def test_pipeline_by_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = by_brute_force(docs)
    rows = corpus_pipeline.run(spark, sf).toPandas()
    assert {i: g.doc_tokens.iloc[0] for i, g in rows.groupby("doc_id")} == {i: len(x) for i, x in want.items()}
    import zlib

    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert rows.length.sum() == sum(map(len, want.values()))


def test_stages_keep_null_ids(spark, sf, tmp_path):
    """A clean document without an id passes every stage, each row of it."""
    clean = [" ".join(f"{c}{i}" for i in range(40)) for c in "tuv"]
    own = spark.createDataFrame([(None, clean[0]), (None, clean[0]), (None, clean[1]), (-3, clean[2]), (-2, clean[2])], "doc_id long, text string")
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs = given.unionByName(own, allowMissingColumns=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert sorted(r.text for r in docs.where("doc_id IS NULL").collect()) == [clean[0], clean[0], clean[1]]
    assert [r.doc_id for r in docs.where("doc_id < 0").collect()] == [-3]
    assert packing.pack(docs, bpe.default_path()).where("doc_id IS NULL AND start = 0").count() == 3


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, further columns; and no rows at all."""
    clean = [" ".join(f"{c}{i}" for i in range(40)) for c in "tuvw"]
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(None, clean[0], None), (None, clean[0], "x"), (1, None, "x"), (2, "", None), (3, clean[1], None), (3, clean[1], None), (4, clean[1], "y"), (5, long, "z"), (6, clean[2] + " " + clean[3], ""), (7, "short", None)]
    shape = "doc_id long, text string, kept string"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {None: 2, 3: 2, 5: 1, 6: 1}
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_the_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert packing.pack(docs, bpe.default_path()).select("doc_id").distinct().count() == docs.count()
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
