"""Tokens against the tokenizers library, packing as an exact cover, search and passages by brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basalt.llm import bpe, packing, queries, search

ODD = [(1, None), (2, ""), (3, "a" * 5000), (4, "<|endoftext|> a<|endoftext|>"), (5, "it's  we'll\n\n'tis x'S  \t y  "), (6, "日本語 ½² é́ \u0085\u2003x"), (6, "日本語 ½² é́ \u0085\u2003x"), (7, " " * 3000 + "!" * 200), (None, "null key"), (8, "'" * 9 + "re")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocab():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def encode(vocab, texts):
    import pyarrow as pa

    from basalt.llm import text as tx

    out = []
    for _, _, data, offsets in tx.chunks(pa.array(texts, pa.string())):
        ids, bounds = vocab.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("abcdefghijklmnopqrstuvwxyz '\n\t.!0123456789éß日"), st.characters(blacklist_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_any_text(vocab, library, texts):
    assert encode(vocab, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_by_all_ways(vocab):
    """Greedy proposals that pass the pair test, rounds over all words, and the heap agree."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.choice(list(b"aaabcdeinrst"), rng.integers(1, 30)).tolist()) for _ in range(3000)]
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    flat, counts = vocab.encode_words(joined, ends - np.array([len(w) for w in words]), ends)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, w in enumerate(words):
        assert flat[at[k] : at[k + 1]].tolist() == vocab.exact(w)
        ids = np.array(vocab.greedy(w))
        if vocab.compatible(ids[:-1], ids[1:]).all():
            assert ids.tolist() == vocab.exact(w)


def test_round_trip_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("n_tokens", F.lit("clash"))
    rows = bpe.round_trip(docs, bpe.default_path()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_back(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    path = bpe.default_path()
    for r in bpe.decode_ids(bpe.encode_text(docs, path), path).collect():
        assert r.decoded == (r.text or "")
    assert bpe.encode_text(docs.limit(0), path).count() == 0
    broken = spark.createDataFrame([([50000, 107],), (None,)], "ids array<int>")
    assert [r.decoded is None for r in bpe.decode_ids(broken, path).collect()] == [False, True]


def test_every_odd_text_alone(spark, library):
    """A partition of one text, whatever it is: no other word comes with it."""
    path = bpe.default_path()
    texts = [t for _, t in ODD] + ["a" * 100, "<|endoftext|>", "\n", "\u00e9" * 40, "x" * 65 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts), "doc_id")
    for i in range(len(texts)):
        docs = docs.union(spark.createDataFrame([(100 + i, texts[i])], "doc_id long, text string").coalesce(1))
    rows = bpe.round_trip(docs, path).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    pieces = packing.pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.n_tokens + 1 for r in rows}


def test_words_of_equal_hashes(vocab, library, monkeypatch):
    """Even where all hashes collide, the ids are those of the bytes."""
    from basalt.llm import text as tx

    words = " ".join(f"w{i} other{i}" for i in range(200)) + "<|endoftext|> end"
    own = tx.range_hashes
    vocab.reset()
    monkeypatch.setattr(tx, "range_hashes", lambda d, s, e: own(d, s, e) & np.uint64(3))
    assert encode(vocab, [words, "more " + words]) == [e.ids for e in library.encode_batch([words, "more " + words], add_special_tokens=False)]
    vocab.reset()


@pytest.mark.parametrize("size", [64, 1024])
def test_packing_is_an_exact_cover(spark, sf, library, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 20").union(spark.createDataFrame([r for r in ODD if r[0] is not None], "doc_id long, text string").dropDuplicates(["doc_id"]))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    pieces = packing.pack(docs, bpe.default_path(), size=size, with_ids=True).toPandas()
    for doc, g in pieces.sort_values("start").groupby("doc_id"):
        ids = library.encode(text[doc], add_special_tokens=False).ids + [0]
        assert np.concatenate(g.ids.tolist()).tolist() == ids and (g.doc_tokens == len(ids)).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert set(pieces.doc_id) == set(text)
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= size
        padding += size - g.length.sum()
    assert padding < 0.02 * pieces.length.sum() and sorted(set(pieces.sequence_id)) == list(range(pieces.sequence_id.nunique()))


def test_packing_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x")], "doc_id long, text string")
    assert packing.pack(docs, bpe.default_path()).count() == 4
    assert packing.pack(docs.limit(0), bpe.default_path()).count() == 0


def test_linear_program_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 200, 20_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    patterns = packing.integer_patterns(histogram, 200)
    held: dict[int, int] = {}
    for pattern, times in patterns:
        assert sum(r * a for r, a in pattern) <= 200
        for r, a in pattern:
            held[r] = held.get(r, 0) + a * times
    assert held == histogram and sum(t for _, t in patterns) <= lengths.sum() / 200 * 1.01 + 1


def remainders(vocab, sf_dir, size):
    """How many documents leave a last piece of each length."""
    import pyarrow.parquet as pq

    from basalt.llm import text as tx

    found = np.zeros(size, np.int64)
    for _, _, data, offsets in tx.chunks(pq.read_table(f"{sf_dir}/documents.parquet").column("text")):
        found += np.bincount((np.diff(vocab.encode(data, offsets)[1]) + 1) % size, minlength=size)
    return {r: int(found[r]) for r in range(1, size) if found[r]}


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_column_generation_decides(vocab, scale):
    """Patterns enter by pricing, the program ends at its bound, and its rounding needs no more sequences than first-fit decreasing."""
    left = remainders(vocab, f"/root/testdata/sf{scale}", 1024)
    lengths = np.array(sorted(left))
    program = packing.CuttingStock(lengths, np.array([left[r] for r in lengths.tolist()], float), 1024)
    begun = program.total
    program.solve(packing.GAP)
    assert program.pivots > len(lengths) / 2 and program.total < 0.95 * begun
    covered = dict.fromkeys(left, 0.0)
    for column, x in zip(program.columns, program.counts.tolist(), strict=True):
        assert sum(r * n for r, n in column.items()) <= 1024 and x > -1e-6
        for r, n in column.items():
            covered[r] += n * x
    assert covered == pytest.approx(left, rel=1e-5, abs=1e-5)
    plain = sum(packing.first_fit([r for r in sorted(left, reverse=True) for _ in range(left[r])], 1024).values())
    assert sum(n for _, n in packing.integer_patterns(left, 1024)) <= plain


def test_column_generation_beats_first_fit():
    """Lengths for which first-fit decreasing wastes room: 44 + 24 + 32 and 46 + 30 + 24 fill a sequence."""
    histogram = {46: 60, 44: 60, 32: 60, 30: 60, 24: 120}
    assert sum(n for _, n in packing.integer_patterns(histogram, 100)) <= 122
    assert sum(packing.first_fit([r for r in sorted(histogram, reverse=True) for _ in range(histogram[r])], 100).values()) > 125


def common_length():
    """Many pieces have one length or lie close to it, and few are short: a group of copies and one of near copies among others."""
    rng = np.random.default_rng(11)
    others = [rng.integers(low, high, n) for low, high, n in ((1, 16, 280), (16, 32, 220), (32, 64, 2000), (64, 88, 1400), (88, 128, 2500), (128, 250, 2100))]
    lengths = np.concatenate((*others, np.full(700, 82), np.rint(rng.normal(82, 2, 800)))).astype(np.int64)
    return dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))


def cover(patterns):
    held: dict[int, int] = {}
    for pattern, times in patterns:
        for r, a in pattern:
            held[r] = held.get(r, 0) + a * times
    return held


def test_a_common_length_takes_few_pivots():
    histogram = common_length()
    lengths = np.array(sorted(histogram))
    program = packing.CuttingStock(lengths, np.array([histogram[r] for r in lengths.tolist()], float), 256)
    program.open_up()
    assert program.total < program.least * 1.005
    patterns = packing.integer_patterns(histogram, 256)
    assert cover(patterns) == histogram and sum(t for _, t in patterns) < program.least * 1.002 + 1


@pytest.mark.parametrize("most", [0, 1])
def test_pivots_are_bounded(monkeypatch, most):
    """Where the program would go on, it ends, and all pieces are placed."""
    monkeypatch.setattr(packing, "MOST_PIVOTS", most, raising=False)
    histogram = common_length()
    lengths = np.array(sorted(histogram))
    program = packing.CuttingStock(lengths, np.array([histogram[r] for r in lengths.tolist()], float), 256).solve(-1.0)
    assert program.pivots <= most * len(lengths)
    assert cover(packing.integer_patterns(histogram, 256)) == histogram


def test_program_begins_again_from_its_basis():
    program = packing.CuttingStock(np.array([30, 40, 55]), np.array([100.0, 100.0, 7.0]), 100).solve(0.0)
    assert program.total == pytest.approx(3.5 + 3.5 + (6500 - 7 * 45) / 100 + 4, abs=6)
    total = program.total
    program.inverse = program.inverse + 0.01
    program.counts = program.counts + 1.0
    program.refresh()
    assert program.total == pytest.approx(total, rel=1e-6)


def test_search_query_is_duckdb(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLE['op7_top_k']})").fetchall())
    assert sorted(map(tuple, queries.op7_top_k(spark, sf).collect())) == want


@pytest.mark.parametrize("block", [3, 64])
def test_search_with_ties_and_odd_vectors(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(100, None), (200, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (400, []), (500, [1.0, 2.0]), (7, [2.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, search.top_k(df, F.col("vec_id") % 5 == 0, k=8, block=block).collect()))
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in good:
        if q % 5 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:8]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_search_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0 and search.top_k(df, F.lit(False)).count() == 0


def scored_share(vectors, k=10, block=2048):
    """The part of the query-row pairs that the dual search scores, and its results against all pairs."""
    ids = np.arange(len(vectors))
    asks = ids % 100 == 0
    tree = search.CoverTree(vectors[asks])
    best, names = np.full((asks.sum(), k), search.NONE), np.zeros((asks.sum(), k), np.int64)
    done = 0
    for a in range(0, len(ids), block):
        done += search.dual_search(tree, ids[asks], search.CoverTree(vectors[a : a + block]), ids[a : a + block], k, best, names)
    for row, q in enumerate(ids[asks]):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        assert names[row].tolist() == order and best[row].tolist() == scores[order].tolist()
    return done / (asks.sum() * len(ids))


def test_search_prunes_clustered_vectors():
    """Of vectors in clusters far less than half of the pairs are scored if they have one length, and fewer than all if lengths differ fourfold."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(40, 64))
    x = centers[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert scored_share(np.floor(1024 * unit).astype(np.int64)) < 0.4
    assert scored_share(np.floor(1024 * x * rng.uniform(0.5, 2, (6000, 1))).astype(np.int64)) < 0.7


def test_cover_tree_holds_its_points():
    x = np.random.default_rng(1).integers(-50, 50, (500, 6))
    tree = search.CoverTree(x)
    for n in range(len(tree.low)):
        own = x[tree.order[tree.low[n] : tree.high[n]]]
        assert np.sqrt(((own - tree.center[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9
        for c in tree.kids[n]:
            assert tree.radius[c] <= tree.radius[n] / 2 + 1e-9
