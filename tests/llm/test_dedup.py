import random

import brute
import pytest
from ruleforge.llm import blocks, graph, jaccard, substring_dedup, suffix_dedup

key = lambda r: tuple((x is not None, x) for x in r)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


OPERATORS = [(substring_dedup.removed_words, brute.substring_words), (suffix_dedup.removed_bytes, brute.repeated_bytes), (jaccard.jaccard_components, brute.jaccard)]


@pytest.mark.parametrize("operator, expected", OPERATORS)
def test_edges_against_brute_force(edge_docs, edge_rows, operator, expected):
    assert rows_of(operator(edge_docs)) == sorted(expected(edge_rows), key=key)


@pytest.mark.parametrize("operator, expected", OPERATORS)
def test_table_against_brute_force(spark, sf_dir, operator, expected):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(operator(docs)) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("operator, expected", OPERATORS)
def test_empty(no_docs, operator, expected):
    assert operator(no_docs).collect() == []


@pytest.mark.parametrize("operator, expected", OPERATORS)
def test_random_small_alphabet(spark, operator, expected):
    r = random.Random(8)
    rows = []
    for d in range(60):
        words = [r.choice(("x", "y", "zz")) for _ in range(r.randrange(0, 60))]
        rows.append((r.randrange(40), " ".join(words)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])]
    assert rows_of(operator(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(expected(rows), key=key)


def test_removed_spans_and_text(edge_docs, edge_rows):
    for r in substring_dedup.removed_words(edge_docs, with_text=True).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert brute.sha(r.kept.encode()) == r.kept_sha256
    for r in suffix_dedup.removed_bytes(edge_docs, with_text=True).collect():
        assert len(r.removed) == r.n_spans and brute.sha(bytes(r.kept)) == r.kept_sha256


def test_keep_one(spark, edge_docs, edge_rows):
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = {}
    for (d, n, c), (_, t) in zip(brute.jaccard(edge_rows), edge_rows):
        groups.setdefault((c, t if n == 0 else None) if n else ("alone", d, t), []).append((d, t))
    ids = [d for d, _ in found]
    assert 1 in ids and 17 not in [d for d in ids if d == 3]
    assert all(any(m in found for m in g) for g in groups.values())
    assert len([1 for d, t in found if t == edge_rows[0][1]]) == 1


def near_copies(r, n, changes):
    base = [f"w{i}" for i in range(60)]
    for d in range(n):
        w = list(base)
        for _ in range(r.choice(changes)):
            w[r.randrange(60)] = f"u{r.randrange(10**6)}"
        yield d, " ".join(w)


@pytest.mark.parametrize("changes", [(2,), (1, 2, 3, 4), (0, 1, 5)])
def test_cells_split_groups(spark, changes):
    """A group larger than a cell gives the same links, through its core and the sets outside of it."""
    rows = list(near_copies(random.Random(2), 80, changes))
    sets = jaccard.document_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = graph.written(sets.where("prefix > 0"))
    for percent in (60, 75):
        whole, split = ({(min(x), max(x)) for x in map(tuple, jaccard.components(jaccard.heavy_links(classes, 1, percent, cell, cell)).collect())} for cell in (10**6, 300))
        assert whole == split and whole


def test_scans_stop_at_the_core():
    """Links within one list: those of all pairs, though not every set scans."""
    import numpy as np

    r = random.Random(3)
    for _ in range(40):
        rows = [(k, 12, np.array(sorted(r.sample(range(r.choice((16, 30))), 12)), np.int64)) for k in range(25)]
        want = list(range(25))
        for a in rows:
            for b in rows:
                both = len(set(a[2].tolist()) & set(b[2].tolist()))
                if 100 * both >= 70 * (24 - both):
                    x, y = want[a[0]], want[b[0]]
                    want = [min(x, y) if v in (x, y) else v for v in want]
        got = list(range(25))
        for a, b in jaccard.cell_links(rows, None, 70):
            x, y = got[a], got[b]
            assert x != y
            got = [min(x, y) if v in (x, y) else v for v in got]
        assert got == want


def test_boundary_follows_cost():
    assert jaccard.boundary({5: 100, 24: 1}, 85) == 13 or jaccard.boundary({5: 100, 24: 1}, 85) >= 5
    assert jaccard.boundary({24: 1000}, 85) < 24
    assert [jaccard.n_subsets(s, 85) for s in (6, 7, 13)] == [1, 8, 14]


def test_packing_round_trip():
    import numpy as np

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    table = blocks.entry_rows(3, 1, 7, keys, keys.astype(np.int64))
    seen = [np.cumsum(blocks.unpack(blocks.unframe(b.as_py())[0], np.uint64), dtype=np.uint64) for b in table.column("payload")]
    assert (np.concatenate(seen) == keys).all() and max(table.column("bucket").to_pylist()) < 7


def pattern(n, letters):
    """The first n letters of the Thue-Morse word: it and its complement cancel out in sums of powers."""
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_that_cancel_out(spark, size):
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*words, pattern(size, letters)])) for i, letters in enumerate(("ab", "ba"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for operator, expected in OPERATORS:
        assert rows_of(operator(docs)) == sorted(expected(rows), key=key)


def test_long_text_in_parts(monkeypatch):
    """Parts of a long document give the same words and the same strings as the whole."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)
    texts = [" ".join("ab"[r.randrange(2)] * r.randrange(1, 30) for _ in range(r.randrange(300))) for _ in range(30)] + ["x" * 900, "", " "]
    raw, offsets = blocks.flat(pa.array(texts))
    whole = blocks.words(raw, offsets)
    for size in (50, 1000, 1 << 20):
        parts = list(blocks.word_pieces(raw, offsets, size))
        assert parts[0][0] == 0 and parts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        found = [blocks.words(raw[a:b], np.unique(np.concatenate([[0], offsets[(offsets > a) & (offsets < b)] - a, [b - a]]))) for a, b in parts]
        assert (np.concatenate([f[0] + a for f, (a, _) in zip(found, parts)]) == whole[0]).all()
    want = suffix_dedup.block_contexts(raw, offsets, 100, 64)
    monkeypatch.setattr(blocks.stretches, "__defaults__", (150,))
    got = suffix_dedup.block_contexts(raw, offsets, 100, 64)
    starts = lambda c: [(t, i) for t, a, b in zip(c[0].tolist(), c[1].tolist(), c[2].tolist()) for i in range(a, b + 1)]
    assert starts(want) == starts(got)


def test_corpus_order_gives_equal_strings_one_class():
    import numpy as np
    import pyarrow as pa

    r = random.Random(10)
    for letters in ("a", "ab", "abcdefgh "):
        base = "".join(r.choice(letters) for _ in range(600))
        raw, offsets = blocks.flat(pa.array([base[r.randrange(300) :] + base[: r.randrange(600)] for _ in range(10)] + [base, base]))
        trigger, low, high, *_, triggers = suffix_dedup.block_contexts(raw, offsets, 100, 64)
        some = np.arange(0, len(trigger), 2)
        _, start, kind = suffix_dedup.corpus_order(raw, offsets, triggers, trigger[some], low[some], high[some], 100, 64)
        data, by_class = raw.tobytes(), {}
        for s, k in zip(start.tolist(), kind.tolist()):
            assert by_class.setdefault(k, data[s : s + 100]) == data[s : s + 100]
        assert len(set(by_class.values())) == len(by_class) and len(start) == int((high - low + 1)[some].sum())


def test_buckets_grow_slower_than_blocks():
    for size in (1, 10**9, 10**12, 10**14):
        n, buckets = blocks.n_blocks(size), blocks.n_buckets(size)
        assert 16 <= buckets <= n and size / n <= blocks.LARGEST_BLOCK
        if n > 10**5:  # entries, one for some 32 bytes, outnumber the rows that carry them
            assert size / 32 > 15 * n * buckets


def test_sizes_are_measured(spark):
    docs = spark.createDataFrame([(i, "abc") for i in range(10)], "doc_id long, text string")
    assert blocks.text_bytes(docs.crossJoin(spark.range(3).withColumnRenamed("id", "x"))) == 90 and blocks.text_bytes(docs.limit(0)) == 0
