import random

import numpy as np

from siftstone.llm import minhash


def brute(rows, width, percent):
    sets = [minhash.shingle_set(t or "", width) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                comp[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: (len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


def varied(seed):
    """Groups of texts that drift apart word by word, across the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200, 400]))]
        for _ in range(rng.randint(1, 14)):
            rows.append((k, " ".join(text)))
            k += 1
            if rng.random() < 0.8:
                text = list(text)
                for _ in range(rng.randint(0, 1 + len(text) // 40)):
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    odd = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One Word"), (9005, "one\nword"), (9006, "É x"), (9007, "é x"), (9008, "z " * 60_000)]
    rows = varied(1) + odd
    docs = spark.createDataFrame([(a, b, 0, "n") for a, b in rows], "doc_id long, text string, n int, node string")
    for width, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(docs, width, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_documents_sample_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = base[:2000], base[500:2500]  # similarity 1500 / 2500
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 2000]), 512)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 0.6) < 0.08


def test_chain_is_one_component(spark):
    from siftstone.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_large_group_around_the_threshold(spark, monkeypatch):
    """One hot group: each text changes words of the same base, so that pairs lie on both sides of the threshold."""
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "SLICE", 16)
    monkeypatch.setattr(minhash, "CROSS", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(160):
        text = list(base)
        for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert 1 < len({c for _, c in want.values()}) < 160
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, bits=0).collect()} == want
    # With signature bits, too, no link is lost here.
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()} == want


def test_nothing_is_broadcast_beyond_its_bound(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_SKETCHES", 0)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want


def test_many_nodes_just_below_the_threshold_make_no_rows_of_pairs(spark, monkeypatch):
    """Each two of 150 texts are about 0.82 alike: whatever is written has a few rows for each text, not one for each pair."""
    rng, made, cut = random.Random(3), [], minhash.cut

    def counted(df):
        out = cut(df)
        made.append(out.count())
        return out

    base = [f"b{i}" for i in range(600)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(0, 600, 3), 10):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    rows += [(200, rows[0][1] + " end"), (201, rows[140][1] + " end")]
    monkeypatch.setattr(minhash, "cut", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) >= 130
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert max(made) < 40 * len(rows) < len(rows) ** 2 / 3, made


def test_signature_bits_rule_out_no_pair_above_the_threshold():
    """Of 2000 pairs of sets just above the threshold all pass; the chance of losing one is 3e-7 each."""
    rng = np.random.default_rng(9)
    p = (1 - 0.85) / 2
    most = int(minhash.BITS * p + minhash.DEVIATIONS * (minhash.BITS * p * (1 - p)) ** 0.5)
    lost = 0
    for _ in range(20):
        sets, starts = [], []
        for _ in range(100):
            n = int(rng.integers(30, 300))
            both = int(np.ceil(0.85 / 1.85 * 2 * n))  # of n each: similarity both / (2 n - both)
            pool = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            for part in (pool[:n], pool[n - both :]):
                starts.append(sum(map(len, sets)))
                sets.append(part)
        bits = minhash.signatures(np.concatenate(sets), np.array(starts), minhash.BITS) >> np.uint32(7) & np.uint32(1)
        lost += int(((bits[:, ::2] != bits[:, 1::2]).sum(axis=0) > most).sum())
    assert lost == 0


def test_equal_hashes_of_different_shingles_are_told_apart():
    word = np.array([0, 1, 2, 3, 0, 1])
    first = np.arange(5)  # of width 2: 01 12 23 30 01
    assert minhash.set_size(np.array([9, 8, 7, 6, 9], np.uint64), first, word, 2) == 4
    assert minhash.set_size(np.array([9, 9, 7, 6, 9], np.uint64), first, word, 2) == 4


def test_keep_representatives_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 1), (2, "a b c d e f", 6, 2), (None, "a b c d e f", 7, 3), (4, None, 8, 4), (5, "z", 9, 5)], "gone long, text string, c0 long, id long")
    kept = minhash.keep_representatives(docs, id_col="gone")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in map(tuple, docs.collect()) if r[0] != 2], key=str)
    assert minhash.keep_representatives(docs.limit(0), id_col="gone").count() == 0


def test_small_tables_fill_few_partitions_of_a_wide_shuffle(spark, monkeypatch):
    """What is written has as many partitions as its rows fill, not as many as a shuffle has, and so few files and tasks."""
    from siftstone.llm import components

    written, cut, wide = [], minhash.cut, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def counted(df):
        out = cut(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(minhash, "cut", counted)
    monkeypatch.setattr(components, "cut", counted)
    rows = varied(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    before = {k: spark.conf.get(k, None) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = minhash.near_duplicates(docs, 3, 85).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)
    # The sketches have those of the table, the tiles of the last step one for each partition of their blocks.
    assert len(written) > 10 and max(sorted(written)[:-2]) == 1 and max(written) <= 64, written


def test_components_in_several_partitions(spark):
    from siftstone.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60_000) if i % 7] + [(70_000, i) for i in range(0, 60_000, 2000)]
    random.Random(5).shuffle(edges)
    comp = list(range(70_001))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for u, v in edges:
        u, v = find(u), find(v)
        comp[max(u, v)] = min(u, v)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == {i: find(i) for i in {x for e in edges for x in e} if find(i) != i}
