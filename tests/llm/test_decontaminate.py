import itertools
import random
import re

from siftstone.llm import decontaminate as d


def test_masks_miss_no_window():
    def safe(width, errors):
        places = [{i + o for o in m} for m in d.MASKS for i in range(width - m[-1])]
        return all(any(not p & set(e) for p in places) for e in itertools.combinations(range(width), errors))

    for width in range(d.MIN_WORDS, d.WINDOW + 1):
        assert safe(width, width * d.SUBSTITUTIONS // d.WINDOW)


def brute(docs, items):
    split = lambda t: re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u4e00-\u9fff]+", (t or "").lower())
    out = set()
    for n, (k, t) in enumerate(docs):
        w = split(t)
        for item, b in items:
            b = split(b)
            if not b:
                continue
            width = min(d.WINDOW, len(b))
            allowed = width * d.SUBSTITUTIONS // d.WINDOW if len(b) >= d.MIN_WORDS else 0
            for start in range(-len(b), len(w)):
                same = [0 <= start + j < len(w) and w[start + j] == b[j] for j in range(len(b))]
                if any(same[s : s + width].count(False) <= allowed for s in range(len(b) - width + 1)):
                    out.add((k, n, item))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 8, 9, 12, 13, 14, 30])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for k in range(150):
        w = say(rng.randint(0, 40))
        if rng.random() < 0.7:
            b = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if b:
                    b[rng.randrange(len(b))] = rng.choice(vocabulary)
            lo = rng.choice([0, 0, 1])
            b = b[lo : len(b) - rng.choice([0, 0, 2])]
            w[rng.randint(0, len(w)) :] = [x.upper() + rng.choice(["", ",", "!"]) for x in b] + say(rng.randint(0, 9))
        docs.append((k, "  ".join(w)))
    docs += [(None, docs[0][1]), (None, items[3][1] + " " + items[3][1]), (1000, None), (1001, " ?! "), (5, docs[5][1]), (2000, "long " * 50_000 + items[4][1])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, hash int")
    rows = d.decontaminate(frame, bench).collect()
    want = brute(docs, items)
    by = {}
    for k, n, item in want:
        by.setdefault(n, set()).add(item)
    expected = sorted(((k, sorted(by.get(n, set()))) for n, (k, _) in enumerate(docs)), key=str)
    assert sorted(((r.doc_id, list(r.item_ids)) for r in rows), key=str) == expected
    assert all(r.contaminated == bool(r.item_ids) == (r.n_overlaps > 0) for r in rows)
    assert 20 < sum(r.contaminated for r in rows) < 140


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Alpha beta"), (2, "gamma"), (3, "東京の春は花がとても美しい"), (4, "?!"), (5, "one two three four five six seven")]
    docs = [(1, "say alpha, BETA now"), (2, "alpha x beta"), (3, "the gamma ray"), (4, "gammas"), (5, "まず東京の春は花がとても美しいです"), (6, "東京"), (7, "one two three four five six eight"), (8, "one two three four five six seven")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = d.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, i) for r in rows for i in r.item_ids} == {(k, i) for k, _, i in brute(docs, items)} == {(1, 1), (3, 2), (5, 3), (8, 5)}


def test_keep_clean_with_clashing_names(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    docs = [(1, "x " + items[0][1], "a", 1, 2), (2, "other", "b", 3, 4), (None, items[0][1], "c", 5, 6), (None, None, "d", 7, 8)]
    frame = spark.createDataFrame(docs, "_id long, text string, _hash string, hash int, id int")
    bench = spark.createDataFrame(items, "item long, iw string")
    kept = d.keep_clean(frame, bench, "_id", "text", "item", "iw")
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([docs[1], docs[3]], key=str)
    assert d.keep_clean(frame.limit(0), bench, "_id", "text", "item", "iw").count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in d.decontaminate(docs, bench).collect()] == [(1, False, 0, 0, [])]
    assert d.decontaminate(docs.limit(0), bench).count() == 0
