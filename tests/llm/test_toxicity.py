import itertools

import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import queries, toxicity


def kernel_sum(word, table):
    """Brute force: the weighted sum over all subsequences of 4 letters within the span."""
    total = 0.0
    for at in itertools.combinations(range(len(word)), 4):
        if at[-1] - at[0] < toxicity.SPAN:
            number = 0
            for i in at:
                number = number << 5 | (ord(word[i]) - 96)
            total += toxicity.DECAY ** (at[-1] - at[0] - 3) * table[number]
    return total


def test_window_sums_match_brute_force():
    table = np.random.default_rng(0).random(toxicity.CODES).astype(np.float32)
    for shift in (0, 5, 10, 15):
        table[(np.arange(toxicity.CODES) >> shift & 31) == 0] = 0
    for word in ("scum", "pathetic", "abcdefghijkl", "abc"):
        x, starts = toxicity.letter_stream(pa.array([word]))
        assert toxicity.window_sums(x, table)[starts[0]] == pytest.approx(kernel_sum(chr(96 + toxicity.GAP) + word + chr(96 + toxicity.GAP), table), rel=1e-4)


def test_letter_stream():
    x, starts = toxicity.letter_stream(pa.array(["i. d i-o t", "Éa\n\n b1c", "", "12 a"]))
    words = ["".join(" " if c in (0, toxicity.GAP) else chr(96 + c) for c in x[a:b]).strip() for a, b in zip(starts, [*starts[1:], len(x)])]
    assert words == ["idiot", "ea bic", "", "a"]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    bits = ["the", "on", "tion", "er", "st", "in", "and", "wh", "le", "ou", "ha", "re"]
    say = lambda: " ".join("".join(rng.choice(bits, rng.integers(1, 4))) for _ in range(40))
    texts = [say() for _ in range(300)]
    toxic = [int(i % 3 == 0) for i in range(300)]
    texts = [f"{t[:90]} {rng.choice(['idiot', 'disgusting', 'clown'])} {t[90:]}" if y else t for t, y in zip(texts, toxic)]
    return toxicity.fit(texts, toxic)


def test_plain_gapped_and_inserted(model):
    p = lambda t: float(model.probability(model.margins(pa.array([t])))[0])
    for t in ("the idiot and on", "the i d i o t on", "the id-iot on", "the idxiot on", "dis gusting", "disgusxting", "x" * 30_000 + " clown " + "the on " * 20_000):
        assert p(t) >= 0.5, t
    for t in ("", "the on and", "12 34", "stinthe erouha " * 500, "whre leouin the tion"):
        assert p(t) < 0.5, t
    # A text's score doesn't depend on its neighbours in a batch.
    both = model.probability(model.margins(pa.array(["idiot", "", "the on", "idiot", "the on"])))
    assert both[1] < 0.5 > both[2] and both[0] == both[3] and both[2] == both[4]


def test_rows(spark, sf, model):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "idiot", "b"), (3, "", "c")], "doc_id long, text string, score string")
    rows = toxicity.score(docs, model, ["doc_id", "score"]).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in rows) == [("1", 0), ("1", 0), ("3", 0), ("None", 1)]
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_held_out_english(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.op6_toxicity(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang = 'en'").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.95


def brute_stream(text):
    """Letters as the docstrings say: one gap for what isn't a letter, lookalikes beside letters, spelled-out words joined."""
    code, alike = toxicity._tables()
    x = [int(code[ord(c)]) for c in text]
    raw = [int(alike[ord(c)]) for c in text]
    near = [any(x[j] for j in (i - 1, i + 1) if 0 <= j < len(x)) for i in range(len(x))]
    x = [r if r and n else v for v, r, n in zip(x, raw, near)]
    x = [v for i, v in enumerate(x) if v or i == 0 or x[i - 1]]
    alone = [v > 0 and all(x[j] == 0 for j in (i - 1, i + 1) if 0 <= j < len(x)) for i, v in enumerate(x)]
    x = [v for i, v in enumerate(x) if v or not (0 < i < len(x) - 1 and alone[i - 1] and alone[i + 1])]
    return [toxicity.GAP, *[v or toxicity.GAP for v in x], toxicity.GAP]


def brute_margin(text, model):
    x = brute_stream(text)
    start = []
    for i in range(len(x)):
        total = 0.0
        for rest in itertools.combinations(range(i + 1, min(i + toxicity.SPAN, len(x))), 3):
            number = 0
            for j in (i, *rest):
                number = number << 5 | x[j]
            total += toxicity.DECAY ** (rest[-1] - i - 3) * float(model.table[number])
        start.append(total)
    return max(sum(start[i : i + toxicity.WINDOW]) for i in range(len(x))) + model.bias


def test_query_scores_match_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op6_toxicity(spark, sf).collect()}
    short = docs.where("length(text) < 700").orderBy("doc_id").limit(25).collect()
    assert len(short) > 10 and len(got) == docs.count()
    for r in short:
        want = 1 / (1 + np.exp(-(model.slope * brute_margin(r.text, model) + model.offset)))
        assert got[r.doc_id] == pytest.approx(want, abs=2e-3)


def test_support_vector_machine_is_optimal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    y = np.where(x[:, 0] + 0.4 * rng.normal(size=200) > 0, 1.0, -1.0)
    w = toxicity._svm(x, y)
    z = np.concatenate([x, np.ones((200, 1))], axis=1)
    c = 1000 * np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
    value = lambda v: 0.5 * (v[:-1] ** 2).sum() + 0.5e-6 * v[-1] ** 2 + (c * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    assert all(value(w) <= value(w + step) for step in rng.normal(scale=1e-3, size=(300, 7)))
