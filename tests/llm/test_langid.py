import numpy as np
import pytest

from siftstone.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.accepted.mean() > 0.99 and out.score.between(0, 1).all()


def test_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (3, "12 !?", "q"), (None, "the and of with", "q"), (5, "ж" * 100_000, "q")], "doc_id long, text string, lang_pred string")
    got = {(r.doc_id, r.lang_pred, r.accepted) for r in langid.identify(odd, model, odd.columns).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", True)} <= got
    assert not next(a for d, _, a in got if d == 5)
    assert langid.identify(odd.limit(0), model, ["doc_id"]).count() == 0
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(odd, None, ["doc_id"]).collect()} == {"und"}


def brute_counts(text):
    """Letters, pairs and triples ending or beginning at each letter, hashed one at a time with whole numbers."""
    m = 2**32
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    x = [ord(low(c)) if c.isalpha() else 0 for c in text]
    out = {}
    for i, c in enumerate(x):
        if text[i].isalpha():
            after, before = x[i + 1] if i + 1 < len(x) else 0, x[i - 1] if i else 0
            one = c * 2654435761 % m
            two = one ^ (after * 2246822519 + 374761393) % m
            three = two ^ (before * 3266489917 + 668265263) % m
            for h in (one, two, three):
                at = (h ^ (h >> 15)) * 2246822519 % m >> 19
                out[at] = out.get(at, 0) + 1
    return out


def test_counts_match_brute_force():
    import pyarrow as pa

    texts = ["Abc d", "é", "", "Abc d", "İstanbul 12ßx", "日本 a"]
    (counts, letters), = list(langid.count_ngrams(pa.array(texts)))
    for t, row, n in zip(texts, counts, letters):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == brute_counts(t) and n == sum(c.isalpha() for c in t)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    rows = docs.orderBy("doc_id").limit(40).collect()
    for r in rows:
        counts = brute_counts(r.text or "")
        v = {i: np.log1p(n) * float(model.idf[i]) for i, n in counts.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        cosine = {}
        for k, c in zip(model.owner.tolist(), model.centroids):
            cosine[k] = max(cosine.get(k, -1.0), sum(x * float(c[i]) for i, x in v.items()) / size)
        best = max(cosine, key=lambda k: (cosine[k], -k))
        assert got[r.doc_id].lang_pred == model.langs[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp((c - cosine[best]) / 0.05) for c in cosine.values()), rel=1e-3)
        assert got[r.doc_id].accepted == (cosine[best] >= model.floor[best])


def test_every_language_is_learned(spark):
    """More languages than any list of them would hold, each with letters of its own."""
    rows = [(i, chr(0x4E00 + 7 * (i % 350)) * 3 + " " + chr(0x4E00 + 7 * (i % 350) + 1) * 5, f"l{i % 350:03d}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, clusters=1)
    assert len(model.langs) > 340
    out = langid.identify(docs, model, ["doc_id"]).join(docs, "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.9
