import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from siftstone.llm import cutting_stock, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Hello  world\n<|endoftext|> foo\x1cbar   baz \xa0 q"),
    (2, None),
    (3, ""),
    (4, "it's  can't 12 ab12 é é ÀÉ"),
    (5, "w " * 9000),
    (5, "w " * 9000),
    (None, "null id"),
    (6, "   "),
]


def expected(docs, end_id=2):
    t = Tokenizer.from_file(PATH)
    return {k: t.encode(v or "", add_special_tokens=False).ids + [end_id] for k, v in docs}


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return ODD + rows


def test_plan_is_whole_and_tight(spark, docs):
    frame = spark.createDataFrame([(a, b, 9, "x") for a, b in docs], "doc_id long, text string, length int, sequence_id string")
    out = packing.plan_sequences(frame, PATH, 4096, 2).collect()
    want = expected(docs)
    got, rows = {}, {}
    for r in out:
        got.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, ids in want.items():
        raw = np.array(ids, "<u4").tobytes()
        at = 0
        for start, length, crc, total in sorted(got[k]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(raw[4 * start : 4 * (start + length)])
            at += length
        assert at == len(ids)
    assert sum(r.length for r in out) == sum(len(want[k]) for k, _ in docs)
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in out) / (len(rows) * 4096) > 0.9


def test_plan_of_nothing(spark):
    assert packing.plan_sequences(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cutting_stock_covers_within_room():
    rng = np.random.default_rng(5)
    size, room = np.arange(1, 65), 64
    for demand in (rng.integers(0, 500, 64), rng.integers(0, 3, 64), np.eye(64, dtype=int)[40] * 7):
        patterns, times = cutting_stock.solve(demand[demand > 0], size[demand > 0], room)
        assert (patterns @ size[demand > 0] <= room).all() and (times @ patterns >= demand[demand > 0]).all()
        plain = packing.best_fit_decreasing(np.repeat(size, demand), room).max() + 1
        assert times.sum() <= plain + 2


def test_best_fit_decreasing_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(0, 60))
        got = packing.best_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [f for f in free if f >= sizes[i]]
            if fits:
                free[free.index(min(fits))] -= sizes[i]
            else:
                free.append(100 - sizes[i])
        loads = np.bincount(got, sizes, minlength=1)
        assert sorted(loads[loads > 0]) == sorted(100 - f for f in free)


def test_matrices_give_all_ids_back(spark, docs):
    frame = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, ids string").repartition(3)
    rows = packing.token_matrices(frame, PATH, length=512, end_id=2, pad_id=7, buffer_tokens=20_000).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 512 and r.dtype == "uint16" and (ids[r.n_tokens :] == 7).all() and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == [0, *r.cu_seqlens[1:-1]] + [r.n_tokens] * (r.n_tokens < 512)
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, {}).setdefault(s, ids[a:b].tolist())
    for k, ids in expected(docs).items():
        assert [i for s in sorted(parts[k]) for i in parts[k][s]] == ids
    assert sum(r.n_tokens for r in rows) == sum(len(expected([d])[d[0]]) for d in docs)


def test_matrices_written_and_read(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").coalesce(1)
    packing.write_token_matrices(frame, str(tmp_path / "m"), PATH, length=8, end_id=None)
    (row,) = spark.read.parquet(str(tmp_path / "m")).collect()
    assert row.doc_ids == [1] and row.n_tokens == 2
    assert packing.token_matrices(frame.limit(0), PATH).count() == 0


def test_letters_and_closing_punctuation_take_the_short_way():
    """Words of letters are learnt without special tokens between them, closing punctuation apart; the ids are those of whole texts."""
    import random

    import pyarrow as pa

    from siftstone.llm import tokens

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghilmnorstuzéßñÉжλ字ǅ") for _ in range(rng.randint(1, 9))) for _ in range(600)]
    ends = ["", "", "", ".", "!!", ".%%%", ",$$$", "&&&", "?)", "'", "'s", "…", "×!!", "<|endoftext|>", "<|endoftext|>.", "|>", "_", "\u0301", "\u0301!!", "=\u0338", "1", "1;"]
    texts = [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    encoder = tokens.Encoder(PATH, 2)
    assert {"!", "%", "&"} <= set(encoder.points) and not set("'<|>") & set(encoder.points) and encoder.splits_ends
    handed = []

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, batch, **options):
            handed.extend(batch)
            return self.inner.encode_batch_fast(batch, **options)

    encoder.tokenizer = Spy(encoder.tokenizer)
    ids, at = encoder.encode(pa.array(texts))
    plain = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [2], t
    assert any(t.replace(" ", "").isalpha() for t in handed)
    assert "!!" in encoder.number and not any(w[0].isalpha() and w.endswith("&&&") and w[:-3].isascii() for w in encoder.number)


def test_memory_of_a_slice_is_given_back_before_the_next(spark, monkeypatch):
    """Between slices a worker holds no memory that it could give back."""
    import random
    import re
    from pathlib import Path

    import pyarrow as pa

    from siftstone.llm.batches import release

    smaps = Path("/proc/self/smaps_rollup")
    if not smaps.exists():
        pytest.skip("memory can't be read here")

    def mb():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", smaps.read_text())[1]) / 1024

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60_000)]
    ids = pa.array(range(100), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array([" ".join(rng.choices(words, k=20_000)) for _ in range(100)])], ["doc_id", "text"])
    held = []

    def batches():
        for _ in range(3):
            release()
            yield batch
            before = mb()
            release()
            held.append(before - mb())

    frame = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    out = list(packing.token_pieces(frame, PATH, 4096, 2)(batches()))
    assert sum(sum(b.column("length").to_pylist()) for b in out) == sum(b.column("doc_tokens").to_numpy()[b.column("start").to_numpy() == 0].sum() for b in out) > 0
    assert max(held) < 10, held
