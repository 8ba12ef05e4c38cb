import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import langid
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_minhash import brute as near


def test_stages_match_brute_force(spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    steps, frame = [], docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        if name != "packing":
            assert frame.columns == columns
            frame = spark.createDataFrame(frame.collect(), frame.schema)
        steps.append(frame.collect())
    language, exact, unique, clean, packed = steps
    model = langid.train(docs)
    accepted = {r.doc_id for r in langid.identify(docs, model, ["doc_id"]).where("accepted").collect()}
    assert {r.doc_id for r in language} == accepted and not accepted & {90001, 90002} and len(accepted) >= docs.count() - 4
    last = {}
    for r in language:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in exact} == set(last.values())
    want = near([(r.doc_id, r.text) for r in exact], 5, 80)
    assert {r.doc_id for r in unique} == {k for k, (_, c) in want.items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {k for k, _, _ in overlaps([(r.doc_id, r.text) for r in unique], items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique} - bad
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in clean:
        ids = np.array(t.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for start, length, crc in sorted(pieces.pop(r.doc_id)):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    assert not pieces


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_every_stage_takes_clashing_names_and_empty_tables(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = "_id _hash _sha _len _keep gone id hash component_id kept lang_pred score accepted item c0 k0 f0 t".split()
    docs = base.selectExpr("*", *[f"n_chars AS `{n}`" for n in names])
    frame = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        none = stage(spark, frame.limit(0), sf)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == frame.columns == none.columns
            assert all(r.n_chars == r[n] for r in out.collect() for n in names)
        assert out.count() > 20


def test_pipeline_without_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert corpus_pipeline.identify_language(spark, docs, sf).count() == docs.count()
