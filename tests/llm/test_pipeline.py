"""The corpus pipeline: each stage on small documents, and the whole."""

import os

import corpus_pipeline
import numpy as np
import pytest

from graphloom.llm import pack

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    base = str(tmp_path_factory.mktemp("sf"))
    said = {i: " ".join(rng.choice(WORDS, 80)) for i in range(30)}
    item = " ".join(rng.choice(WORDS, 12)) + " what is the capital of the moon"
    said[40] = said[3]
    said[41] = said[4].rsplit(" ", 1)[0] + " other"
    said[42] = said[5] + " " + item + " " + " ".join(rng.choice(WORDS, 80))
    said[43] = " ".join(rng.choice(WORDS, 80)) + " mail a.b@c.de now"
    said[44], said[45] = None, "too short"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in said.items()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(os.path.join(base, "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(base, "benchmark.parquet"))
    return base


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), DOCS)
        ids.append(sorted(r.doc_id for r in docs.collect()))
    assert ids[0] == [*range(30), 40, 41, 42, 43]
    assert ids[1] == [*range(30), 42, 43]
    assert ids[2] == ids[3] == [*range(30), 43]
    masked = {r.doc_id: r for r in docs.collect()}[43]
    assert masked.text.endswith(" mail [EMAIL] now") and masked.n_chars == len(masked.text)


def test_whole(spark, sf_dir):
    import public_tokenizers

    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in got}) == [*range(30), 43]
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts[43] = texts[43].replace("a.b@c.de", "[EMAIL]")
    for r in got:
        assert np.array(r.ids, "<u4").tobytes() == (pack.ids_of(texts[r.doc_id], path) + pack.END.to_bytes(4, "little"))[4 * r.start : 4 * (r.start + r.length)]
