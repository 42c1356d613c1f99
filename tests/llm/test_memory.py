"""What Python workers hold while a task runs and after it."""

import public_tokenizers
import pyarrow as pa

from inkgauge.llm import common, packing, tokens


def test_workers_give_back_what_an_operator_no_longer_needs(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(20)], "doc_id long, text string").coalesce(1)

    def known(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([len(common._kept)] * batch.num_rows, pa.int32())})

    own = "; ".join(str(r) for r in packing.pieces(docs, path=path).collect())
    assert own == "; ".join(str(r) for r in packing.pieces(docs, path=path).collect())
    assert {r["n"] for r in docs.mapInArrow(common.lean(known), "n int").collect()} == {0}
    model = tokens.word_bpe(path)
    assert tokens.word_bpe(path) is model
    list(common.lean(iter, keep=True)([]))
    assert tokens.word_bpe(path) is model
    list(common.lean(iter)([]))
    assert tokens.word_bpe(path) is not model


def test_tokenising_holds_few_texts_at_once():
    texts = pa.array([" ".join(f"w{i * 400 + j:07d}" for j in range(400)) for i in range(2000)])
    usual = pa.default_memory_pool()
    watched = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(watched)
    try:
        rows = sum(1 for _ in packing.tokenised(pa.record_batch({"text": texts}), "text", public_tokenizers.path("word_bpe_49k.json"), 2))
    finally:
        pa.set_memory_pool(usual)
    assert rows == len(texts)
    assert watched.max_memory() < 16 << 20
