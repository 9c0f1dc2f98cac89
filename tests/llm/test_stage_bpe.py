"""The last stage of the pipeline decodes what it encodes."""

import hashlib

from geotrail.llm.queries import stage_bpe


def test_stage_decodes(spark):
    texts = ["", "it's  two\n\n spaces", "é" * 900, "日本語 🙂 text " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in stage_bpe(spark, docs, "").collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}
