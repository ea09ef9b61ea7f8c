"""Each stage against brute force on what the stage before it left."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tripleflow.llm import toxicity
from tripleflow.llm.common import written


def _texts(frame):
    return sorted((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect())


def test_stages(spark, docs, small, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name in list(stages)[:-1]:
        after = written(stages[name](spark, state, str(tmp_path)), "test-stage")
        assert after.columns == state.columns
        left[name] = _texts(after)
        state = after
        if name == "toxicity":
            scored = toxicity.toxic_documents(docs, labels)
            assert {i for i, _ in left[name]} == {r.doc_id for r in scored.where("predicted = 0").collect()}

    gone = brute.repeated_lines(left["toxicity"])
    want = [
        (i, "\n".join(s for k, s in enumerate(text.split("\n")) if k not in set(gone[i]))) for i, text in left["toxicity"]
    ]
    assert left["line_dedup"] == want

    roots = brute.components({i: brute.fingerprint(text) for i, text in want})
    want = [(i, text) for i, text in want if roots[i] == i]
    assert left["simhash_dedup"] == want

    cut = brute.removed_bytes(want)
    want = [(i, np.frombuffer(t.encode(), np.uint8)[~cut[i]].tobytes().decode(errors="ignore")) for i, t in want]
    assert left["suffix_dedup"] == want

    held = collections.Counter()
    pieces = stages["packing"](spark, state, str(tmp_path)).collect()
    for p in pieces:
        held[p.doc_id] += p.length
    assert all(held[p.doc_id] == p.doc_tokens for p in pieces) and set(held) == {i for i, _ in want}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(held.values())


def test_stages_take_repeated_rows_rows_without_id_and_no_rows(spark, repeats, none, tmp_path):
    spark.createDataFrame([(-5, 1), (-2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (repeats, none):
        state = table
        for _, stage in corpus_pipeline.STAGES:
            state = written(stage(spark, state, str(tmp_path)), "test-stage")
        assert (state.count() > 0) == (table.count() > 0)
