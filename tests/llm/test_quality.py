"""Quality classifier: held-out accuracy, the pieces, and odd inputs."""
import numpy as np
import pyarrow as pa
import pytest

from varilens.llm import quality as C


def test_accuracy_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = C.scored(docs, C.fit(docs, labels)).join(labels, "doc_id").where(C.held_out("doc_id")).collect()
    right = np.mean([(r.score >= C.THRESHOLD) == (r.quality == 1) for r in rows])
    assert len(rows) > 50 and right >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_pooling_does_not_depend_on_neighbours_in_the_batch():
    vectors = C.word_vectors(np.zeros((C.SLOTS, C.DIM), np.float32), C.index_vectors())
    texts = ["a b a b", "", "Ünï 12 ab!!", "w " * 70_000, "b a"]
    whole = C.pooled(pa.array(texts), vectors)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], C.pooled(pa.array([t]), vectors)[0], atol=1e-4)
    assert not whole[1].any()


def test_context_sums_equal_a_plain_loop():
    index = C.index_vectors()
    slot, doc = C.tokens(pa.array(["a b c a", "c", "a b"]))
    exp = np.zeros((C.SLOTS, C.DIM))
    for i in range(len(slot)):
        for j in range(len(slot)):
            if 0 < abs(i - j) <= C.NEAR and doc[i] == doc[j]:
                exp[slot[i]] += index[slot[j]]
    assert np.allclose(C.context_sums(slot, doc, index), exp)


def test_odd_rows_and_labels(spark):
    rows = [(k, ("good words here " if k % 2 else "BAD!! ") * (k % 7 + 1), "en", 1.5) for k in range(120)]
    rows += [(None, "x", None, None), (500, None, None, None), (501, "", None, None), (3, rows[3][1], "en", 1.0), (502, "y " * 200_000, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(k, k % 2, "clash") for k in range(100)] + [(None, 1, ""), (5, None, ""), (7, 0, ""), (900, 1, "")],
                                   "doc_id long, quality int, text string")
    model = C.fit(docs, labels)
    found = C.scored(docs, model, score_col="p").collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "label", "score", "p"}
    assert np.mean([(r.p >= C.THRESHOLD) == bool(r.doc_id % 2) for r in found if r.doc_id is not None and r.doc_id < 120]) > 0.95
    kept = C.accepted(docs, model)
    assert kept.dtypes == docs.dtypes and kept.count() == sum(r.p >= C.THRESHOLD for r in found)
    with pytest.raises(ValueError):
        C.scored(docs, model)
    assert C.scored(docs.limit(0), model, score_col="p").count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {r.p for r in C.scored(docs, C.fit(docs, few), score_col="p").collect()} == {0.5}
    assert C.fit(docs.limit(0), labels)[1].flat


def test_learns_from_no_held_out_label_and_at_most_max_rows(spark):
    docs = spark.createDataFrame([(k, f"w{k % 2} " * 5) for k in range(60)], "doc_id long, text string")
    fold = {r.doc_id for r in docs.where(C.held_out("doc_id")).collect()}
    labels = spark.createDataFrame([(k, k % 2) for k in fold], "doc_id long, quality int")
    assert C.fit(docs, labels)[1].flat
    more = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    assert C.fit(docs, more, max_rows=9)[1].flat  # nine rows are too few to fit


def test_word_statistics_cover_all_documents_whatever_their_split(spark):
    texts = [f"w{k % 37} v{k % 11} u{k % 5} w{k % 13}" for k in range(900)] + [None, "", "x " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    index = C.index_vectors()
    want = sum(C.context_sums(*C.tokens(pa.array([t])), index).astype(np.int64) for t in texts if t)
    for parts in (1, 7):
        got = C.corpus_contexts(df.repartition(parts))
        assert got.dtype == np.int64 and (got == want).all()
    assert not C.corpus_contexts(df.limit(0)).any()
