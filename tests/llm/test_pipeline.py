"""The pipeline's stages on planted rows, and the registered queries."""
import hashlib
import random

import corpus_pipeline as P
import public_tokenizers
import pyarrow as pa
import tokenizers

from varilens.llm import decontaminate as D
from varilens.llm import pii, quality
from varilens.llm import queries as Q

from .test_near_dup import classes


def test_stages_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = P.run(spark, sf).collect()
    ids = {r.doc_id for r in docs.collect()}
    assert 0 < len(out) < len(ids) and {r.doc_id for r in out} <= ids
    assert all(r.n_tokens > 0 for r in out)


def plainly(docs, model, items):
    """The pipeline one document after the other: the model's score of a document alone, all pairs of documents, edit
    distances of whole documents to every item, the masking function, the tokenizers library."""
    vectors, network = model
    docs = [r for r in docs if network.score(quality.pooled(pa.array([r.text or ""]), vectors))[0] >= quality.THRESHOLD]
    least = classes([(r.doc_id, r.text) for r in docs])
    docs = [r for r, (i, c) in zip(docs, least, strict=True) if i == c]
    items = [D.normalised(t) for t in items]

    def holds(text, item):
        k = min(int(D.RATE * len(item)), len(item) - 1)
        if k == 0:
            return f" {item} " in f" {text} "
        masks = {}
        for n, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << n
        return min(D.myers(masks, len(item), text), default=k + 1) <= k

    docs = [r for r in docs if not any(item and holds(D.normalised(r.text), item) for item in items)]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for r in docs:
        ids = library.encode(pii.mask(r.text or ""), add_special_tokens=False).ids
        out.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_run_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    model = quality.fit(read("documents"), read("labels"))
    want = plainly(read("documents").collect(), model, [r.text for r in read("benchmark").collect()])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, sf).collect())
    assert got == want and 20 < len(got) < read("documents").count()


def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    sf = "/root/testdata/sf0.01"
    rnd = random.Random(1)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r for r in source.limit(300).collect() if len(r.text) > 800][:20]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(clean)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1] + " one more word", "en", "s", 1), (102, f"{rows[2][1][:700]} {item} {rows[3][1][:700]}", "en", "s", 1),
             (103, " ".join(rnd.choices(rows[4][1].split(), k=150)) + " mail a.b@c.example.org", "en", "s", 1), (104, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, source.schema)
    names = [name for name, _ in P.STAGES]
    stage = dict(P.STAGES)
    for name in names[:-1]:
        assert stage[name](spark, docs, sf).dtypes == docs.dtypes
        assert stage[name](spark, docs.limit(0), sf).count() == 0
    left = {r.doc_id for r in stage[names[1]](spark, docs, sf).collect()}
    assert {100, 101} & left == set() and {0, 1, 2, 102, 103, 104} <= left
    left = {r.doc_id for r in stage[names[2]](spark, docs, sf).collect()}
    assert 102 not in left and {100, 101, 103, 104} <= left
    masked = {r.doc_id: r for r in stage[names[3]](spark, docs, sf).collect()}
    assert masked[103].text.endswith(" mail [EMAIL]") and masked[103].n_chars == len(masked[103].text) and masked[104].text is None
    assert stage[names[4]](spark, docs, sf).count() == len(rows)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE) <= set(Q.QUERIES)
