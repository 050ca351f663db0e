"""Streams of files against the batch operators: several batches, a restart, a replayed batch."""
import pytest
from pyspark.sql import functions as F

from varilens.operators import answers as A
from varilens.operators import quality as Q
from varilens.plans import fixtures as FX
from varilens.streaming import stream as ST
from tests.conftest import SF_SMALL


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def deal(df, folder, parts, first=0):
    """Write ``df`` in ``parts`` steps, one file each, so that they arrive one after the other."""
    for k in range(parts):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(folder)


def test_cube_in_update_mode_equals_the_batch_cube(spark, scratch):
    df = FX.predictions(spark, SF_SMALL).select("answer_idx", "ethnicity", "gender_male", "gender_female", "gender_none", "specialty",
                                                "llm_m1_answer", "llm_m2_answer").coalesce(2)
    src, out, ck = f"{scratch}/in", f"{scratch}/cube", f"{scratch}/ck"
    cols = ["llm_m1_answer", "llm_m2_answer"]
    start = lambda: ST.stream_answer_cube(spark, src, out, schema=df.schema, llm_col=cols, extra_keys=["specialty"],
                                          checkpoint=ck, files_per_batch=1)
    early = df.where("ethnicity < 'C'")
    deal(early, src, 3)
    q = start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 3 and q.recentProgress[-1].stateOperators[0].numRowsTotal > 0
    want = A.answer_cube(early, cols, ["specialty"])
    assert rows_of(ST.read_cube(spark, out, ["specialty"])) == rows_of(want)
    # A restart goes on from the state store: new files change old cells and add new ones.
    deal(df.where("ethnicity >= 'C'"), src, 2)
    deal(early.limit(40), src, 1)
    q = start()
    q.awaitTermination()
    whole = df.unionAll(early.limit(40))
    cube, batch = ST.read_cube(spark, out, ["specialty"]), A.answer_cube(spark.read.schema(df.schema).parquet(src), cols, ["specialty"])
    assert rows_of(cube) == rows_of(batch) and batch.agg(F.sum("n")).first()[0] == 2 * whole.count()
    assert rows_of(A.accuracy(cube)) == rows_of(A.accuracy(batch))
    assert rows_of(A.accuracy_by_group(cube)) == rows_of(A.accuracy_by_group(batch))
    start().awaitTermination()  # nothing new
    assert rows_of(ST.read_cube(spark, out, ["specialty"])) == rows_of(batch)


def test_bad_rows_go_to_quarantine_and_a_replay_changes_nothing(spark, scratch):
    df = FX.dirty_variants(spark, SF_SMALL)
    src, good, bad = f"{scratch}/in", f"{scratch}/good", f"{scratch}/bad"
    deal(df, src, 3)
    start = lambda ck: ST.stream_validated(spark, src, good, bad, schema=df.schema, checkpoint=f"{scratch}/{ck}", files_per_batch=1)
    start("a").awaitTermination()
    valid, kept = spark.read.parquet(good), spark.read.parquet(bad)
    assert valid.count() + kept.count() == df.count() and kept.count() > 0
    assert rows_of(ST.quarantine_report(spark, bad)) == rows_of(Q.schema_violations(df))
    assert Q.schema_violations(valid.drop("batch")).count() == 0
    content = lambda: [rows_of(spark.read.parquet(p).drop("batch").withColumn("case_text", F.md5("case_text"))) for p in (good, bad)]
    before = content()
    assert {r[0] for r in valid.select("batch").distinct().collect()} <= {0, 1, 2}
    # A lost checkpoint makes the stream run all batches again, into the same folders.
    start("b").awaitTermination()
    assert content() == before


def test_one_batch_written_twice_is_one_batch(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    for _ in range(2):
        ST._replace_batch(df, f"{scratch}/out", 7)
    ST._replace_batch(df.where("k = 1"), f"{scratch}/out", 8)
    got = spark.read.parquet(f"{scratch}/out")
    assert sorted((r.k, r.batch) for r in got.collect()) == [(1, 7), (1, 8), (2, 7)]


def test_a_model_is_loaded_once_per_worker_and_sees_each_text_once(spark, scratch):
    import os

    from varilens.operators import embedding as E
    texts = [f"text {i % 40}" for i in range(400)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").repartition(8)
    os.makedirs(f"{scratch}/loads")
    os.makedirs(f"{scratch}/calls")

    def load():
        import os
        import uuid
        open(f"{scratch}/loads/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(batch):
            assert len(batch) <= 7
            with open(f"{scratch}/calls/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(batch) + "\n")
            return [[float(len(t)), 1.0] for t in batch]
        return encode

    out = E.embed_distinct(df, "t", E.model_embedder(load, batch_size=7))
    got = {r.k: r.embedding for r in out.collect()}
    assert got == {i: None if t is None else [float(len(t)), 1.0] for i, t in enumerate(texts)}
    pids = [n.split("-")[0] for n in os.listdir(f"{scratch}/loads")]
    assert len(pids) == len(set(pids))
    seen = [line for n in os.listdir(f"{scratch}/calls") for line in open(f"{scratch}/calls/{n}").read().split("\n")[:-1]]
    assert sorted(seen) == sorted({t for t in texts if t is not None})


def test_few_shot_examples_of_odd_rows(spark):
    from varilens.operators import prompts as P
    rows = [(f"c{i}", "big", f"q{i}") for i in range(60)] + [("s1", "small", "x"), ("s2", "small", "y"), ("o", "only", "z"), ("n", None, "w"),
                                                             ("c1", "big", "q0")]
    df = spark.createDataFrame(rows, "case_id string, specialty string, question string")
    df = df.selectExpr("*", "'A' as answer_idx", "'oa' as option_a", "'ob' as option_b", "'oc' as option_c", "cast(null as string) as option_d")
    got = [(r.case_id, r.few_shot_ids, r.few_shot) for r in P.few_shot_examples(df, df, 3).collect()]
    assert len(got) == len(rows)
    for ident, ids, text in got:
        assert ident not in ids and len(set(ids)) == len(ids) and text.count("Answer: A") == len(ids)
        assert len(ids) == {"s1": 1, "s2": 1, "o": 0, "n": 0}.get(ident, 3)
        if ident not in ("s1", "s2", "o", "n"):
            assert all(i.startswith("c") for i in ids)
    by = {i: (a, t) for i, a, t in got}
    assert by["s1"][0] == ["s2"] and by["n"] == ([], "") and len({tuple(a) for a, _ in by.values()}) > 5
    assert P.few_shot_examples(df.limit(0), df).count() == 0 and P.few_shot_examples(df, df.limit(0)).select("few_shot").distinct().count() == 1


def test_messages_keep_slots_of_cases_as_they_are(spark):
    from varilens.operators import prompts as P
    df = spark.createDataFrame([("c", "a {QUESTION} case", "what?", "oa", "ob", "oc", None, "A", "S")],
                               "case_id string, case_text string, question string, option_a string, option_b string, option_c string, "
                               "option_d string, answer_idx string, specialty string")
    got = {r.prompt_id: r for r in P.prompt_messages(df, {"SPECIFIC": F.lit("gender"), "few-shot examples": F.lit("shots")}).collect()}
    assert set(got) == set(P.TEMPLATES) == set(P.SYSTEM_TEMPLATES)
    assert "shots" in got["p0"].system and "gender" in got["p3"].system and "a {QUESTION} case" in got["p1"].prompt
    asked = {r.attribute: r.prompt for r in P.relevance_prompts(df).collect()}
    assert set(asked) == set(P.ATTRIBUTES) and all(f"patient's {a} to" in t for a, t in asked.items())


@pytest.mark.parametrize("k", [1, 2])
def test_few_shot_equals_ranking_all(spark, k):
    import hashlib

    from varilens.operators import prompts as P
    rows = [(f"id{i}", f"g{i % 3}", f"q{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "case_id string, specialty string, question string")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r.case_id: r.few_shot_ids for r in P.few_shot_examples(df, df, k, example=F.col("question")).collect()}
    for ident, group, _ in rows:
        order = sorted((md5(i)[0] != md5(ident)[0], md5(i), i) for i, g, _ in rows if g == group and i != ident)
        assert got[ident] == [i for *_, i in order[:k]]
