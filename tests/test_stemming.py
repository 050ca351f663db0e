"""Stems as column expressions against the plain function, on words built from all suffixes."""
import random

from pyspark.sql import functions as F

from varilens.functions import porter
from varilens.functions import stemming as S


def some_words(seed, n):
    rnd = random.Random(seed)
    ends = [s for s, _ in porter._STEP2 + porter._STEP3] + porter._STEP4
    ends += ["s", "es", "ies", "sses", "ed", "ing", "eed", "ied", "y", "e", "ll", "ly", "yy", "yyy", "yes", ""]
    words = set(porter._IRREGULAR) | {"a", "by", "yyyyyy", "ayyyed", "y"}
    for _ in range(n):
        words.add("".join(rnd.choices("aeiouybcdlstwxz", k=rnd.randint(0, 6))) + rnd.choice(ends) + rnd.choice(["", "s", "ed", "li", "ness"]))
        words.add("".join(rnd.choices("aeiouyybcdglnst1", k=rnd.randint(1, 9))))
    return sorted(words - {""})


def test_stems_equal_the_plain_function(spark):
    words = some_words(1, 30_000)
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").repartition(8)
    got = {r.w: r.s for r in df.select("w", S.stem(F.col("w")).alias("s")).collect()}
    assert got.pop(None) is None
    assert {w: s for w, s in got.items() if s != porter.stem(w)} == {}


def test_patterns_of_letters(spark):
    words = ["toy", "syzygy", "yyyy", "byyyy", "ayya", "crying", "y", "b2y"]
    want = ["cvc", "cvcvcv", "cvcv", "cvcvc", "vcvv", "ccvvcc", "c", "ccv"]
    df = spark.createDataFrame(list(zip(range(8), words)), "k int, w string").select("k", S.kinds(F.col("w")).alias("p"))
    assert [r.p for r in df.orderBy("k").collect()] == want


def test_stems_need_no_python_worker(spark):
    from varilens.operators import overlap as B
    df = spark.createDataFrame([("Running quickly", 1)], "t string, k int").select(B.stem_tokens(B.rouge_tokens("t")).alias("s"))
    assert "Python" not in df._jdf.queryExecution().toString() and df.first().s == ["run", "quickli"]
