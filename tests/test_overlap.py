"""BLEU / ROUGE-L: hand cases and brute force over explicit pairs."""
import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varilens.functions.lcs import lcs_length, lcs_length_dp
from varilens.functions.porter import stem
from varilens.operators import overlap as B
from tests.conftest import SF_SMALL


def py_bleu(ref: str, cand: str) -> float:
    r, c = ref.split(), cand.split()
    if not c:
        return 0.0
    ps = []
    for n in range(1, 5):
        rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        cc = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
        m = sum(min(v, rc[g]) for g, v in cc.items())
        t = max(1, len(c) - n + 1)
        ps.append(m / t if m > 0 else 0.1 / t)
        if n == 1 and m == 0:
            return 0.0
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    return bp * math.exp(sum(math.log(p) for p in ps) / 4)


def _resp(spark, rows):
    return spark.createDataFrame(rows, "case_id string, variant_idx int, response string")


def test_bleu_hand_cases(spark):
    df = _resp(spark, [("same", 0, "a b c d e"), ("same", 1, "a b c d e"),
                       ("disj", 0, "a b c"), ("disj", 1, "x y z"),
                       ("one", 0, "only one"),
                       ("nul", 0, None), ("nul", 1, "x")])
    got = {r.case_id: r.bleu for r in B.bleu_across_variants(df, response_col="response").collect()}
    assert got["same"] == pytest.approx(1.0)
    assert got["disj"] == 0.0
    assert got["one"] is None and got["nul"] is None


def test_bleu_empty_candidate_is_zero(spark):
    df = spark.createDataFrame([(1, "a b c", "")], "k int, r string, c string")
    assert B.pair_bleu(df, reference_col="r", candidate_col="c", key_cols=["k"]).first().bleu == 0.0


def test_bleu_matches_brute_force(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'assistant'")
    rows = conv.select("conv_id", "turn", "text").collect()
    df = spark.createDataFrame([(f"c{r.conv_id}", int(r.turn), r.text) for r in rows],
                               "case_id string, variant_idx int, response string")
    got = {r.case_id: r.bleu for r in B.bleu_across_variants(df, response_col="response").collect()}
    by = {}
    for r in rows:
        by.setdefault(f"c{r.conv_id}", []).append((int(r.turn), r.text))
    for cid, items in by.items():
        texts = [t for _, t in sorted(items) if t is not None]
        pairs = list(combinations(texts, 2))
        exp = None if not pairs else sum(py_bleu(a, b) for a, b in pairs) / len(pairs)
        if exp is None:
            assert got[cid] is None
        else:
            assert got[cid] == pytest.approx(exp, abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_bitparallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_length_dp(a, b)


def test_porter_examples():
    for w, s in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop",
                 "motoring": "motor", "generalization": "gener", "happy": "happi", "running": "run",
                 "dies": "die", "agreed": "agre"}.items():
        assert stem(w) == s, w


def test_rouge_hand_cases(spark):
    df = _resp(spark, [("same", 0, "The cats are running"), ("same", 1, "the cat is running!"),
                       ("disj", 0, "alpha"), ("disj", 1, "beta"), ("one", 0, "x")])
    got = {r.case_id: r.rouge_l for r in B.rouge_l_across_variants(df, response_col="response").collect()}
    # tokens: [the, cat, are, run] vs [the, cat, is, run] -> lcs 3 of 4
    assert got["same"] == pytest.approx(0.75)
    assert got["disj"] == 0.0 and got["one"] is None


def py_rouge(ref: str, cand: str) -> float:
    import re
    tok = lambda s: [stem(t) if len(t) > 3 else t for t in re.sub("[^a-z0-9]+", " ", s.lower()).split()]
    a, b = tok(ref), tok(cand)
    if not a or not b:
        return 0.0
    l = lcs_length_dp(a, b)
    if l == 0:
        return 0.0
    p, r = l / len(b), l / len(a)
    return 2 * p * r / (p + r)


def test_rouge_with_copies_matches_brute_force(spark):
    """Copies of a text are scored once and weighted; result equals the plain mean over all pairs."""
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'assistant'")
    rows = [(f"c{r.conv_id}", int(r.turn), r.text) for r in conv.select("conv_id", "turn", "text").collect()]
    # Replicate the first response of every third case several times, add punctuation-only and NULL texts.
    extra = []
    for i, (cid, turn, text) in enumerate(rows):
        if i % 3 == 0:
            extra += [(cid, 100 + k, text) for k in range(4)]
    extra += [("punct", 0, "!!"), ("punct", 1, "!!"), ("punct", 2, "cats"), ("nul", 0, None), ("nul", 1, None)]
    data = rows + extra
    df = spark.createDataFrame(data, "case_id string, variant_idx int, response string")
    got = {r.case_id: r.rouge_l for r in B.rouge_l_across_variants(df, response_col="response").collect()}
    by = {}
    for cid, turn, text in data:
        by.setdefault(cid, []).append((turn, text))
    for cid, items in by.items():
        texts = [t for _, t in sorted(items) if t is not None]
        pairs = list(combinations(texts, 2))
        exp = None if not pairs else sum(py_rouge(a, b) for a, b in pairs) / len(pairs)
        if exp is None:
            assert got[cid] is None, cid
        else:
            assert got[cid] == pytest.approx(exp, abs=1e-12), cid


def test_bleu_with_copies_and_mixed_lengths_matches_brute_force(spark):
    """Copies, texts of different lengths and interleaved indexes: the earlier response is the reference."""
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").where("role = 'assistant'")
    rows = [(f"c{r.conv_id}", int(r.turn), r.text) for r in conv.select("conv_id", "turn", "text").collect()]
    extra = []
    for i, (cid, turn, text) in enumerate(rows):
        if i % 3 == 0:  # copies of this text, interleaved with the other responses by index
            extra += [(cid, turn + 50 * (k + 1), text) for k in range(3)]
    # Hand cases: short/long texts, copies on both sides, interleaved order, NULLs, empty texts.
    hand = [("h1", 0, "a b c"), ("h1", 1, "a b c d e f"), ("h1", 2, "a b c"), ("h1", 3, "a b c d e f"),
            ("h1", 4, "a b c"), ("h1", 5, "x"), ("h1", 6, None), ("h1", 7, "a b c d e f"),
            ("h2", 3, "p q"), ("h2", 1, "p q r s t"), ("h2", 0, "p q"), ("h2", 2, "p q"),
            ("h3", 0, "same text here ok"), ("h3", 1, "same text here ok"), ("h3", 2, "same text here ok"),
            ("h4", 0, ""), ("h4", 1, ""), ("h4", 2, "a"), ("h5", 0, None), ("h5", 1, None)]
    data = rows + extra + hand
    df = spark.createDataFrame(data, "case_id string, variant_idx int, response string")
    got = {r.case_id: r.bleu for r in B.bleu_across_variants(df, response_col="response").collect()}
    by = {}
    for cid, turn, text in data:
        by.setdefault(cid, []).append((turn, text))
    for cid, items in by.items():
        texts = [t for _, t in sorted(items) if t is not None]
        pairs = list(combinations(texts, 2))
        exp = None if not pairs else sum(py_bleu(a, b) for a, b in pairs) / len(pairs)
        if exp is None:
            assert got[cid] is None, cid
        else:
            assert got[cid] == pytest.approx(exp, abs=1e-12), cid


def test_explicit_pairs_with_null_and_repeated_keys(spark):
    rows = [(None, "a b c d e", "a b c d e"), (1, "a b a b c", "a b x"), (1, "q r s", "x y z"), (2, None, "a"), (3, "", "")]
    df = spark.createDataFrame(rows, "k long, r string, c string")
    got = sorted(((r.k is None, r.k or 0, round(r.bleu, 9)) for r in B.pair_bleu(df, reference_col="r", candidate_col="c", key_cols=["k"]).collect()))
    assert got == sorted((k is None, k or 0, round(py_bleu(r or "", c or ""), 9)) for k, r, c in rows)


def test_compared_prompts_leave_out_null_cases(spark):
    from varilens.operators.prompts import compare_prompts
    rows = [(c, i, "A", "White", 1, 0, 0, "A", t) for c, i, t in
            [("x", 0, "a b c d"), ("x", 1, "a b c d"), (None, 0, "a b"), (None, 1, "q r s t")]]
    df = spark.createDataFrame(rows, "case_id string, variant_idx int, answer_idx string, ethnicity string, gender_male int, "
                                     "gender_female int, gender_none int, ans string, ex string")
    r = compare_prompts(df, answer_cols={"p|1": "ans"}, explanation_cols={"p|1": "ex"}).collect()
    assert [(x.prompt_id, x.mean_pairwise_bleu, x.n_cases) for x in r] == [("p|1", 1.0, 0)]


def test_stems_of_everyday_words():
    """Worked by hand from the published rules."""
    known = {"used": "use", "using": "use", "uses": "use", "aged": "age", "ages": "age", "biology": "biolog", "biological": "biolog",
             "inning": "inning", "innings": "inning", "outing": "outing", "sky": "sky", "skies": "sky", "additionally": "addit",
             "additional": "addit", "dying": "die", "caresses": "caress", "ponies": "poni", "hopping": "hop", "hoping": "hope",
             "relational": "relat", "feed": "feed", "agreed": "agre", "controlling": "control", "probate": "probat", "rate": "rate"}
    assert {w: stem(w) for w in known} == known


def _mean_bleu(rows):
    by = {}
    for c, i, t in rows:
        if t is not None:
            by.setdefault(c, []).append((i, t))
    out = {}
    for c, own in by.items():
        own.sort()
        scores = [py_bleu(a[1], b[1]) for a, b in combinations(own, 2)]
        out[c] = sum(scores) / len(scores) if scores else None
    return out


def test_bleu_of_copies_matches_brute_force(spark):
    import random
    rnd = random.Random(4)
    texts = ["a b c d e", "a b c d", "a b c d e f", "e d c b a", "a", "", "x y", "a b x y c d", "z"]
    rows = []
    for case in range(25):
        own = rnd.sample(texts, rnd.randint(1, 6))
        idx = rnd.sample(range(20_000), rnd.randint(1, 40))
        rows += [(f"c{case}", i, None if rnd.random() < .05 else rnd.choice(own)) for i in idx]
    rows.append(("nulls", 1, None))
    want = _mean_bleu(rows)
    got = {r.case_id: r.bleu for r in B.bleu_across_variants(_resp(spark, rows), response_col="response").collect()}
    assert set(got) == {r[0] for r in rows}
    assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items() if v is not None}


def test_order_counts_over_blocks(spark):
    import random
    rnd = random.Random(9)
    rows = [("c", i, rnd.choice(["a b", "a b c", "d"])) for i in rnd.sample(range(3000), 400)]
    first = {}
    for _, i, t in sorted(rows):
        first.setdefault(t, i)
    want = {(first[a], first[b]): sum(i < j for _, i, x in rows if x == a for _, j, y in rows if y == b)
            for a in first for b in first if len(a.split()) != len(b.split())}
    for block in (1, 64, 10_000):
        got = B.copy_orders(_resp(spark, rows), response_col="response", block=block).collect()
        assert {(r.a, r.b): r.before for r in got} == want


def test_many_copies_make_few_rows(spark):
    """10,000 copies of two texts in turn: 10^8 response pairs, a few gram rows."""
    from pyspark.sql import functions as F
    n = 20_000
    df = spark.range(n, numPartitions=8).select(F.lit("c").alias("case_id"), F.col("id").cast("int").alias("variant_idx"),
                                                F.when(F.col("id") % 2 == 0, "the answer is a").otherwise("the answer is b or c").alias("response"))
    got = B.bleu_across_variants(df, response_col="response").first().bleu
    a, b = "the answer is a", "the answer is b or c"
    h = n // 2
    first = h * (h + 1) / 2  # an even index comes before an odd one
    total = h * (h - 1) / 2 * (py_bleu(a, a) + py_bleu(b, b)) + first * py_bleu(a, b) + (h * h - first) * py_bleu(b, a)
    assert got == pytest.approx(total / (n * (n - 1) / 2), abs=1e-12)


def test_load_queries_equal_all_pairs(spark):
    """Twelve whole documents a case, against explicit pairs of all of them."""
    from varilens.plans import catalog
    from varilens.plans import fixtures as FX
    rows = FX.load_responses(spark, SF_SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r.case_id, []).append((r.variant_idx, r.response))
    words = lambda t: [stem(w) if len(w) > 3 else w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " "
                                                                    for c in t.lower()).split()]
    rouge = {r.case_id: r.rouge_l for r in catalog.QUERIES["rouge_l_load"](spark, SF_SMALL).collect()}
    assert set(rouge) == set(by) and max(map(len, by.values())) == 12
    for case, own in by.items():
        tokens = [words(t) for _, t in own if t is not None]
        scores = []
        for a, b in combinations(tokens, 2):
            n = lcs_length(a, b)
            scores.append(2 * n / (len(a) + len(b)) if n else 0.0)
        assert rouge[case] == (pytest.approx(sum(scores) / len(scores), abs=1e-8) if scores else None)


def test_bleu_over_many_blocks_and_index_chunks(spark, monkeypatch):
    """Blocks of two texts and chunks of eight indexes: every two texts still meet once, and no row per shared gram is shuffled."""
    import random
    rnd = random.Random(11)
    monkeypatch.setattr(B, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(B, "INDEX_CHUNK", 8)
    texts = ["a b c d e", "a b c d", "a b c d e f", "e d c b a", "a", "", "x y", "a b x y c d", "z", "d e a b c d e"]
    rows = [(f"c{c}", i, rnd.choice(texts)) for c in range(6) for i in rnd.sample(range(60), 25)] + [("lone", 3, "q"), ("apart", 1, "q"), ("apart", 2, "r")]
    df = B.bleu_across_variants(_resp(spark, rows), response_col="response")
    got = {r.case_id: r.bleu for r in df.collect()}
    want = _mean_bleu(rows)
    assert got == {k: None if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_stems_of_token_lists_equal_the_columns(spark):
    from pyspark.sql import functions as F
    rows = [(1, ["running", "the", "cats", "running"]), (2, []), (3, None), (4, ["relational", "ab", "happy"])]
    df = spark.createDataFrame(rows, "k int, t array<string>").coalesce(1)
    got = {r.k: (r.a, r.b) for r in df.select("k", B.stems_udf("t").alias("a"), B.stem_tokens(F.col("t")).alias("b")).collect()}
    assert got[1][0] == ["run", "the", "cat", "run"] and all(a == b for a, b in got.values())
