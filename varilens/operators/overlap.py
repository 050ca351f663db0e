"""Pairwise BLEU and ROUGE-L consistency of responses across variants.

Both metrics are means over the C(k, 2) ordered pairs (earlier variant =
reference) of a case's k non-null responses.  Neither is decomposable:

* Both: each distinct text of a case is one row with its copies.  Texts are
  dealt into blocks of bounded size and every two blocks of a case meet in
  one group of rows (``block_pairs``), so a shuffle carries texts, never a row
  per pair and shared gram, and no task holds more than two blocks at a time.
* BLEU: the clipped matches of all pairs of a group come from one pass over its
  n-grams (numpy in ``functions.pairs``); a group sends one summed score.
  BLEU is asymmetric, so the copies of a text carry their indexes.
* ROUGE-L: texts are tokenised and stemmed once, before they are dealt; the LCS
  of the pairs of a group is bit-parallel over token numbers.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X
from ..functions.stemming import stem


# ------------------------------------------------------------------ BLEU ----

def _ngrams(tokens, n: int):
    """array of the n-grams of ``tokens`` joined by a space (empty when too short)."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n),
                                         lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def gram_counts(resp: DataFrame, keys) -> DataFrame:
    """(keys..., n, gram) -> c for n = 1..4, from a ``tokens`` column."""
    tok = F.col("tokens")
    per_n = F.array(*[F.struct(F.lit(n).alias("n"), _ngrams(tok, n).alias("grams"))
                      for n in range(1, S.BLEU_MAX_N + 1)])
    return (resp.select(*keys, F.inline(per_n))
            .select(*keys, "n", F.explode("grams").alias("gram"))
            .groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("c")))


def _bleu_expr(ref_len, cand_len, m):
    """Sentence BLEU from lengths and clipped matches m[1..4] (smoothing method 1)."""
    logs = []
    for n in range(1, S.BLEU_MAX_N + 1):
        t = F.greatest(F.lit(1), cand_len - n + 1).cast("double")
        mn = F.coalesce(m[n], F.lit(0)).cast("double")
        p = F.when(mn > 0, mn / t).otherwise(F.lit(S.BLEU_EPSILON) / t)
        logs.append(F.log(p))
    bp = F.when(cand_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len.cast("double") / cand_len))
    score = bp * F.exp(sum(logs) / S.BLEU_MAX_N)
    return F.when(F.coalesce(m[1], F.lit(0)) == 0, F.lit(0.0)).otherwise(score)


def _prepare(df: DataFrame, case_col: str, idx_col: str, text_col: str) -> DataFrame:
    """(case_id, idx, tokens, len) per response row; NULL text keeps its row with NULL tokens."""
    return (df.where(F.col(case_col).isNotNull())
            .select(F.col(case_col).alias("case_id"), F.col(idx_col).alias("idx"),
                    X.whitespace_tokens(text_col).alias("tokens"))
            .withColumn("len", F.size("tokens")))


def _gram_table(df: DataFrame, case_col: str, idx_col: str, text_col: str) -> DataFrame:
    """(case_id, idx, len, n, gram) -> c for n = 1..4, plus one presence row per response (n = 0).

    The presence row has ``gram = ''`` for a non-null response and NULL for a
    null one, so the number of responses per case (and cases whose responses
    are all NULL) come from the same table as the grams, with no lookup join.
    Both sides of the pair join read one shuffle of it (exchange reuse in the
    executed plan); the per-case count filters on ``n``, which Catalyst
    pushes below the aggregate, so that branch builds its own small copy.
    """
    tok = F.col("tokens")
    empty = F.array().cast("array<string>")
    presence = F.struct(F.lit(0).alias("n"),
                        F.array(F.when(tok.isNotNull(), F.lit(""))).alias("grams"))
    per_n = F.array(presence, *[
        F.struct(F.lit(n).alias("n"), F.when(tok.isNull(), empty).otherwise(_ngrams(tok, n)).alias("grams"))
        for n in range(1, S.BLEU_MAX_N + 1)])
    return (_prepare(df, case_col, idx_col, text_col)
            .select("case_id", "idx", "len", F.inline(per_n))
            .select("case_id", "idx", "len", "n", F.explode("grams").alias("gram"))
            .groupBy("case_id", "idx", "len", "n", "gram").agg(F.count(F.lit(1)).alias("c")))


def _bleu_pairs(grams: DataFrame) -> DataFrame:
    """Per pair sharing a gram: BLEU(reference = lower idx, candidate = higher idx)."""
    g = grams.where(F.col("n") > 0)
    a = g.select("case_id", "n", "gram", F.col("idx").alias("i"), F.col("len").alias("ref_len"), F.col("c").alias("ci"))
    b = g.select("case_id", "gram", F.col("idx").alias("j"), F.col("len").alias("cand_len"), F.col("c").alias("cj"))
    # The exploded gram table is far larger than the scan it comes from, so a
    # size estimate taken from the files could wrongly pick a broadcast: force a
    # shuffled sort-merge join (AQE still splits skewed gram keys).  Lengths
    # ride along as grouping keys (they are functions of (case, idx)), so no
    # lookup join is needed after the aggregate.
    # Keys (gram, case_id): the sort prefix discriminates on the gram text
    # instead of on case ids that share long common prefixes, and n needs no
    # key of its own (tokens hold no space, so a gram's n is its space count + 1).
    shared = (a.hint("merge").join(b, ["gram", "case_id"]).where(F.col("i") < F.col("j"))
              .groupBy("case_id", "i", "j", "ref_len", "cand_len")
              .agg(*[F.sum(F.when(F.col("n") == n, F.least("ci", "cj"))).alias(f"m{n}")
                     for n in range(1, S.BLEU_MAX_N + 1)]))
    m = {n: F.col(f"m{n}") for n in range(1, S.BLEU_MAX_N + 1)}
    return shared.select("case_id", F.col("i").alias("ref_idx"), F.col("j").alias("cand_idx"),
                         _bleu_expr(F.col("ref_len"), F.col("cand_len"), m).alias("bleu"))


def bleu_pair_scores(df: DataFrame, *, response_col: str, case_col: str = "case_id",
                     idx_col: str = "variant_idx") -> DataFrame:
    """Per overlapping pair (case_id, ref_idx < cand_idx): BLEU(reference=earlier, candidate=later)."""
    return _bleu_pairs(_gram_table(df, case_col, idx_col, response_col))


def _mean_over_pairs(k: DataFrame, pair_sums: DataFrame, out: str) -> DataFrame:
    """Per case: summed pair scores / C(k, 2); NULL when k < 2; every case of ``k`` kept."""
    n_pairs = F.col("k") * (F.col("k") - 1) / 2
    return (k.join(pair_sums, "case_id", "left")
            .select("case_id", F.when(F.col("k") < 2, F.lit(None).cast("double"))
                    .otherwise(F.coalesce(F.col("_s"), F.lit(0.0)) / n_pairs).alias(out)))


ORDER_BLOCK = 4096      # indexes of a case that are put in order together


def copy_orders(df: DataFrame, *, response_col: str, case_col: str = "case_id", idx_col: str = "variant_idx",
                block: int = ORDER_BLOCK) -> DataFrame:
    """``case_id, a, b, before, ma, mb, la, lb``: for a text ``a`` with several copies and any text ``b`` of another
    length, the number of pairs of a copy of ``a`` and a later copy of ``b``, with their copies and lengths.

    Texts are named by their first index.  The copies of ``a`` are marks on
    the case's line of indexes; a response's number of marks to its left is
    the marks of earlier blocks of indexes plus those before it in its own
    block, both running sums.  So a case of k responses costs k rows for each
    copied text, never the square of the copies, and no task orders more than
    a block of indexes or one row per block and text.
    """
    rows = (df.where(F.col(case_col).isNotNull() & F.col(response_col).isNotNull())
            .select(F.col(case_col).alias("case_id"), F.col(idx_col).cast("long").alias("idx"),
                    F.unhex(F.md5(response_col)).alias("key"), F.size(X.whitespace_tokens(response_col)).alias("len")))
    copied = (rows.groupBy("case_id", "key", "len").agg(F.min("idx").alias("a"), F.count(F.lit(1)).alias("m"))
              .where("m > 1").select("case_id", F.col("key").alias("a_key"), F.col("len").alias("la"), "a", F.col("m").alias("ma")))
    met = rows.join(copied, "case_id").where((F.col("key") == F.col("a_key")) | (F.col("len") != F.col("la")))
    line = met.select("case_id", "a", "ma", "la", "len", "idx", F.floor(F.col("idx") / block).alias("block"),
                      F.when(F.col("key") != F.col("a_key"), F.col("key")).alias("b"))
    mark = F.col("b").isNull()
    left = Window.partitionBy("case_id", "a", "block").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    blocks = (line.withColumn("within", F.coalesce(F.sum(F.when(mark, 1)).over(left), F.lit(0)))
              .groupBy("case_id", "a", "ma", "la", "block", "b", F.col("len").alias("lb"))
              .agg(F.sum("within").alias("within"), F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")))
    earlier = Window.partitionBy("case_id", "a").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("marks", F.coalesce(F.sum(F.when(mark, F.col("n"))).over(earlier), F.lit(0)))
            .where(~mark).groupBy("case_id", "a", "ma", "la", "b", "lb")
            .agg(F.sum(F.col("within") + F.col("marks") * F.col("n")).alias("before"), F.min("first").alias("b_tid"), F.sum("n").alias("mb"))
            .select("case_id", "a", F.col("b_tid").alias("b"), "before", "ma", "mb", "la", "lb"))


def _self_bleu(length: Column) -> Column:
    """BLEU of a text and its copy."""
    same = {n: F.greatest(length - n + 1, F.lit(0)) for n in range(1, S.BLEU_MAX_N + 1)}
    return _bleu_expr(length, length, same)


INDEX_CHUNK = 1 << 20                           # indexes of a case whose copies of a text are one row
BLOCK_TEXTS, BLOCK_CHARS = 1024, 1 << 20        # texts and characters of a block


def block_pairs(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``texts`` (``case_id``, ``tid``, ...) as groups ``g`` in which every two texts of a case meet once.

    ``sizes`` has ``case_id, texts, chars``.  A case of one block is one group
    of side-0 rows.  A larger one has such a group for each block and one for
    each two blocks, their texts as sides 1 and 2.  Rows of a group follow each
    other by side.
    """
    parts = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("int")
    dealt = (texts.join(sizes.select("case_id", parts.alias("_parts")), "case_id")
             .withColumn("_mine", F.pmod(F.xxhash64("tid"), F.col("_parts")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
    group = F.md5(F.to_json(F.struct("case_id", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"))))
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    return (dealt.select(group.alias("g"), side.alias("side"), *texts.columns)
            .repartition("g").sortWithinPartitions("g", "side"))


def _over_groups(groups: DataFrame, score, fields: dict) -> DataFrame:
    """``score(table, starts)`` over the whole groups of ``block_pairs``: ``case_id`` and ``fields``."""
    def run(batches):
        from ..functions.pairs import whole_groups
        for table, starts in whole_groups(batches):
            yield from score(table, starts)

    schema = T.StructType([groups.schema["case_id"], *[T.StructField(name, kind) for name, kind in fields.items()]])
    return groups.mapInArrow(run, schema)


def _bleu_group(table, starts):
    from ..functions.pairs import bleu_sums
    return bleu_sums(table, starts)


def bleu_across_variants(df: DataFrame, *, response_col: str, case_col: str = "case_id",
                         idx_col: str = "variant_idx") -> DataFrame:
    """B2: mean pairwise BLEU per case (NULL when fewer than two non-null responses).

    Equal responses of a case are one text with its copies (a row for each
    ``INDEX_CHUNK`` indexes), so a case made of m copies has no m * m rows:
    pairs of copies add their score C(m, 2) times, and which copy comes first
    in pairs of different texts is counted from the indexes.  Indexes are
    whole numbers, distinct within a case; a response without one is paired
    with none.  Rows with a NULL case id are left out, as a pandas
    ``groupby`` does.
    """
    tokens = X.whitespace_tokens("text")
    rows = df.where(F.col(case_col).isNotNull()).select(
        F.col(case_col).alias("case_id"), F.col(idx_col).cast("long").alias("idx"), F.col(response_col).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("idx") / INDEX_CHUNK))
    texts = (rows.where(F.col("text").isNotNull() & F.col("idx").isNotNull()).groupBy("case_id", "text", "chunk")
             .agg(F.min("idx").alias("tid"), F.count(F.lit(1)).alias("m"), F.collect_list("idx").alias("at"))
             .select("case_id", "tid", "m", "at", tokens.alias("tokens")))
    counted = (rows.select("case_id", F.unhex(F.md5("text")).alias("key"), "chunk", F.size(tokens).alias("len"), F.length("text").alias("chars"))
               .groupBy("case_id", "key", "chunk", "len", "chars").agg(F.count(F.lit(1)).alias("m")))
    given = F.col("key").isNotNull()
    own = F.col("m") * (F.col("m") - 1) / 2 * _self_bleu(F.col("len"))
    per_case = counted.groupBy("case_id").agg(
        F.coalesce(F.sum(F.when(given, F.col("m"))), F.lit(0)).alias("k"), F.sum(F.when(given & (F.col("m") > 1), own)).alias("_self"),
        F.count("key").alias("texts"), F.sum("chars").alias("chars"))
    cross = (_over_groups(block_pairs(texts, per_case.select("case_id", "texts", "chars")), _bleu_group, {"cross": T.DoubleType()})
             .groupBy("case_id").agg(F.sum("cross").alias("_cross")))
    sums = per_case.join(cross, "case_id", "left").select(
        "case_id", "k", (F.coalesce("_self", F.lit(0.0)) + F.coalesce("_cross", F.lit(0.0))).alias("_s"))
    n_pairs = F.col("k") * (F.col("k") - 1) / 2
    return sums.select("case_id", F.when(F.col("k") >= 2, F.col("_s") / n_pairs).alias("bleu"))


def _clipped(ref, cand, n: int):
    """Sum over the distinct n-grams of ``cand`` of the smaller of its two counts."""
    r, c = _ngrams(ref, n), _ngrams(cand, n)
    times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    return F.aggregate(F.array_intersect(c, r), F.lit(0), lambda s, g: s + F.least(times(r, g), times(c, g)))


def pair_bleu(df: DataFrame, *, reference_col: str, candidate_col: str, key_cols) -> DataFrame:
    """B1 for explicit (reference, candidate) rows: ``key_cols`` and ``bleu``, scored inside each row.

    Keys are only carried along, so NULL and repeated keys are rows like any other.
    """
    base = df.select(*key_cols, X.whitespace_tokens(F.coalesce(F.col(reference_col), F.lit(""))).alias("_ref"),
                     X.whitespace_tokens(F.coalesce(F.col(candidate_col), F.lit(""))).alias("_cand"))
    matches = {n: _clipped(F.col("_ref"), F.col("_cand"), n) for n in range(1, S.BLEU_MAX_N + 1)}
    return base.select(*key_cols, _bleu_expr(F.size("_ref"), F.size("_cand"), matches).alias("bleu"))


# --------------------------------------------------------------- ROUGE-L ----

def rouge_tokens(text) -> F.Column:
    """Lower-case, non [a-z0-9] runs -> space, split, drop empties (stemming applied separately)."""
    t = F.regexp_replace(F.lower(X.col_(text)), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != F.lit(""))


def _worded(text) -> F.Column:
    """Whether ``rouge_tokens`` finds a token."""
    return F.lower(X.col_(text)).rlike("[a-z0-9]")


def stem_tokens(tokens) -> F.Column:
    """Porter stems of the tokens longer than 3 characters, the others as they are."""
    return F.transform(tokens, lambda t: F.when(F.length(t) > 3, stem(t)).otherwise(t))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems_udf(tokens: pa.Array) -> pa.Array:
    """``stem_tokens`` for many long texts: a batch stems each of its words once (``functions.porter``)."""
    import pyarrow.compute as pc
    from ..functions.porter import stem as plain
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([plain(w) if len(w) > 3 else w for w in words.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0))
    offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=tokens.is_null())


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    from ..functions.lcs import lcs_length
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


def _rouge_f(lcs, len_ref, len_cand):
    p = F.try_divide(lcs.cast("double"), len_cand)
    r = F.try_divide(lcs.cast("double"), len_ref)
    return F.when((lcs == 0) | (len_ref == 0) | (len_cand == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _rouge_text(text, stemmed: bool) -> F.Column:
    tokens = rouge_tokens(text)
    return stem_tokens(tokens) if stemmed else tokens


def _rouge_units(df: DataFrame, case_col: str, idx_col: str, text_col: str, stem: bool = True) -> DataFrame:
    """Distinct texts per case: (case_id, tid, m, tokens).

    Identical responses are scored once and weighted: ``m`` copies, id
    ``tid`` = their smallest index.  The copy count is a partial aggregate,
    so a case made of one text repeated millions of times is one row.
    ``worded``: the text has a token, told without cutting it.
    """
    units = (df.where(F.col(case_col).isNotNull())
             .groupBy(F.col(case_col).alias("case_id"), F.col(text_col).alias("text"))
             .agg(F.min(idx_col).alias("tid"), F.count(F.lit(1)).alias("m")))
    present = F.col("text").isNotNull()
    tokens = F.when(present, rouge_tokens("text"))
    return units.select("case_id", "tid", "m", _worded("text").alias("worded"), (stems_udf(tokens) if stem else tokens).alias("tokens"))


def _lcs_group(table, starts):
    from ..functions.pairs import lcs_pairs
    return lcs_pairs(table, starts)


def _rouge_pairs(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pair of distinct texts with a common subsequence: (case_id, i, j, weight, rouge_l).

    The tokens of a text travel once a group of ``block_pairs``, not once a pair.
    """
    u = units.where(F.col("worded") & F.col("tid").isNotNull()).select(
        "case_id", F.col("tid").cast("long").alias("tid"), F.col("m").cast("long").alias("m"), "tokens")
    long = T.LongType()
    scored = _over_groups(block_pairs(u, sizes), _lcs_group, {"i": long, "j": long, "weight": long, "ni": long, "nj": long, "lcs": long})
    kind = units.schema["tid"].dataType
    return scored.select("case_id", F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "weight",
                         _rouge_f(F.col("lcs"), F.col("ni"), F.col("nj")).alias("rouge_l"))


def _rouge_sizes(df: DataFrame, case_col: str, text_col: str) -> DataFrame:
    """Per case ``k`` responses, the score ``_self`` of its copies, ``texts`` and ``chars``, from digests of the texts."""
    counted = (df.where(F.col(case_col).isNotNull())
               .select(F.col(case_col).alias("case_id"), F.unhex(F.md5(text_col)).alias("key"), F.length(text_col).alias("chars"),
                       _worded(text_col).alias("worded"))
               .groupBy("case_id", "key", "chars", "worded").agg(F.count(F.lit(1)).alias("m")))
    return counted.groupBy("case_id").agg(
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("m"))), F.lit(0)).alias("k"),
        F.sum(F.when(F.col("worded"), F.col("m") * (F.col("m") - 1) / 2)).alias("_self"),
        F.count("key").alias("texts"), F.sum("chars").alias("chars"))


def rouge_pair_scores(df: DataFrame, *, response_col: str, case_col: str = "case_id",
                      idx_col: str = "variant_idx") -> DataFrame:
    """Per pair of distinct texts with a common subsequence of stems: ROUGE-L F-measure.

    ``ref_idx`` / ``cand_idx`` are the smallest indexes of the two texts and
    ``weight`` the number of response pairs with exactly these two texts.
    """
    p = _rouge_pairs(_rouge_units(df, case_col, idx_col, response_col), _rouge_sizes(df, case_col, response_col))
    return p.select("case_id", F.col("i").alias("ref_idx"), F.col("j").alias("cand_idx"), "weight", "rouge_l")


def rouge_l_across_variants(df: DataFrame, *, response_col: str, case_col: str = "case_id",
                            idx_col: str = "variant_idx", stem: bool = True) -> DataFrame:
    """Mean pairwise ROUGE-L F per case (NULL when fewer than two non-null responses).

    ROUGE-L F is symmetric, so the sum over response pairs is
    sum over distinct text pairs of m_a * m_b * F + sum over texts of C(m, 2) * F(t, t),
    with F(t, t) = 1 for a text with at least one token.
    """
    per_case = _rouge_sizes(df, case_col, response_col)
    units = _rouge_units(df, case_col, idx_col, response_col, stem)
    cross = _rouge_pairs(units, per_case).groupBy("case_id").agg(F.sum(F.col("weight") * F.col("rouge_l")).alias("_cross"))
    sums = (per_case.join(cross, "case_id", "left")
            .select("case_id", "k", (F.coalesce("_self", F.lit(0.0)) + F.coalesce("_cross", F.lit(0.0))).alias("_s")))
    return _mean_over_pairs(sums.select("case_id", "k"), sums.select("case_id", "_s"), "rouge_l")


def pair_rouge_l(df: DataFrame, *, reference_col: str, candidate_col: str, stem: bool = True) -> DataFrame:
    """B3 for explicit (reference, candidate) rows: adds ``rouge_l``."""
    a = _rouge_text(F.coalesce(F.col(reference_col), F.lit("")), stem)
    b = _rouge_text(F.coalesce(F.col(candidate_col), F.lit("")), stem)
    d = df.withColumns({"_ta": a, "_tb": b})
    return d.withColumn("rouge_l", _rouge_f(lcs_udf("_ta", "_tb"), F.size("_ta"), F.size("_tb"))).drop("_ta", "_tb")


def low_consistency(scores: DataFrame, score_col: str = "bleu", threshold: float = 0.5) -> DataFrame:
    """Cases whose mean pairwise score is below ``threshold``."""
    return scores.where(F.col(score_col) < threshold)
