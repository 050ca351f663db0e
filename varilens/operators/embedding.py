"""Cosine consistency and the gender-direction bias score.

Embeddings are an input column (``array<float|double>``); the encoder
itself is out of scope.  Vector math stays in Spark's higher-order array
functions (``zip_with`` / ``aggregate``), always in double precision.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def _dbl(v) -> Column:
    return F.transform(X.col_(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_dbl(a), _dbl(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """Cosine; 0 when either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def unit(a) -> Column:
    return _bind(norm(a), lambda n: F.transform(_dbl(a), lambda x: F.when(n == 0, x * 0.0).otherwise(x / n)))


def cossim_across_variants(df: DataFrame, *, embedding_col: str = "embedding",
                           case_col: str = "case_id") -> DataFrame:
    """Mean pairwise cosine per case without forming pairs.

    With unit vectors u (zero vectors stay zero), the sum over pairs i<j of
    u_i . u_j is (|sum u|^2 - sum |u|^2) / 2, so the mean is
    (|sum u|^2 - sum |u|^2) / (k (k - 1)).  One partial aggregate per case
    (vector sum, count, sum of squares), so even a huge case is one row per
    task before the only shuffle.  One response gives NULL; cases without
    responses and rows with a NULL case id give no row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    u = df.where(F.col(embedding_col).isNotNull() & F.col(case_col).isNotNull()).select(
        F.col(case_col).alias("case_id"), unit(embedding_col).alias("u"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    out = u.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum(square("u")).alias("sum_sq"),
        square(vector_to_array(Summarizer.sum(array_to_vector("u")))).alias("sq_of_sum"))
    mean = F.try_divide(F.col("sq_of_sum") - F.col("sum_sq"), (F.col("k") * (F.col("k") - 1)).cast("double"))
    return out.select("case_id", F.when(F.col("k") >= 2, mean).alias("cossim"))


def embed_distinct(df: DataFrame, text_col: str, embed) -> DataFrame:
    """Embed each distinct text once with ``embed`` (Column -> Column) and join back, on a hash before the text."""
    keyed = df.withColumn("_hash", F.xxhash64(text_col))
    texts = keyed.select("_hash", text_col).where(F.col(text_col).isNotNull()).distinct()
    # As a generator's output: a later filter on the vectors does not embed the texts a second time.
    emb = texts.select("_hash", text_col, F.explode(F.array(embed(F.col(text_col)))).alias("embedding"))
    return keyed.join(emb, ["_hash", text_col], "left").drop("_hash")


#: Models that this Python worker has loaded, by the embedder they belong to.
WORKER_MODELS: dict = {}


def model_embedder(load, *, batch_size: int = 64):
    """E3/J3 with a user's encoder: an ``embed`` for ``embed_distinct`` from ``load() -> encode``.

    ``load`` runs once in a Python worker process (kept from task to task by
    worker reuse), ``encode`` takes a list of at most ``batch_size`` texts and
    returns one vector a text.  ``embed_distinct`` hands it every distinct
    text once.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from varilens.operators import embedding as home  # the worker's module, not the pickled function's names
        encode = home.WORKER_MODELS.get(key)
        if encode is None:
            encode = home.WORKER_MODELS[key] = load()
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), batch_size):
                out += [[float(x) for x in v] for v in encode(texts.iloc[k:k + batch_size].tolist())]
            yield pd.Series(out, index=texts.index, dtype=object)

    return embed


# --------------------------------------------------------- gender direction ----

def _diffs(pairs: DataFrame, female_col: str, male_col: str) -> DataFrame:
    return pairs.select(F.zip_with(_dbl(female_col), _dbl(male_col), lambda f, m: f - m).alias("d"))


def gender_direction_mean(pairs: DataFrame, *, female_col: str = "female", male_col: str = "male") -> DataFrame:
    """Mean of (female - male) differences as a one-row ``direction`` array (SQL-expressible variant)."""
    d = _diffs(pairs, female_col, male_col).select(F.posexplode("d").alias("dim", "x"))
    return (d.groupBy("dim").agg(F.avg("x").alias("x"))
            .agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_s"))
            .select(F.transform("_s", lambda s: s.x).alias("direction")))


def difference_moments(pairs: DataFrame, *, female_col: str = "female", male_col: str = "male") -> DataFrame:
    """One row ``n, total array<double>, moments array<array<double>>`` over the (female - male) differences.

    A constant 1 behind each difference makes count, sums and second moments
    one aggregate: component ``i`` times the whole vector, summed by ``i``
    with map-side partial sums, so a task sends at most d + 1 rows.  Pairs
    with a NULL, a NULL or non-finite component or unequal lengths take no
    part.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    d = _diffs(pairs, female_col, male_col).where(
        F.col("d").isNotNull() & ~F.exists("d", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = d.select(F.concat("d", F.array(F.lit(1.0))).alias("v")).select(F.posexplode("v").alias("i", "x"), "v")
    sums = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(
        array_to_vector(F.transform("v", lambda y: y * F.col("x"))))).alias("row"))
    whole = sums.agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("m")).select(F.col("m.row").alias("m"))
    last = F.element_at("m", -1)
    inner = F.transform(F.slice("m", 1, F.size("m") - 1), lambda r: F.slice(r, 1, F.size(r) - 1))
    return whole.where(F.size("m") > 0).select(
        F.element_at(last, -1).cast("long").alias("n"), F.slice(last, 1, F.size(last) - 1).alias("total"), inner.alias("moments"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _scaled_to_unit(v: Column) -> Column:
    return _bind(F.sqrt(_inner(v, v)), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))


def power_iteration(matrix: Column, *, tolerance: float = 1e-14, max_steps: int = 20_000) -> Column:
    """Leading eigenvector of a positive semi-definite ``array<array<double>>``: struct ``v, gap, steps``.

    ``v <- M v / |M v|`` until no component moves by more than ``tolerance``
    (``gap``); after that the fold carries its state along without work.  The
    start ``sin(1), sin(2), ...`` is fixed and has a part along every axis.
    A zero matrix has no direction: ``v`` is NULL.
    """
    start = _scaled_to_unit(F.transform(F.sequence(F.lit(1), F.size(matrix)), lambda i: F.sin(i.cast("double"))))
    first = F.struct(start.alias("v"), F.lit(float("inf")).alias("gap"), F.lit(0).alias("steps"))

    def step(state: Column) -> Column:
        image = F.transform(matrix, lambda row: _inner(row, state["v"]))
        moved = lambda w: F.array_max(F.zip_with(w, state["v"], lambda x, y: F.abs(x - y)))
        return _bind(_bind(image, _scaled_to_unit),
                     lambda w: F.struct(w.alias("v"), moved(w).alias("gap"), (state["steps"] + 1).alias("steps")))

    trace = F.aggregate(F.transform(matrix, lambda row, i: F.get(row, i)), F.lit(0.0), lambda s, x: s + x)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), first,
                        lambda s, _: F.when(s["gap"] > tolerance, step(s)).otherwise(s))
    return F.when(trace > 0, found)


def gender_direction(pairs: DataFrame, *, female_col: str = "female", male_col: str = "male", method: str = "pca",
                     orient: str = "max_abs_positive", tolerance: float = 1e-14, max_steps: int = 20_000) -> DataFrame:
    """E4 as a lazy one-row table ``direction, gap, steps``.

    ``method="pca"``: first principal component of the (female - male)
    differences, by power iteration on their centred second moments;
    ``"mean"``: their mean.  Nothing runs before the table is used, so it may
    be a scalar subquery of a scoring plan.  Sign of the component: the
    largest-magnitude loading positive, or with ``orient="female_positive"``
    so that mean(f - m) . g >= 0.  Fewer than two pairs, or equal differences:
    NULL.
    """
    if method == "mean":
        mean = gender_direction_mean(pairs, female_col=female_col, male_col=male_col)
        return mean.select("direction", F.lit(0.0).alias("gap"), F.lit(0).alias("steps"))
    if method != "pca":
        raise ValueError(f"method is 'pca' or 'mean', not {method!r}")
    m = difference_moments(pairs, female_col=female_col, male_col=male_col)
    centred = F.transform("moments", lambda row, i: F.zip_with(
        row, "total", lambda x, t: x - F.get(F.col("total"), i) * t / F.col("n")))
    # A matrix of rounding noise is no variance: diagonal entries below 1e-14 of the raw moments are zero.
    spread = F.exists("diagonal", lambda x: x["c"] > 1e-14 * x["raw"])
    diagonal = F.transform("centred", lambda row, i: F.struct(F.get(row, i).alias("c"), F.get(F.get(F.col("moments"), i), i).alias("raw")))
    found = F.when((F.col("n") > 1) & spread, power_iteration(F.col("centred"), tolerance=tolerance, max_steps=max_steps))
    # The aggregate over the one row keeps filters on the result from being pushed into (and repeating) the iteration.
    steps = (m.withColumn("centred", centred).withColumn("diagonal", diagonal)
             .agg(F.first("total").alias("total"), F.first(found).alias("s")))
    lead = (_inner(F.col("total"), F.col("s.v")) if orient == "female_positive" else
            F.aggregate("s.v", F.lit(0.0), lambda best, x: F.when(F.abs(x) > F.abs(best), x).otherwise(best)))
    return (steps.withColumn("flip", F.when(lead < 0, -1.0).otherwise(1.0))
            .select(F.transform("s.v", lambda x: x * F.col("flip")).alias("direction"), "s.gap", "s.steps"))


def gender_direction_pca(pairs: DataFrame, *, female_col: str = "female", male_col: str = "male",
                         orient: str = "max_abs_positive") -> list[float] | None:
    """The first principal component as a list (d floats on the driver); see ``gender_direction``."""
    row = gender_direction(pairs, female_col=female_col, male_col=male_col, orient=orient).first()
    return None if row is None or row["direction"] is None else [float(x) for x in row["direction"]]


def gender_bias_score(df: DataFrame, direction, *, embedding_col: str = "embedding",
                      out_col: str = "gender_bias_score") -> DataFrame:
    """E5: (e . g) / |g| per row; ``direction`` is a list of floats (length = embedding dimension)."""
    g = F.array(*[F.lit(float(x)) for x in direction]) if isinstance(direction, (list, tuple)) else direction
    score = F.when(F.col(embedding_col).isNull(), F.lit(None).cast("double")).otherwise(
        F.try_divide(dot(embedding_col, g), norm(g)))
    return df.withColumn(out_col, score)


def scored_rows(df: DataFrame, score_col: str) -> DataFrame:
    """Rows with a score that is a number, with their derived ``gender``."""
    cols = [F.col(c) if c in df.columns else F.lit(0) for c in S.GENDER_ONEHOT]
    return df.where(F.col(score_col).isNotNull() & ~F.isnan(score_col)).withColumn("gender", X.derive_gender(*cols))


def bias_by_gender(df: DataFrame, score_col: str = "gender_bias_score") -> DataFrame:
    """Mean and sample std per derived gender."""
    return scored_rows(df, score_col).groupBy("gender").agg(F.avg(score_col).alias("mean"),
                                                          F.stddev_samp(score_col).alias("std"))


def bias_by_ethnicity(df: DataFrame, score_col: str = "gender_bias_score") -> DataFrame:
    """Mean and sample std per ethnicity (NULL ethnicity dropped)."""
    return (scored_rows(df, score_col).where(F.col("ethnicity").isNotNull()).groupBy("ethnicity")
            .agg(F.avg(score_col).alias("mean"), F.stddev_samp(score_col).alias("std")))


def bias_crosstab(df: DataFrame, score_col: str = "gender_bias_score") -> DataFrame:
    """E8 (long form): mean score per (gender, ethnicity)."""
    return (scored_rows(df, score_col).where(F.col("ethnicity").isNotNull()).groupBy("gender", "ethnicity")
            .agg(F.avg(score_col).alias("mean")))


def original_bias(df: DataFrame, score_col: str = "gender_bias_score") -> DataFrame:
    """Mean and sample std per gender of unexpanded rows, tagged with ethnicity 'original'."""
    return bias_by_gender(df, score_col).select("gender", F.lit("original").alias("ethnicity"), "mean", "std")


def median_bias(df: DataFrame, score_col: str = "gender_bias_score", *, accuracy: int = 200_000) -> DataFrame:
    """Exact median of the score (mean of the two middle values when n is even), as one lazy plan.

    An approximate quantile sketch brackets the middle: its rank error is at
    most ``n / accuracy``, and the bracket is two such steps wide on either
    side, so both middle rows lie inside.  Rows below are only counted, rows
    inside are counted per value (partial aggregates), and only these few
    counts are ordered.  NULL and NaN are left out; empty input -> NULL.
    """
    x = df.where(F.col(score_col).isNotNull() & ~F.isnan(score_col)).select(F.col(score_col).cast("double").alias("x"))
    step = 2.0 / accuracy
    around = F.percentile_approx("x", [0.5 - step, 0.5 + step], accuracy)
    bounds = x.agg(F.struct(F.count(F.lit(1)).alias("n"), around[0].alias("low"), around[1].alias("high")).alias("b")).scalar()
    low, high, n = bounds["low"], bounds["high"], bounds["n"]
    inside = F.when(F.col("x") >= low, F.col("x"))
    counts = (x.where(F.col("x") <= high).groupBy(inside.alias("value")).agg(F.count(F.lit(1)).alias("c"))
              .withColumn("upto", F.sum("c").over(Window.orderBy(F.asc_nulls_first("value")))))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("value")))

    return counts.agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0).alias("mb"))
