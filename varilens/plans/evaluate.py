"""The evaluation facade - every metric of one or more models as lazy DataFrames.

The variant table is read once into a small answer cube (its size is models
x labels x groups), marked for caching, and all answer metrics derive from
it; ``close()`` (or leaving a ``with`` block) releases the cache.  Nothing
runs before a table is used.  Explanation metrics run only when the column is
given; the gender-bias summary only when an embedding column is given with
either a direction or the (female, male) pairs to learn one from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import embedding as E
from ..operators import overlap as B


@dataclass
class EvaluationResults:
    accuracy: DataFrame
    accuracy_by_group: DataFrame
    accuracy_by_dimension: DataFrame
    performance_disparity: DataFrame
    skewsize: DataFrame
    header: DataFrame
    bleu: DataFrame | None = None
    rouge_l: DataFrame | None = None
    cossim: DataFrame | None = None
    gender_bias: dict = field(default_factory=dict)
    cube: DataFrame | None = None

    def tables(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if isinstance(v, DataFrame) and k != "cube"}
        out.update({f"gender_bias_{k}": v for k, v in self.gender_bias.items()})
        return out

    def summary(self) -> DataFrame:
        """One row per model: accuracy, disparity, skew and the cases behind it."""
        return (self.accuracy.select("llm", "accuracy")
                .join(self.performance_disparity.select("llm", "max_gap", "std"), "llm").join(self.skewsize, "llm", "left"))

    def close(self) -> None:
        if self.cube is not None:
            self.cube.unpersist()

    def __enter__(self) -> EvaluationResults:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def evaluate(df: DataFrame, *, llm_col: str | list[str], llm_name: str | None = None, label_col: str = "answer_idx",
             hue: str | None = None, explanation_col: str | None = None, explanation_embedding_col: str | None = None,
             case_embedding_col: str | None = None, direction=None, gender_pairs: DataFrame | None = None,
             direction_method: str = "pca", min_expected_value: float = 5) -> EvaluationResults:
    """Metrics of the answers in ``llm_col`` (a column or several).

    ``llm_name`` renames the only model; ``label_col`` holds the labels that
    SkewSize runs over and ``hue`` the groups it compares (default: ethnicity
    and gender).  ``gender_pairs`` are (female, male) embeddings; the direction
    learned from them (``direction_method``: their first principal component,
    or ``"mean"``) is part of the scoring plan.
    """
    cols = [llm_col] if isinstance(llm_col, str) else list(llm_col)
    if llm_name is not None:
        if len(cols) != 1:
            raise ValueError("llm_name names one model; several columns were given")
        df, cols = df.withColumnRenamed(cols[0], f"llm_{llm_name}"), [f"llm_{llm_name}"]
    extra = [c for c in (label_col, hue) if c is not None]
    cube = A.answer_cube(df, cols, extra).persist(StorageLevel.MEMORY_AND_DISK)
    res = EvaluationResults(
        accuracy=A.accuracy(cube),
        accuracy_by_group=A.accuracy_by_group(cube),
        accuracy_by_dimension=A.accuracy_by_dimension(cube),
        performance_disparity=A.performance_disparity(cube),
        skewsize=A.skewsize_from_cube(cube, min_expected_value, label_col, hue),
        header=A.eval_header(df),
        cube=cube,
    )
    if explanation_col is not None and explanation_col in df.columns:
        res.bleu = B.bleu_across_variants(df, response_col=explanation_col)
        res.rouge_l = B.rouge_l_across_variants(df, response_col=explanation_col)
        if explanation_embedding_col and explanation_embedding_col in df.columns:
            res.cossim = E.cossim_across_variants(df, embedding_col=explanation_embedding_col)
    if direction is None and gender_pairs is not None:
        df = df.withColumn("_direction", E.gender_direction(gender_pairs, method=direction_method).select("direction").scalar())
        direction = F.col("_direction")
    if case_embedding_col and direction is not None and case_embedding_col in df.columns:
        scored = E.gender_bias_score(df, direction, embedding_col=case_embedding_col)
        res.gender_bias = {"by_gender": E.bias_by_gender(scored), "by_ethnicity": E.bias_by_ethnicity(scored),
                           "crosstab": E.bias_crosstab(scored), "median": E.median_bias(scored)}
    return res
