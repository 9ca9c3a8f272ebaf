"""Scoring: apply a fitted pipeline, take the class-1 probability, list leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions.exprs import col_of, vector_element


def predict(model, df: DataFrame) -> DataFrame:
    """Batch scoring with a fitted (pipeline) model: ``model.transform``."""
    return model.transform(df)


def with_probability(df: DataFrame, prob_col: str = "probability", out: str = "lead_gen_prob",
                     index: int = 1) -> DataFrame:
    """Probability of class ``index`` from the probability vector (dense or sparse)."""
    return df.withColumn(out, vector_element(prob_col, index))


def leads(df: DataFrame, threshold: float, label: str = "label", prob: str = "lead_gen_prob") -> DataFrame:
    """Non-buyers (label 0) whose probability is strictly above ``threshold``."""
    return df.filter((col_of(label) == 0) & (col_of(prob) > threshold))


def buyers(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(col_of(label) == 1)


def rule_probability(df: DataFrame, col: str, scale: float, out: str = "lead_gen_prob") -> DataFrame:
    """A transparent stand-in score ``least(1, col / scale)`` (for checks without a model)."""
    return df.withColumn(out, F.least(F.lit(1.0), col_of(col).cast("double") / F.lit(float(scale))))
