"""String helpers over model names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorum.config import KFOLD_PREFIX
from quorum.functions.metrics import col


def normalise_model_name(c) -> Column:
    """Strip every occurrence of the k-fold prefix."""
    return F.regexp_replace(col(c), KFOLD_PREFIX, "")


def display_label(model, threshold) -> Column:
    """``"{model} (τ={threshold:.2f})"``; a NULL threshold keeps the plain name."""
    m, t = col(model), col(threshold)
    return F.when(t.isNull(), m).otherwise(F.format_string("%s (τ=%.2f)", m, t))
