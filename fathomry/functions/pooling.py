"""Pooling of token vectors and reduction of token scores. Padding rows don't exist, or carry is_real = false."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN = ("last_token", "first_token", "mean", "all")
INFERENCE = (*TRAIN, "max", "min")


def resolve(pooling: str | None = None, train: str | None = None, inference: str | None = None) -> tuple[str, str]:
    """(train, inference): the specific argument before the common one before last_token; max and min only score."""
    base = pooling or "last_token"
    found = train or ("last_token" if base in ("max", "min") and train is None and inference is None and pooling is None else base), inference or base
    if found[0] not in TRAIN:
        raise ValueError(f"unknown training pooling {found[0]!r}; one of {', '.join(TRAIN)}")
    if found[1] not in INFERENCE:
        raise ValueError(f"unknown inference pooling {found[1]!r}; one of {', '.join(INFERENCE)}")
    return found


def pool(tokens: DataFrame, strategy: str, keys: list[str]) -> DataFrame:
    """One vector for each keys (usually prompt and layer) of tokens (keys, pos, vec); "all", "max", "min" keep each token.

    Only the array moves: last and first are one hash aggregation of (pos, vec), without a sort or a window.
    """
    if "is_real" in tokens.columns:
        tokens = tokens.where("is_real")
    if strategy == "last_token":
        return tokens.groupBy(*keys).agg(F.max_by("vec", "pos").alias("vec"))
    if strategy == "first_token":
        return tokens.groupBy(*keys).agg(F.min_by("vec", "pos").alias("vec"))
    if strategy == "mean":
        vec = array_to_vector(F.col("vec").cast("array<double>"))
        return tokens.where("vec is not null").groupBy(*keys).agg(vector_to_array(Summarizer.mean(vec)).alias("vec"))
    if strategy in ("all", "max", "min"):
        return tokens.select(*keys, "pos", "vec")
    raise ValueError(f"unknown pooling {strategy!r}")


def reduce_scores(scores: DataFrame, strategy: str, keys: list[str], value: str = "p") -> DataFrame:
    """Greatest or least score of each class over the tokens; the results of the classes no longer sum to 1."""
    if strategy not in ("max", "min"):
        raise ValueError(f"scores are reduced by max or min, not {strategy!r}")
    return scores.groupBy(*keys).agg((F.max if strategy == "max" else F.min)(value).alias(value))


def majority(votes: DataFrame, keys: list[str], label: str = "pred") -> DataFrame:
    """The most frequent label of each keys; ties go to the lowest label."""
    counts = votes.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("low"))).alias(label))
