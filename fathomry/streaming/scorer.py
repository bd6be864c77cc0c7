"""Scores of prompts whose tokens arrive as a stream. An extension: the batch operators' linear score and max reduction, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import dot, sigmoid


def running_max(tokens: DataFrame, coef: list[float], intercept: float, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """tokens: stream of (prompt_id, ts, vec); the greatest probability of class 1 of each prompt and window, late data within `delay` included."""
    p = sigmoid(dot(F.col("vec"), F.array(*[F.lit(float(w)) for w in coef])) + F.lit(float(intercept)))
    return tokens.withWatermark("ts", delay).select("prompt_id", "ts", p.alias("p")).groupBy("prompt_id", F.window("ts", window)).agg(F.max("p").alias("p_max"), F.count("*").alias("tokens"))
