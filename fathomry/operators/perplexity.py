"""Cross-entropy of tokens and perplexity features of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cross_entropy(logits: Column, target: Column) -> Column:
    """Log-sum-exp of the logits minus the logit of the target (an index from 0)."""
    top = F.array_max(logits)
    return F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - F.get(logits, target)


def token_losses(tokens: DataFrame, key: str = "prompt_id") -> DataFrame:
    """key, pos, loss of each token but the last: its logits against the next token."""
    following = F.lead("token_id").over(Window.partitionBy(key).orderBy("pos"))
    shifted = tokens.select(key, "pos", "logits", following.alias("target")).where("target is not null")
    return shifted.select(key, "pos", cross_entropy(F.col("logits"), F.col("target")).alias("loss"))


def features(losses: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """exp of the mean, least and greatest loss; 1 for prompts without a token that counts."""
    agg = losses.groupBy(key).agg(F.exp(F.avg("loss")).alias("mean_ppl"), F.exp(F.min("loss")).alias("min_ppl"), F.exp(F.max("loss")).alias("max_ppl"))
    return prompts.select(key).join(agg, key, "left").select(key, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("mean_ppl", "min_ppl", "max_ppl")])
