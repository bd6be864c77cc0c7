"""Schemas of the engine's tables. Layers and neurons are columns or array positions, never offsets into one flat vector."""

from pyspark.sql import types as T

_A = T.ArrayType


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
PROMPTS = _s(("prompt_id", _L), ("prompt_hash", _S), ("text", _S), ("label", _I))
ACTIVATIONS = _s(("model_hash", _S), ("prompt_hash", _S), ("layer", _I), ("pos", _I), ("vec", _A(_D)))
POOLED = _s(("model_hash", _S), ("pooling", _S), ("layer", _I), ("prompt_hash", _S), ("vec", _A(_D)))
PERPLEXITY = _s(("model_hash", _S), ("prompt_hash", _S), ("mean_ppl", _D), ("min_ppl", _D), ("max_ppl", _D))
TOKEN_LOSS = _s(("prompt_hash", _S), ("pos", _I), ("loss", _D))
LEADERBOARD = _s(("name", _S), ("score", _D), ("fit_time", _D), ("predict_time", _D))
IMPORTANCE = _s(("layer", _I), ("metric", _S), ("value", _D), ("selected", T.BooleanType()))
