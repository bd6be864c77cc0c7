"""Sources of activation rows. The language model's forward pass is one of them and stays outside of the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash


class ActivationSource(Protocol):
    """What the cache and the probe need: a name, the number of layers, and rows of vectors for prompts.

    A source may also have pooled(prompts, layers, strategy), giving prompt_id, layer, vec without a row for each token.
    """

    name: str

    def num_layers(self) -> int: ...

    def extract(self, wanted: DataFrame) -> DataFrame:
        """wanted: prompt_hash, text, layer; gives prompt_hash, layer, pos, vec of real tokens."""

    def losses(self, prompts: DataFrame) -> DataFrame:
        """prompts: prompt_hash, text; gives prompt_hash, pos, loss."""


def prompt_table(spark: SparkSession, texts: list[str], labels: list[int] | None = None) -> DataFrame:
    """prompt_id, prompt_hash, text, label of a list; its order becomes prompt_id."""
    rows = [(i, t, None if labels is None else int(labels[i])) for i, t in enumerate(texts)]
    return with_hash(spark.createDataFrame(rows, "prompt_id long, text string, label int"))


def with_hash(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_hash", short_hash(F.col("text")))


class TableSource:
    """Activations that lie in a table (prompt_hash, layer, pos, vec), and optionally losses (prompt_hash, pos, loss)."""

    def __init__(self, activations: DataFrame, losses: DataFrame | None = None, name: str = "table"):
        self.name, self.activations, self._losses = name, activations, losses

    def num_layers(self) -> int:
        top = self.activations.agg(F.max("layer")).first()[0]
        return 0 if top is None else top + 1

    def extract(self, wanted: DataFrame) -> DataFrame:
        return self.activations.join(wanted.select("prompt_hash", "layer").distinct(), ["prompt_hash", "layer"], "left_semi").select("prompt_hash", "layer", "pos", "vec")

    def losses(self, prompts: DataFrame) -> DataFrame:
        if self._losses is None:
            raise ValueError("this source has no losses")
        return self._losses.join(prompts.select("prompt_hash").distinct(), "prompt_hash", "left_semi").select("prompt_hash", "pos", "loss")


class HashSource:
    """Deterministic vectors from hashes of words, without a model: for tests and dry runs. All in the JVM."""

    def __init__(self, layers: int = 4, width: int = 16, name: str = "hash"):
        self.layers, self.width, self.name = layers, width, name

    def num_layers(self) -> int:
        return self.layers

    @staticmethod
    def _words(df: DataFrame) -> DataFrame:
        words = F.split(F.trim("text"), r"\s+")
        return df.select("*", F.posexplode(words).alias("pos", "word"))

    def extract(self, wanted: DataFrame) -> DataFrame:
        unit = lambda i: F.pmod(F.xxhash64("word", "layer", i), F.lit(20001)) / 10000.0 - 1.0
        rows = self._words(wanted.select("prompt_hash", "text", "layer").distinct())
        return rows.select("prompt_hash", "layer", "pos", F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), unit).alias("vec"))

    def pooled(self, prompts: DataFrame, layers: list[int], strategy: str) -> DataFrame:
        """prompt_id, layer, vec: as extract and pool give, up to rounding, but only sums of each prompt move, never a token's vector."""
        words, cells = F.split(F.trim("text"), r"\s+"), [(layer, i) for layer in sorted(set(layers)) for i in range(self.width)]
        # The hashes of extract: layer and place are integers there.
        unit = [F.pmod(F.xxhash64("word", F.lit(layer), F.lit(i)), F.lit(20001)) for layer, i in cells]
        if strategy == "mean":
            rows = prompts.select("prompt_id", F.explode_outer(words).alias("word")).where("word is not null")
            sums = rows.groupBy("prompt_id").agg(F.count("*").alias("n"), *[F.sum(u).alias(f"s{k}") for k, u in enumerate(unit)])
            value = [F.col(f"s{k}") / F.col("n") / 10000.0 - 1.0 for k in range(len(cells))]
        else:
            pos = F.size(words) - 1 if strategy == "last_token" else F.lit(0)
            rows = prompts.where("text is not null").select("prompt_id", pos.alias("pos"), F.get(words, pos).alias("word"))
            sums = rows.groupBy("prompt_id").agg((F.max_by if strategy == "last_token" else F.min_by)("word", "pos").alias("word"))
            value = [u / 10000.0 - 1.0 for u in unit]
        vecs = [F.struct(F.lit(layer).alias("layer"), F.array(*[v for v, (at, _) in zip(value, cells) if at == layer]).alias("vec")) for layer in sorted(set(layers))]
        return sums.select("prompt_id", F.inline(F.array(*vecs)))

    def losses(self, prompts: DataFrame) -> DataFrame:
        rows = self._words(prompts.select("prompt_hash", "text").distinct()).where("pos > 0")
        return rows.select("prompt_hash", "pos", (F.pmod(F.xxhash64("word"), F.lit(5000)) / 1000.0).alias("loss"))


_loaded: dict[str, object] = {}


class ModelSource:
    """A model run inside the Python workers: load() once a worker, forward(model, texts, layers) for each batch.

    forward gives, for each text, (layers x tokens x width) nested lists of its real tokens, and its token losses.
    """

    def __init__(self, name: str, layers: int, load: Callable, forward: Callable, batch_size: int = 8):
        if batch_size < 1:
            raise ValueError("batch_size is 1 at least")
        self.name, self.layers, self.load, self.forward, self.batch_size = name, layers, load, forward, batch_size

    def num_layers(self) -> int:
        return self.layers

    def _run(self, df: DataFrame, layers: list[int], emit: Callable, schema: str) -> DataFrame:
        name, load, forward, size = self.name, self.load, self.forward, self.batch_size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _loaded.setdefault(name, None) or _loaded.__setitem__(name, load()) or _loaded[name]
            for frame in frames:
                for at in range(0, len(frame), size):
                    part = frame.iloc[at : at + size]
                    yield emit(part["prompt_hash"].tolist(), forward(model, part["text"].tolist(), layers), layers)

        return df.mapInPandas(run, schema)

    def extract(self, wanted: DataFrame) -> DataFrame:
        layers = sorted(r[0] for r in wanted.select("layer").distinct().collect())

        def emit(hashes, results, layers):
            rows = [(h, layer, pos, vec) for h, (acts, _) in zip(hashes, results) for layer, tokens in zip(layers, acts) for pos, vec in enumerate(tokens)]
            return pd.DataFrame(rows, columns=["prompt_hash", "layer", "pos", "vec"])

        found = self._run(wanted.select("prompt_hash", "text").distinct(), layers, emit, "prompt_hash string, layer int, pos int, vec array<double>")
        return found.join(wanted.select("prompt_hash", "layer").distinct(), ["prompt_hash", "layer"], "left_semi")

    def losses(self, prompts: DataFrame) -> DataFrame:
        def emit(hashes, results, _):
            rows = [(h, pos + 1, x) for h, (_, losses) in zip(hashes, results) for pos, x in enumerate(losses)]
            return pd.DataFrame(rows, columns=["prompt_hash", "pos", "loss"])

        return self._run(prompts.select("prompt_hash", "text").distinct(), [], emit, "prompt_hash string, pos int, loss double")


def clear_models() -> None:
    _loaded.clear()
