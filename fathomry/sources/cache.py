"""Store of extracted activations, pooled vectors and perplexities as partitioned Parquet tables.

Hits and misses are joins: a prompt is a hit if all the layers that a query needs are there. Only missing
(prompt, layer) pairs are extracted, each distinct prompt once.
"""

from __future__ import annotations

import hashlib
import logging
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pooling as P
from ..operators import perplexity as ppl
from .activations import ActivationSource

log = logging.getLogger("fathomry.cache")
KINDS = {
    "activations": "prompt_hash string, pos int, vec array<double>, model_hash string, layer int",
    "pooled": "prompt_hash string, vec array<double>, model_hash string, pooling string, layer int",
    "perplexity": "prompt_hash string, mean_ppl double, min_ppl double, max_ppl double, model_hash string",
}
PARTITIONS = {"activations": ["model_hash", "layer"], "pooled": ["model_hash", "pooling", "layer"], "perplexity": ["model_hash"]}


@dataclass
class WarmupStats:
    total: int
    activations_cached: int
    activations_extracted: int
    perplexity_cached: int
    perplexity_extracted: int
    elapsed: float = 0.0

    @property
    def cache_hit_rate(self) -> float:
        return self.activations_cached / self.total if self.total else 0.0


def model_hash(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:16]


def hits(prompts: DataFrame, cached: DataFrame, layers: list[int]) -> DataFrame:
    """Rows of prompts whose every layer is in cached (prompt_hash, layer): relational division, then a semi join."""
    full = cached.where(F.col("layer").isin(layers)).groupBy("prompt_hash").agg(F.count_distinct("layer").alias("n")).where(F.col("n") == len(set(layers)))
    return prompts.join(full, "prompt_hash", "left_semi")


def misses(prompts: DataFrame, cached: DataFrame, layers: list[int]) -> DataFrame:
    """(prompt_hash, text, layer) pairs that cached lacks, each once."""
    wanted = prompts.select("prompt_hash", "text").distinct().withColumn("layer", F.explode(F.array(*[F.lit(i) for i in sorted(set(layers))])))
    return wanted.join(cached.select("prompt_hash", "layer"), ["prompt_hash", "layer"], "left_anti")


class ActivationCache:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or os.environ.get("FATHOMRY_CACHE_DIR") or os.path.expanduser("~/.cache/fathomry")).rstrip("/")

    def _path(self, kind: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, kind: str, model: str | None = None) -> DataFrame:
        """A kind's table; filters on model_hash, pooling and layer prune partitions."""
        path, fs = self._path(kind)
        out = self.spark.read.schema(KINDS[kind]).parquet(str(path)) if fs.exists(path) else self.spark.createDataFrame([], KINDS[kind])
        return out if model is None else out.where(F.col("model_hash") == model_hash(model))

    def append(self, kind: str, rows: DataFrame, model: str, **constants) -> None:
        for k, v in ({"model_hash": model_hash(model)} | constants).items():
            rows = rows.withColumn(k, F.lit(v))
        rows.select(*[f.split()[0] for f in KINDS[kind].split(", ")]).write.mode("append").partitionBy(*PARTITIONS[kind]).parquet(f"{self.root}/{kind}")

    def layers(self, model: str) -> DataFrame:
        """prompt_hash and the sorted layers that are there."""
        return self.read("activations", model).groupBy("prompt_hash").agg(F.array_sort(F.collect_set("layer")).alias("layers"))

    def invalidate(self, prompts: DataFrame, model: str | None = None) -> None:
        """Drop all kinds of rows of these prompts: rewritten beside and then swapped, so that a failed write loses nothing."""
        keys = prompts.select("prompt_hash").distinct()
        for kind in KINDS:
            path, fs = self._path(kind)
            if not fs.exists(path):
                continue
            rows = self.read(kind)
            gone = F.lit(True) if model is None else F.col("model_hash") == model_hash(model)
            kept = rows.join(keys.withColumn("drop", F.lit(True)), "prompt_hash", "left").where(~(gone & F.col("drop").isNotNull())).drop("drop")
            beside = f"{self.root}/.{kind}-{uuid.uuid4().hex}"
            kept.write.partitionBy(*PARTITIONS[kind]).parquet(beside)
            fs.delete(path, True)
            fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(beside), path)

    def clear(self) -> int:
        """Drop everything; the number of prompts that were there."""
        keys = [self.read(k).select("model_hash", "prompt_hash") for k in KINDS]
        n = keys[0].union(keys[1]).union(keys[2]).distinct().count()
        for kind in KINDS:
            path, fs = self._path(kind)
            fs.delete(path, True)
        return n

    def status(self, prompts: DataFrame, source: ActivationSource, layers: list[int], pooling: str | None = None, perplexity: bool = False) -> tuple[DataFrame, DataFrame]:
        """Missing (prompt_hash, text, layer) pairs and missing (prompt_hash, text) perplexities."""
        stored = self.read("activations" if pooling is None else "pooled", source.name)
        if pooling is not None:
            stored = stored.where(F.col("pooling") == pooling)
        need = misses(prompts, stored.select("prompt_hash", "layer").distinct(), layers)
        texts = prompts.select("prompt_hash", "text").distinct()
        lost = texts.join(self.read("perplexity", source.name), "prompt_hash", "left_anti") if perplexity else texts.limit(0)
        return need, lost

    def warmup(self, prompts: DataFrame, source: ActivationSource, layers: list[int], pooling: str | None = None, perplexity: bool = False) -> WarmupStats:
        """Extract and store what is missing. Counts are over the rows of prompts, repeats included."""
        if pooling is not None and pooling not in ("last_token", "first_token", "mean"):
            raise ValueError(f"vectors can't be stored pooled by {pooling!r}")
        began = time.monotonic()
        need, lost = (x.persist() for x in self.status(prompts, source, layers, pooling, perplexity))
        total = prompts.count()
        new = prompts.join(need.select("prompt_hash").distinct(), "prompt_hash", "left_semi").count()
        new_ppl = prompts.join(lost, "prompt_hash", "left_semi").count() if perplexity else 0
        if new:
            found = source.extract(need)
            if pooling is None:
                self.append("activations", found, source.name)
            else:
                self.append("pooled", P.pool(found, pooling, ["prompt_hash", "layer"]), source.name, pooling=pooling)
        if new_ppl:
            self.append("perplexity", ppl.features(source.losses(lost), lost, "prompt_hash"), source.name)
        need.unpersist(), lost.unpersist()
        out = WarmupStats(total, total - new, new, total - new_ppl if perplexity else 0, new_ppl, time.monotonic() - began)
        log.info("%d prompts, %d extracted, %d perplexities computed", out.total, out.activations_extracted, out.perplexity_extracted)
        return out

    def activations(self, prompts: DataFrame, source: ActivationSource, layers: list[int], pooling: str | None = None) -> DataFrame:
        """Warm up, then the rows of prompts joined with their vectors: prompt_id, layer, (pos,) vec."""
        self.warmup(prompts, source, layers, pooling)
        stored = self.read("activations" if pooling is None else "pooled", source.name).where(F.col("layer").isin(list(layers)))
        if pooling is not None:
            stored = stored.where(F.col("pooling") == pooling)
        return prompts.join(stored, "prompt_hash").select("prompt_id", "layer", *(["pos"] if pooling is None else []), "vec")

    def perplexity(self, prompts: DataFrame, source: ActivationSource) -> DataFrame:
        """prompt_id, mean_ppl, min_ppl, max_ppl."""
        texts = prompts.select("prompt_hash", "text").distinct()
        lost = texts.join(self.read("perplexity", source.name), "prompt_hash", "left_anti").persist()
        if lost.limit(1).count():
            self.append("perplexity", ppl.features(source.losses(lost), lost, "prompt_hash"), source.name)
        lost.unpersist()
        return prompts.join(self.read("perplexity", source.name), "prompt_hash").select("prompt_id", "mean_ppl", "min_ppl", "max_ppl")
