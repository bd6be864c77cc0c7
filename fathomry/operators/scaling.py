"""Standardisation per layer, or per neuron of each layer. Population deviations; a deviation of 0 becomes 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("per_neuron", "per_layer")


def resolve_strategy(normalize) -> str | None:
    """True: per_neuron; False or None: none; or the name of a strategy."""
    if normalize in (False, None):
        return None
    if normalize is True:
        return "per_neuron"
    if normalize in STRATEGIES:
        return normalize
    raise ValueError(f"unknown scaling {normalize!r}; True, False or one of {', '.join(STRATEGIES)}")


class LayerScaler:
    """Fitted on rows (layer, vec); `params` has one row a layer: means and stds (arrays), so that it stays small for broadcasting."""

    def __init__(self, strategy: str = "per_neuron"):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown scaling {strategy!r}")
        self.strategy, self.params = strategy, None

    def fit(self, rows: DataFrame) -> LayerScaler:
        long = rows.select("layer", F.posexplode("vec").alias("neuron", "v"))
        sd = F.stddev_pop("v")
        stats = [F.avg("v").alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("std")]
        refuse = F.raise_error(F.lit("vectors of a layer differ in width")).cast("array<double>")
        # Widths are checked in the same aggregation; vectors that differ raise when the parameters are used.
        if self.strategy == "per_neuron":
            by = long.groupBy("layer", "neuron").agg(*stats, F.count("*").alias("n"))
            by = by.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("neuron", "mean", "std"))).alias("s"), (F.min("n") == F.max("n")).alias("even"))
            stats = by.select("layer", F.when(F.col("even"), F.transform("s", lambda x: x["mean"])).otherwise(refuse).alias("means"), F.transform("s", lambda x: x["std"]).alias("stds"))
        else:
            even = (F.count_if(F.col("neuron") == 0) * (F.max("neuron") + 1) == F.count("*")).alias("even")
            stats = long.groupBy("layer").agg(*stats, even).select("layer", F.when(F.col("even"), F.array("mean")).otherwise(refuse).alias("means"), F.array("std").alias("stds"))
        self.params = stats
        return self

    def _apply(self, rows: DataFrame, change) -> DataFrame:
        if self.params is None:
            raise RuntimeError("the scaler has not been fitted")
        others = [c for c in rows.columns if c != "vec"]
        at = (lambda a, i: F.get(a, i)) if self.strategy == "per_neuron" else (lambda a, i: F.get(a, F.lit(0)))
        wide = F.when(F.size("vec") == F.size("means"), True) if self.strategy == "per_neuron" else F.lit(True)
        joined = rows.join(F.broadcast(self.params), "layer")  # one row a layer
        vec = F.transform("vec", lambda v, i: change(v, at(F.col("means"), i), at(F.col("stds"), i)))
        checked = F.when(wide, vec).otherwise(F.raise_error(F.lit("vector and scaler differ in width")).cast("array<double>"))
        return joined.select(*others, checked.alias("vec"))

    def transform(self, rows: DataFrame) -> DataFrame:
        return self._apply(rows, lambda v, m, s: (v - m) / s)

    def inverse_transform(self, rows: DataFrame) -> DataFrame:
        return self._apply(rows, lambda v, m, s: v * s + m)

    def fit_transform(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).transform(rows)

    def stats(self) -> DataFrame:
        """layer, mean_norm, mean_mean, std_norm, std_mean of the parameters."""
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
        return self.params.select("layer", norm("means").alias("mean_norm"), mean("means").alias("mean_mean"), norm("stds").alias("std_norm"), mean("stds").alias("std_mean"))
