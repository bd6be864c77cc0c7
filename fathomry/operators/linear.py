"""Linear scores, decisions, importances: rows (keys, layer, vec) against coefficients (layer, w array)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("l2", "l1", "mean_abs", "max_abs")


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def constant(values) -> Column:
    """An array of numbers as one foldable expression: a literal for each number is slow to build at thousands of them."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def vector_dot(x: Column, w: Column) -> Column:
    """The product of an MLlib vector, sparse or dense, with an array."""
    v = F.unwrap_udt(x)
    cells = F.zip_with(v["indices"], v["values"], lambda i, a: a * F.get(w, i))
    return F.when(v["type"] == 0, F.aggregate(cells, F.lit(0.0), lambda s, a: s + a)).otherwise(dot(v["values"], w))


def sigmoid(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def decide(score: Column) -> Column:
    """1 above 0; a score of exactly 0 is class 0."""
    return F.when(score > 0, 1).otherwise(0)


def argmax_class(p: Column, classes: Column) -> Column:
    """The class of the greatest probability; the first of equals."""
    return F.element_at(classes, F.array_position(p, F.array_max(p)).cast("int"))


def scores(rows: DataFrame, coef: DataFrame, intercept: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s: sums over layers of dot products, plus the intercept. coef has a row a layer and is broadcast."""
    partial = rows.join(F.broadcast(coef), "layer").select(*keys, dot(F.col("vec"), F.col("w")).alias("part"))
    total = partial.groupBy(*keys).agg(F.sum("part").alias("s"))
    return total.crossJoin(F.broadcast(intercept)).select(*keys, (F.col("s") + F.col("intercept")).alias("s"))


def mass_mean(rows: DataFrame, label: str = "y") -> tuple[DataFrame, DataFrame]:
    """coef (layer, w) and intercept (one row) of the difference of class means; labels are 0 and 1."""
    vec = array_to_vector(F.col("vec").cast("array<double>"))
    sums = rows.where(F.col(label).isin(0, 1) & F.col("vec").isNotNull()).groupBy("layer", label).agg(vector_to_array(Summarizer.mean(vec)).alias("m"))
    both = sums.groupBy("layer").agg(*[F.max(F.when(F.col(label) == c, F.col("m"))).alias(f"m{c}") for c in (1, 0)])
    pairs = F.arrays_zip(F.coalesce("m1", F.transform("m0", lambda x: F.lit(None).cast("double"))).alias("m1"), F.coalesce("m0", F.transform("m1", lambda x: F.lit(None).cast("double"))).alias("m0"))
    means = both.select("layer", F.posexplode(pairs).alias("neuron", "m")).select("layer", "neuron", "m.*")
    norm = F.sqrt(F.sum((F.col("m1") - F.col("m0")) ** 2).over(Window.partitionBy()))  # one row a neuron: the model's size, not the data's
    theta = F.when(norm == 0, F.lit(0.0)).otherwise((F.col("m1") - F.col("m0")) / norm)
    w = means.withColumn("w", theta)
    coef = w.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("neuron", "w"))), lambda x: x["w"]).alias("w"))
    return coef, w.agg((-F.sum((F.col("m1") + F.col("m0")) * F.col("w")) / 2).alias("intercept"))


def importance(coef: DataFrame, metric: str = "l2", normalize: bool = False) -> DataFrame:
    """layer, value of a metric over each layer's coefficients; normalize: summing to 1 unless all are 0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    add = lambda f: F.aggregate("w", F.lit(0.0), lambda s, x: s + f(x))
    value = {"l2": F.sqrt(add(lambda x: x * x)), "l1": add(F.abs), "mean_abs": add(F.abs) / F.size("w"), "max_abs": F.array_max(F.transform("w", F.abs))}[metric]
    out = coef.select("layer", value.alias("value"))
    if normalize:
        total = F.sum("value").over(Window.partitionBy())
        out = out.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.col("value")))
    return out


def top_layers(values: DataFrame, k: int | None = None) -> DataFrame:
    """The k most important layers (default: half of them, 1 at least; ties: the later layer), in layer order."""
    if k is not None and k < 1:
        raise ValueError("k is 1 at least")
    n = values.select(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("value"), F.desc("layer")))
    limit = F.least(F.lit(k), F.col("n")) if k is not None else F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    return values.withColumn("r", rank).crossJoin(F.broadcast(n)).where(F.col("r") <= limit).select("layer", "value").orderBy("layer")


def accuracy(rows: DataFrame, pred: str = "pred", label: str = "y") -> DataFrame:
    return rows.agg(F.avg(F.when(F.col(pred) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))
