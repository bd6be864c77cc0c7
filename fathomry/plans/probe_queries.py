"""Queries of pooling, scaling, mass-mean scoring, importance and layer operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions import pooling
from ..operators import linear
from ..operators.scaling import LayerScaler
from .tables import TOKEN_SCORES, TOKENS, table, token_vectors, long

KEYS = ["seq_id", "y", "layer"]


def _pooled(spark, sf, strategy="last_token"):
    return pooling.pool(token_vectors(spark, sf), strategy, KEYS)


def _model(spark, sf):
    """Scaler, scaled rows, coefficients and intercept of the last-token mass-mean probe. The scaler's and the model's
    parameters are a row a layer; they and the pooled vectors, which are read three times, are kept."""
    rows = _pooled(spark, sf).persist()
    scaler = LayerScaler("per_neuron").fit(rows)
    scaler.params = scaler.params.persist()
    scaled = scaler.transform(rows)
    coef, intercept = linear.mass_mean(scaled)
    return scaler, scaled, coef.persist(), intercept.persist()


def pool_query(strategy):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _pooled(spark, sf, strategy)
        return long(rows, "seq_id", "layer", *(["pos"] if strategy == "all" else []))

    return run


def scale_query(strategy, inverse=False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _pooled(spark, sf)
        scaler = LayerScaler(strategy).fit(rows)
        out = scaler.transform(rows)
        return long(scaler.inverse_transform(out) if inverse else out, "seq_id", "layer")

    return run


def scaler_stats(spark, sf):
    out = LayerScaler("per_neuron").fit(_pooled(spark, sf)).stats()
    return out.select("layer", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def mass_mean_coef(spark, sf):
    _, _, coef, intercept = _model(spark, sf)
    return long(coef.withColumnRenamed("w", "vec"), "layer", value="w").crossJoin(intercept.select(F.round("intercept", 6).alias("intercept")))


def _scores(spark, sf):
    _, scaled, coef, intercept = _model(spark, sf)
    return linear.scores(scaled, coef, intercept, ["seq_id", "y"])


def mass_mean_scores(spark, sf):
    s = F.col("s")
    return _scores(spark, sf).select("seq_id", "y", F.round(s, 6).alias("score"), F.round(1 - linear.sigmoid(s), 6).alias("p0"), F.round(linear.sigmoid(s), 6).alias("p1"), linear.decide(s).alias("pred"))


def mass_mean_accuracy(spark, sf):
    out = linear.accuracy(_scores(spark, sf).withColumn("pred", linear.decide(F.col("s"))))
    return out.select(F.round("accuracy", 6).alias("accuracy"))


def _token_scores(spark, sf):
    scaler, _, coef, intercept = _model(spark, sf)
    tokens = scaler.transform(token_vectors(spark, sf))
    return linear.scores(tokens, coef, intercept, ["seq_id", "pos", "y"])


def token_scores(spark, sf):
    return _token_scores(spark, sf).select("seq_id", "pos", F.round("s", 6).alias("score"), F.round(linear.sigmoid(F.col("s")), 6).alias("p1"))


def score_query(strategy):
    def run(spark, sf):
        p = linear.sigmoid(F.col("s"))
        by_class = _token_scores(spark, sf).select("seq_id", F.posexplode(F.array(1 - p, p)).alias("class", "p"))
        out = pooling.reduce_scores(by_class, strategy, ["seq_id", "class"])
        wide = out.groupBy("seq_id").agg(F.max(F.when(F.col("class") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("class") == 1, F.col("p"))).alias("p1"))
        label = linear.argmax_class(F.array("p0", "p1"), F.array(F.lit(0), F.lit(1)))
        return wide.select("seq_id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), label.alias("pred"))

    return run


def majority_vote_tokens(spark, sf):
    return pooling.majority(_token_scores(spark, sf).select("seq_id", linear.decide(F.col("s")).alias("pred")), ["seq_id"])


def importance_query(metric):
    def run(spark, sf):
        _, _, coef, _ = _model(spark, sf)
        raw, share = linear.importance(coef, metric), linear.importance(coef, metric, normalize=True).withColumnRenamed("value", "share")
        return raw.join(share, "layer").select("layer", F.round("value", 6).alias("value"), F.round("share", 6).alias("share"))

    return run


def fast_auto_topk_layers(spark, sf):
    _, _, coef, _ = _model(spark, sf)
    return linear.top_layers(linear.importance(coef, "l2")).select("layer", F.round("value", 6).alias("value"))


def importance_heatmap(spark, sf):
    """One row, a column a layer: the table under a heat map."""
    _, _, coef, _ = _model(spark, sf)
    wide = linear.importance(coef, "l2", normalize=True).groupBy().pivot("layer", [0, 1, 2, 3]).agg(F.first("value"))
    return wide.select(*[F.round(F.col(f"`{i}`"), 6).alias(f"layer_{i}") for i in range(4)])


def importance_bars(spark, sf):
    """The table under a bar chart: every layer, whether it is selected."""
    _, _, coef, _ = _model(spark, sf)
    values = linear.importance(coef, "l2", normalize=True)
    chosen = linear.top_layers(values).select("layer", F.lit(True).alias("chosen"))
    return values.join(chosen, "layer", "left").select("layer", F.round("value", 6).alias("value"), F.coalesce("chosen", F.lit(False)).alias("selected"))


def layer0_mass_mean(spark, sf):
    rows = _pooled(spark, sf).where("layer = 0")
    coef, intercept = linear.mass_mean(rows)
    return linear.scores(rows, coef, intercept, ["seq_id", "y"]).select("seq_id", F.round("s", 6).alias("score"), linear.decide(F.col("s")).alias("pred"))


def unit_direction(d: int, seed: int = 0) -> np.ndarray:
    u = np.random.RandomState(seed).randn(d)
    return u / np.linalg.norm(u)


def random_direction_scores(spark, sf):
    u = unit_direction(64).reshape(4, 16)
    coef = spark.createDataFrame([(i, u[i].tolist()) for i in range(4)], "layer long, w array<double>")
    zero = spark.createDataFrame([(0.0,)], "intercept double")
    return linear.scores(_pooled(spark, sf), coef, zero, ["seq_id"]).select("seq_id", F.round("s", 6).alias("projection"))


def layer_concat_slice(spark, sf):
    """Layers 1 and 3 sliced out of the concatenation of all, at their places in the slice."""
    pooled = _pooled(spark, sf)
    flat = pooled.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", "vec"))), lambda x: x["vec"])).alias("flat"))
    cut = flat.select("seq_id", F.concat(F.slice("flat", 17, 16), F.slice("flat", 49, 16)).alias("vec"))
    return cut.select("seq_id", F.posexplode("vec").alias("at", "v")).select("seq_id", F.col("at").cast("long").alias("at"), F.round("v", 6).alias("v"))


def group_lasso_screen(spark, sf):
    """Largest penalty at which each layer can be selected: |X_g' y| / 2n with standardised columns, y = -1 or 1."""
    e = table(spark, sf, "embeddings").where("label in (0, 1)").select(F.col("embedding").cast("array<double>").alias("vec"), F.when(F.col("label") == 0, -1.0).otherwise(1.0).alias("y"))
    stats = e.select("y", F.posexplode("vec").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.sum(F.col("v") * F.col("y")).alias("vy"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    g = (F.col("vy") - F.col("m") * F.col("sy")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return stats.select(F.expr("d div 16").cast("long").alias("layer"), g.alias("g"), "n").groupBy("layer").agg(F.round(F.sqrt(F.sum(F.col("g") ** 2)) / (2 * F.first("n")), 6).alias("alpha_max"))


def resolve_layers_table(spark, sf):
    """Every layer of models of 1 to 32 layers, with the named specifications that it belongs to."""
    n, layer = F.col("n"), F.col("layer")
    grid = spark.range(1, 33).withColumnRenamed("id", "n").withColumn("layer", F.explode(F.sequence(F.lit(0), n - 1)))
    at = {f"q{i}": (layer == L.at_fraction(f, n)) for i, f in enumerate(L.DEFAULT_FRACTIONS)}
    return grid.select("n", "layer", L.in_middle(layer, n).alias("middle"), (layer == n - 1).alias("last"), *[c.alias(k) for k, c in at.items()])


def contrastive_union(spark, sf):
    """Positive and negative prompts as one labelled bag."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    side = lambda v: docs.join(labels.where(F.col("toxic") == v), "doc_id", "left_semi").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.lit(v).alias("label"))
    return side(1).unionByName(side(0))


def conversation_monitor(spark, sf):
    """A score for each turn (shouting: share of capitals), the greatest and the last of each conversation."""
    c = table(spark, sf, "conversations")
    up = F.char_length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.char_length("text"), F.lit(1))
    s = c.select("conv_id", "turn", up.alias("s"))
    return s.groupBy("conv_id").agg(F.round(F.max("s"), 6).alias("max_score"), F.round(F.min("s"), 6).alias("min_score"), F.round(F.max_by("s", "turn"), 6).alias("last_score"), F.count("*").alias("turns"))


QUERIES = {
    "pool_last": pool_query("last_token"), "pool_first": pool_query("first_token"), "pool_mean": pool_query("mean"), "pool_all": pool_query("all"),
    "scale_per_neuron": scale_query("per_neuron"), "scale_per_layer": scale_query("per_layer"), "scale_inverse": scale_query("per_neuron", True), "scaler_stats": scaler_stats,
    "mass_mean_coef": mass_mean_coef, "mass_mean_scores": mass_mean_scores, "mass_mean_accuracy": mass_mean_accuracy,
    "token_scores": token_scores, "score_max": score_query("max"), "score_min": score_query("min"), "majority_vote_tokens": majority_vote_tokens,
    **{f"layer_importance_{m}": importance_query(m) for m in linear.METRICS},
    "fast_auto_topk_layers": fast_auto_topk_layers, "importance_heatmap": importance_heatmap, "importance_bars": importance_bars,
    "layer0_mass_mean": layer0_mass_mean, "random_direction_scores": random_direction_scores, "layer_concat_slice": layer_concat_slice,
    "group_lasso_screen": group_lasso_screen, "resolve_layers_table": resolve_layers_table, "contrastive_union": contrastive_union, "conversation_monitor": conversation_monitor,
}

_U = ", ".join(f"({i // 16}, {i % 16}, {float(v)!r}::double)" for i, v in enumerate(unit_direction(64)))
_IMPORTANCE = {"l2": "sqrt(sum(w * w))", "l1": "sum(abs(w))", "mean_abs": "avg(abs(w))", "max_abs": "max(abs(w))"}
_BY_CLASS = "select seq_id, round(p0, 6) as p0, round(p1, 6) as p1, case when p1 > p0 then 1 else 0 end as pred from (select seq_id, {f}(1 - p) as p0, {f}(p) as p1 from tp group by seq_id)"

SQL = {
    "pool_last": f"with {TOKENS} select seq_id, layer, neuron, round(v, 6) as v from lp",
    "pool_first": f"with {TOKENS} select seq_id, layer, neuron, round(arg_min(v, pos), 6) as v from tl group by all",
    "pool_mean": f"with {TOKENS} select seq_id, layer, neuron, round(avg(v), 6) as v from tl group by all",
    "pool_all": f"with {TOKENS} select seq_id, layer, pos, neuron, round(v, 6) as v from tl",
    "scale_per_neuron": f"with {TOKENS} select seq_id, layer, neuron, round(v, 6) as v from sx",
    "scale_per_layer": f"with {TOKENS}, pl as (select layer, avg(v) as mean, stddev_pop(v) as std from lp group by layer) select seq_id, lp.layer, neuron, round((v - mean) / case when std = 0 then 1 else std end, 6) as v from lp join pl on lp.layer = pl.layer",
    "scale_inverse": f"with {TOKENS} select seq_id, layer, neuron, round(v, 6) as v from lp",
    "scaler_stats": f"with {TOKENS} select layer, round(sqrt(sum(mean * mean)), 6) as mean_norm, round(avg(mean), 6) as mean_mean, round(sqrt(sum(std * std)), 6) as std_norm, round(avg(std), 6) as std_mean from sc group by layer",
    "mass_mean_coef": f"with {TOKENS} select layer, neuron, round(w, 6) as w, round((select b from ic), 6) as intercept from cf",
    "mass_mean_scores": f"with {TOKENS} select seq_id, y, round(s, 6) as score, round(1 - 1 / (1 + exp(-s)), 6) as p0, round(1 / (1 + exp(-s)), 6) as p1, case when s > 0 then 1 else 0 end as pred from ss",
    "mass_mean_accuracy": f"with {TOKENS} select round(avg(case when (s > 0) = (y = 1) then 1.0::double else 0.0::double end), 6) as accuracy from ss",
    "token_scores": f"with {TOKEN_SCORES} select seq_id, pos, round(s, 6) as score, round(p, 6) as p1 from tp",
    "score_max": f"with {TOKEN_SCORES} " + _BY_CLASS.format(f="max"),
    "score_min": f"with {TOKEN_SCORES} " + _BY_CLASS.format(f="min"),
    "majority_vote_tokens": f"with {TOKEN_SCORES} select seq_id, case when count(*) filter (where s > 0) > count(*) filter (where not s > 0) then 1 else 0 end as pred from tp group by seq_id",
    **{f"layer_importance_{m}": f"with {TOKENS}, im as (select layer, {e} as value from cf group by layer) select layer, round(value, 6) as value, round(value / sum(value) over (), 6) as share from im" for m, e in _IMPORTANCE.items()},
    "fast_auto_topk_layers": f"with {TOKENS}, im as (select layer, sqrt(sum(w * w)) as value from cf group by layer) select layer, round(value, 6) as value from im qualify row_number() over (order by value desc, layer desc) <= 2",
    "importance_heatmap": f"with {TOKENS}, im as (select layer, sqrt(sum(w * w)) as v from cf group by layer), sh as (select layer, v / sum(v) over () as v from im) select " + ", ".join(f"round(max(case when layer = {i} then v end), 6) as layer_{i}" for i in range(4)) + " from sh",
    "importance_bars": f"with {TOKENS}, im as (select layer, sqrt(sum(w * w)) as v from cf group by layer) select layer, round(v / sum(v) over (), 6) as value, row_number() over (order by v desc, layer desc) <= 2 as selected from im",
    "layer0_mass_mean": f"with {TOKENS}, m as (select neuron, avg(v) filter (where y = 1) as m1, avg(v) filter (where y = 0) as m0 from lp where layer = 0 group by neuron), c as (select neuron, m1, m0, (m1 - m0) / sqrt(sum((m1 - m0) * (m1 - m0)) over ()) as w from m), s as (select seq_id, sum(v * w) - (select sum((m1 + m0) * w) / 2 from c) as s from lp join c on lp.neuron = c.neuron where layer = 0 group by seq_id) select seq_id, round(s, 6) as score, case when s > 0 then 1 else 0 end as pred from s",
    "random_direction_scores": f"with {TOKENS}, u(layer, neuron, w) as (values {_U}) select seq_id, round(sum(v * w), 6) as projection from lp join u on lp.layer = u.layer and lp.neuron = u.neuron group by seq_id",
    "layer_concat_slice": f"with {TOKENS} select seq_id, neuron + case when layer = 3 then 16 else 0 end as at, round(v, 6) as v from lp where layer in (1, 3)",
    "group_lasso_screen": "with e as (select vec_id, case when label = 0 then -1.0::double else 1.0::double end as y, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings where label in (0, 1)), c as (select d, (sum(v * y) - avg(v) * sum(y)) / case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as g, count(*) as n from e group by d) select d // 16 as layer, round(sqrt(sum(g * g)) / (2 * any_value(n)), 6) as alpha_max from c group by all",
    "resolve_layers_table": "with g as (select n, unnest(range(n)) as layer from (select unnest(range(1, 33)) as n)) select n, layer, layer >= n // 3 and layer < n - n // 3 as middle, layer = n - 1 as last, " + ", ".join(f"layer = floor({f}::double * (n - 1))::bigint as q{i}" for i, f in enumerate(L.DEFAULT_FRACTIONS)) + " from g",
    "contrastive_union": "select d.doc_id, length(text) as chars, toxic as label from documents d join labels l on d.doc_id = l.doc_id where toxic in (0, 1)",
    "conversation_monitor": "with s as (select conv_id, turn, length(regexp_replace(text, '[^A-Z]', '', 'g'))::double / greatest(length(text), 1) as s from conversations) select conv_id, round(max(s), 6) as max_score, round(min(s), 6) as min_score, round(arg_max(s, turn), 6) as last_score, count(*) as turns from s group by conv_id",
}
