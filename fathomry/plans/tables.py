"""The domain's relations as views of the test tables, in Spark and as common table expressions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_LAYERS, WIDTH, SEQ = 4, 16, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, pos, y, layer, vec of real tokens: eight embeddings are a sequence, 64 dimensions four layers."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("seq_id"), F.expr("vec_id % 8").alias("pos"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.where("pos < 1 + seq_id % 8").withColumn("y", F.expr("seq_id % 2"))
    split = F.transform(F.sequence(F.lit(0), F.lit(N_LAYERS - 1)), lambda i: F.slice("e", i * WIDTH + 1, WIDTH))
    return e.select("seq_id", "pos", "y", F.posexplode(split).alias("layer", "vec")).withColumn("layer", F.col("layer").cast("long"))


def long(rows: DataFrame, *keys: str, value: str = "v", digits: int | None = 6) -> DataFrame:
    """Vectors to rows (keys, neuron, value)."""
    out = rows.select(*keys, F.posexplode("vec").alias("neuron", value)).withColumn("neuron", F.col("neuron").cast("long"))
    return out if digits is None else out.withColumn(value, F.round(value, digits))


TOKENS = """
tl as (select vec_id // 8 as seq_id, vec_id % 8 as pos, (vec_id // 8) % 2 as y, d // 16 as layer, d % 16 as neuron, v
    from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings)
    where vec_id % 8 < 1 + (vec_id // 8) % 8),
lp as (select seq_id, y, layer, neuron, arg_max(v, pos) as v from tl group by all),
sc as (select layer, neuron, avg(v) as mean, case when stddev_pop(v) = 0 then 1.0::double else stddev_pop(v) end as std from lp group by all),
sx as (select seq_id, y, lp.layer, lp.neuron, (v - mean) / std as v from lp join sc on lp.layer = sc.layer and lp.neuron = sc.neuron),
cm as (select layer, neuron, avg(v) filter (where y = 1) as m1, avg(v) filter (where y = 0) as m0 from sx group by all),
cf as (select layer, neuron, m1, m0, (m1 - m0) / sqrt(sum((m1 - m0) * (m1 - m0)) over ()) as w from cm),
ic as (select -sum((m1 + m0) * w) / 2 as b from cf),
ss as (select seq_id, y, sum(v * w) + (select b from ic) as s from sx join cf on sx.layer = cf.layer and sx.neuron = cf.neuron group by all)
"""
TOKEN_SCORES = TOKENS + """,
tx as (select tl.seq_id, pos, tl.y, sum((tl.v - mean) / std * w) + (select b from ic) as s
    from tl join sc on tl.layer = sc.layer and tl.neuron = sc.neuron join cf on tl.layer = cf.layer and tl.neuron = cf.neuron group by all),
tp as (select seq_id, pos, y, s, 1 / (1 + exp(-s)) as p from tx)
"""
