"""Queries of text features, vocabularies, perplexity, cache planning and closed-form baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import perplexity as ppl
from ..sources import cache
from .tables import table

TOP = 10_000
#: perplexity_unigram: the most terms whose losses are in a table of each worker.
FREQUENT = 400_000


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _vocabulary(spark, sf, low=1, high=1):
    return X.top_terms(X.term_sums(_docs(spark, sf), low, high, key="doc_id"), TOP)


def doc_length_features(spark: SparkSession, sf: str) -> DataFrame:
    out = X.length_features(_docs(spark, sf))
    return out.select("doc_id", "char_count", "word_count", F.round("avg_word_length", 6).alias("avg_word_length"))


def bow_vocab_topk(spark, sf):
    return _vocabulary(spark, sf).select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("idx"), "ctf", "df")


def bow_counts(spark, sf):
    counts = X.term_counts(_docs(spark, sf))
    return counts.join(F.broadcast(_vocabulary(spark, sf).select("term")), "term").select("doc_id", "term", "tf")  # TOP rows


def bigram_vocab(spark, sf):
    return _vocabulary(spark, sf, 1, 2)


def tfidf_weights(spark, sf):
    docs, counts = _docs(spark, sf), X.term_counts(_docs(spark, sf))
    n = docs.agg(F.count("*").alias("n_docs"))
    vocab = _vocabulary(spark, sf).crossJoin(F.broadcast(n))
    raw = counts.join(F.broadcast(vocab), "term").select("doc_id", "term", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", F.round(F.col("w") / norm, 6).alias("weight"))


def top_class_terms(spark, sf):
    """The 20 terms of the greatest and of the least difference of class means of counts (toxic against clean)."""
    labels = table(spark, sf, "labels").where("toxic in (0, 1)").select("doc_id", "toxic")
    sums = X.term_sums(_docs(spark, sf).join(labels, "doc_id"), by="toxic", df=False)
    by_class = [F.sum(F.when(F.col("toxic") == c, F.col("ctf")).otherwise(0)).alias(f"t{c}") for c in (1, 0)]
    top = sums.groupBy("term").agg(*by_class).orderBy(F.desc(F.col("t1") + F.col("t0")), "term").limit(TOP)
    n = labels.join(_docs(spark, sf), "doc_id", "left_semi").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    w = top.crossJoin(F.broadcast(n)).select("term", F.round(F.col("t1") / F.col("n1") - F.col("t0") / F.col("n0"), 6).alias("weight")).persist()  # TOP rows, used twice
    best = w.orderBy(F.desc("weight"), "term").limit(20).withColumn("side", F.lit("positive"))
    return best.unionByName(w.orderBy("weight", "term").limit(20).withColumn("side", F.lit("negative")))


def majority_baseline(spark, sf):
    """Every document with the most frequent label (ties: the lowest)."""
    labels = table(spark, sf, "labels")
    top = labels.groupBy("quality").count().orderBy(F.desc("count"), "quality").limit(1).select(F.col("quality").alias("pred"))
    return labels.crossJoin(F.broadcast(top)).select("doc_id", "pred")


def perplexity_unigram(spark, sf):
    """exp of the mean, least and greatest token loss under the corpus's unigram model.

    Terms of a share of 1 / FREQUENT at least, FREQUENT at most, are in a table of the workers, which sum them up by text; the others are joined.
    """
    docs = _docs(spark, sf)
    sums = X.term_sums(docs, df=False).select("term", "ctf").persist()
    total = sums.agg(F.sum("ctf")).first()[0] or 0
    loss = sums.select("term", "ctf", (-F.log(F.col("ctf") / F.lit(total).cast("long"))).alias("loss"))
    frequent = loss.where((F.col("ctf") * F.lit(FREQUENT) >= total) & (F.length("term") <= 64)).select("term", "loss").toArrow()
    rows = X.known_losses(docs, dict(zip(*(frequent.column(c).to_pylist() for c in ("term", "loss")))))
    each = rows.join(loss.select("term", "loss"), "term", "left").select("doc_id", F.coalesce("s", F.col("n") * F.col("loss")).alias("s"), "n", F.coalesce("lo", "loss").alias("lo"), F.coalesce("hi", "loss").alias("hi"))
    per = each.groupBy("doc_id").agg((F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", *[F.round(F.coalesce(F.exp(c), F.lit(1.0)), 4).alias(n) for c, n in (("mean", "mean_ppl"), ("lo", "min_ppl"), ("hi", "max_ppl"))])


def _logits(spark, sf):
    """Sequences of eight embeddings as logits over 16 tokens; the target is the label."""
    e = table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 8").alias("prompt_id"), F.expr("vec_id % 8").alias("pos"), F.col("label").alias("token_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("logits"))


def cross_entropy_logits(spark, sf):
    rows = _logits(spark, sf)
    out = ppl.features(ppl.token_losses(rows), rows.select("prompt_id").distinct())
    return out.select("prompt_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def prompt_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", X.short_hash(F.col("text")).alias("prompt_hash"), F.substring(F.sha2("text", 256), 1, 32).alias("long_hash"))


def _cached(spark, sf):
    """Stored (prompt_hash, layer): labelled documents have layer 0, those of quality 1 also layer 1."""
    d, l = _docs(spark, sf), table(spark, sf, "labels")
    rows = d.join(l, "doc_id").select(X.short_hash(F.col("text")).alias("prompt_hash"), F.explode(F.when(F.col("quality") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("layer"))
    return rows.distinct()


def _prompts(spark, sf):
    return _docs(spark, sf).withColumn("prompt_hash", X.short_hash(F.col("text")))


def cache_hits(spark, sf):
    return cache.hits(_prompts(spark, sf), _cached(spark, sf), [0, 1]).select("doc_id", "prompt_hash")


def cache_misses(spark, sf):
    return cache.misses(_prompts(spark, sf), _cached(spark, sf), [0, 1]).select("prompt_hash", F.col("layer").cast("long").alias("layer"))


def cache_partial_layers(spark, sf):
    have = _cached(spark, sf).groupBy("prompt_hash").agg(F.count("*").alias("layers"))
    return have.where("layers < 2")


def warmup_stats(spark, sf):
    prompts = _prompts(spark, sf)
    full = cache.hits(prompts.select("prompt_hash").distinct(), _cached(spark, sf), [0, 1]).withColumn("hit", F.lit(True))
    n = prompts.join(full, "prompt_hash", "left").agg(F.count("*").alias("total"), F.count("hit").alias("cached"))
    return n.select("total", "cached", (F.col("total") - F.col("cached")).alias("extracted"), F.round(F.coalesce(F.try_divide("cached", "total"), F.lit(0.0)), 6).alias("hit_rate"))


def battery_leaderboard(spark, sf):
    """Closed-form baselines on the labelled documents: majority, and length (mass mean in one dimension)."""
    d = X.length_features(_docs(spark, sf)).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("quality", "char_count", "word_count", "avg_word_length").persist()
    m = d.groupBy().agg(F.avg(F.when(F.col("quality") == 1, F.col("word_count"))).alias("m1"), F.avg(F.when(F.col("quality") == 0, F.col("word_count"))).alias("m0"), F.avg(F.when(F.col("quality") == 1, F.col("avg_word_length"))).alias("a1"), F.avg(F.when(F.col("quality") == 0, F.col("avg_word_length"))).alias("a0"), (F.avg("quality") > 0.5).cast("int").alias("mode"))
    side = lambda x, hi, lo: (F.signum(F.col(hi) - F.col(lo)) * (F.col(x) - (F.col(hi) + F.col(lo)) / 2) > 0).cast("int")
    hit = lambda p: F.avg(F.when(p == F.col("quality"), 1.0).otherwise(0.0))
    s = d.crossJoin(F.broadcast(m)).agg(hit(F.col("mode")).alias("majority"), hit(side("word_count", "m1", "m0")).alias("word_count"), hit(side("avg_word_length", "a1", "a0")).alias("word_length"))
    board = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("score")) for n in ("majority", "word_count", "word_length")])).alias("b")).select("b.name", F.round("b.score", 6).alias("score"))
    return board.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("long"))


QUERIES = {f.__name__: f for f in (doc_length_features, bow_vocab_topk, bow_counts, bigram_vocab, tfidf_weights, top_class_terms, majority_baseline, perplexity_unigram, cross_entropy_logits, prompt_hash, cache_hits, cache_misses, cache_partial_layers, warmup_stats, battery_leaderboard)}

_TC = r"""tk as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as ws from documents),
tc as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ws) as term from tk) group by all),
vo as (select term, sum(tf)::bigint as ctf, count(*) as df from tc group by term)"""
_TC2 = _TC.replace("unnest(ws) as term", "unnest(list_concat(ws, case when len(ws) < 2 then [] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end)) as term")
_CACHE = """pr as (select doc_id, sha256(text)[1:16] as prompt_hash from documents),
ca as (select distinct prompt_hash, layer from (select prompt_hash, unnest(case when quality = 1 then [0, 1] else [0] end) as layer from pr join labels on pr.doc_id = labels.doc_id)),
fu as (select prompt_hash from ca group by prompt_hash having count(*) = 2)"""
_LEN = "d as (select quality, array_length(regexp_extract_all(text, '" + X.SPLIT + "')) as words, length(text) as chars from documents join labels using (doc_id)), e as (select quality, words, chars / greatest(words, 1)::double as awl from d), m as (select avg(words) filter (where quality = 1) as m1, avg(words) filter (where quality = 0) as m0, avg(awl) filter (where quality = 1) as a1, avg(awl) filter (where quality = 0) as a0, (avg(quality) > 0.5)::int as mode from e)"

SQL = {
    "doc_length_features": "with d as (select doc_id, length(text) as char_count, array_length(regexp_extract_all(text, '" + X.SPLIT + "')) as word_count from documents) select doc_id, char_count, word_count, round(char_count / greatest(word_count, 1)::double, 6) as avg_word_length from d",
    "bow_vocab_topk": f"with {_TC}, t as (select * from vo order by ctf desc, term limit 10000) select term, row_number() over (order by term) - 1 as idx, ctf, df from t",
    "bow_counts": f"with {_TC}, t as (select term from vo order by ctf desc, term limit {TOP}) select doc_id, tc.term, tf from tc join t on tc.term = t.term",
    "bigram_vocab": f"with {_TC2} select term, ctf, df from vo order by ctf desc, term limit {TOP}",
    "tfidf_weights": f"with {_TC}, t as (select * from vo order by ctf desc, term limit 10000), w as (select doc_id, tc.term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)::double) + 1) as w from tc join t on tc.term = t.term) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w",
    "top_class_terms": f"with {_TC}, l as (select doc_id, toxic from labels where toxic in (0, 1)), c as (select term, tf, toxic from tc join l on tc.doc_id = l.doc_id), v as (select term from c group by term order by sum(tf) desc, term limit {TOP}), n as (select count(*) filter (where toxic = 1) as n1, count(*) filter (where toxic = 0) as n0 from l semi join documents using (doc_id)), w as (select c.term, round(coalesce(sum(tf) filter (where toxic = 1), 0) / (select n1 from n)::double - coalesce(sum(tf) filter (where toxic = 0), 0) / (select n0 from n)::double, 6) as weight from c join v on c.term = v.term group by c.term) select * from (select term, weight, 'positive' as side from w order by weight desc, term limit 20) union all select * from (select term, weight, 'negative' as side from w order by weight, term limit 20)",
    "majority_baseline": "select doc_id, (select quality from labels group by quality order by count(*) desc, quality limit 1) as pred from labels",
    "perplexity_unigram": f"with {_TC}, lo as (select term, -ln(ctf / (select sum(ctf) from vo)::double) as loss from vo), p as (select doc_id, sum(tf * loss) / sum(tf) as mean, min(loss) as lo, max(loss) as hi from tc join lo on tc.term = lo.term group by doc_id) select d.doc_id, round(coalesce(exp(mean), 1), 4) as mean_ppl, round(coalesce(exp(lo), 1), 4) as min_ppl, round(coalesce(exp(hi), 1), 4) as max_ppl from documents d left join p on d.doc_id = p.doc_id",
    "cross_entropy_logits": "with r as (select vec_id // 8 as prompt_id, vec_id, lead(label) over (partition by vec_id // 8 order by vec_id) as target, list_transform(embedding[1:16], lambda x: x::double) as x from embeddings), l as (select prompt_id, ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[target + 1] as loss from r where target is not null), a as (select prompt_id, exp(avg(loss)) as a, exp(min(loss)) as b, exp(max(loss)) as c from l group by prompt_id) select p.prompt_id, round(coalesce(a, 1), 6) as mean_ppl, round(coalesce(b, 1), 6) as min_ppl, round(coalesce(c, 1), 6) as max_ppl from (select distinct prompt_id from r) p left join a on p.prompt_id = a.prompt_id",
    "prompt_hash": "select doc_id, sha256(text)[1:16] as prompt_hash, sha256(text)[1:32] as long_hash from documents",
    "cache_hits": f"with {_CACHE} select doc_id, prompt_hash from pr semi join fu using (prompt_hash)",
    "cache_misses": f"with {_CACHE}, wa as (select distinct prompt_hash, layer from pr, (values (0), (1)) as l(layer)) select prompt_hash, layer::bigint as layer from wa anti join ca using (prompt_hash, layer)",
    "cache_partial_layers": f"with {_CACHE} select prompt_hash, count(*) as layers from ca group by prompt_hash having count(*) < 2",
    "warmup_stats": f"with {_CACHE}, n as (select count(*) as total, count(fu.prompt_hash) as cached from pr left join fu using (prompt_hash)) select total, cached, total - cached as extracted, round(coalesce(cached / nullif(total, 0)::double, 0), 6) as hit_rate from n",
    "battery_leaderboard": f"with {_LEN}, s as (select 'majority' as name, avg((mode = quality)::int) as score from e, m union all select 'word_count', avg(((sign(m1 - m0) * (words - (m1 + m0) / 2) > 0)::int = quality)::int) from e, m union all select 'word_length', avg(((sign(a1 - a0) * (awl - (a1 + a0) / 2) > 0)::int = quality)::int) from e, m) select name, round(score, 6) as score, row_number() over (order by round(score, 6) desc, name) as place from s",
}
