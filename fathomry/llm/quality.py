"""Quality rules: robust multivariate outliers by minimum covariance determinants, per language and source.

Four statistics of each whole text, shrunk towards a usual value so that short texts aren't outliers by chance, and
transformed: logit of the share of symbols, logit of the share of capitals, logarithm of the mean word length, square
root of the share of repeated word 4-grams. For each group a minimum covariance determinant over SUBSET of its rows:
three deterministic starts (median deviations alone, and with the correlations of spatial signs and of hyperbolic
tangents), two concentration steps from each, the start of the least determinant goes on for STEPS more, and a
reweighting step over rows within the 0.975 quantile ends it, its covariance corrected for the cut tails. A text is
rejected if its squared Mahalanobis distance exceeds the chi-square quantile at 1 - 1e-11: so far out that among a
hundred thousand million Gaussian rows one is expected, since what is rejected is lost. (FLOOR, added to the deviations
so that constant statistics don't make the covariance singular, makes the rate lower still.)

All steps run over all rows: a step is one aggregation of moments by group and by a fine bin of the distance, so the
rows never move, the subset's border is the bin's edge, and the result doesn't depend on partitioning. Groups of
fewer than `min_group` rows (a covariance of four statistics needs so many) are pooled by language, and what is still
fewer over all.

Null languages and sources are groups of their own. Texts without visible characters (null, empty, blank) are
rejected. Very long texts are measured whole. A distance equal to the cut is kept. Repeated rows count each. An empty
table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import VISIBLE, WORD, Words, segmented_sum, shingles, slices
from .runtime import IDENTITY, Scratch, identity, ship, source_folder, spread, table, without

STATS = ["symbols", "capitals", "word_length", "repetition"]
FLOOR = np.array([0.05, 0.05, 0.02, 0.05])
SUBSET, STEPS, MIN_GROUP = 0.75, 4, 100
STARTS = 3
#: Quantiles of the chi-square distribution with four degrees of freedom: median, 0.975, 1 - 1e-11.
MEDIAN4, REWEIGHT4, CUT4 = 3.3567, 11.1433, 57.45
#: A covariance of the rows within REWEIGHT4 is too small by this: 0.975 over the chi-square probability with six degrees of freedom.
CONSISTENT = 0.975 / 0.915956
_CAPITAL = np.array([65 <= i < 91 for i in range(256)])
_P = len(STATS)
_BIN = 32.0


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = Words(batch.column("text"), VISIBLE, lower=False)
        raw, off = w.raw, w.off
        before = np.concatenate([[0], raw[:-1]]) if len(raw) else raw
        capital = _CAPITAL[raw] | ((before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E))
        visible = segmented_sum(VISIBLE[raw], off)
        share = lambda n, usual: (n + 400 * usual) / (visible + 400)
        logit = lambda p: np.log(p / (1 - p))
        s, n = shingles(w.hashes(), w.count, 4)
        order = np.lexsort((s, np.repeat(np.arange(len(n)), n)))
        row = np.repeat(np.arange(len(n)), n)[order]
        same = (row[1:] == row[:-1]) & (s[order][1:] == s[order][:-1])
        repeated = np.bincount(row[1:][same], minlength=len(n)) if len(row) else np.zeros(len(n))
        x = [
            logit(share(segmented_sum(VISIBLE[raw] & ~WORD[raw], off), 0.03)),
            logit(share(segmented_sum(capital, off), 0.02)),
            np.log((visible + 400) / (w.count + 80)),
            np.sqrt(repeated / (n + 50.0)),
        ]
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(w.count), *map(pa.array, x)], [*kept.schema.names, "n_words", *STATS])


def _deviation(i: int) -> Column:
    return F.col(STATS[i]) - F.col("mu")[i]


def _distance() -> Column:
    terms = [F.col("inv")[i * _P + j] * _deviation(i) * _deviation(j) * (1 if i == j else 2) for i in range(_P) for j in range(i, _P)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


_PARAMS = "grp string, start int, mu array<double>, inv array<double>, det double"


def _params(grp, start, mu, cov) -> dict:
    return {"grp": grp, "start": int(start), "mu": mu.tolist(), "inv": np.linalg.inv(cov).ravel().tolist(), "det": float(np.linalg.slogdet(cov)[1])}


def center(bins: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations from a histogram (grp, k, bin, n) of one group."""
    mu, sd = np.zeros(_P), np.zeros(_P)
    for k, part in bins.groupby("k"):
        v, n = part["bin"].to_numpy() * 0.005, part["n"].to_numpy()
        half = n.sum() / 2
        o = np.argsort(v, kind="stable")
        mu[k] = v[o][np.searchsorted(np.cumsum(n[o]), half)]
        d = abs(v - mu[k])
        o = np.argsort(d, kind="stable")
        sd[k] = 1.4826 * d[o][np.searchsorted(np.cumsum(n[o]), half)]
    return pd.DataFrame([{"grp": bins["grp"].iloc[0], "mu": mu, "sd": np.maximum(sd, FLOOR)}])


def begin(m: pd.DataFrame) -> pd.DataFrame:
    """The starts of one group, from mu, sd and the sums of products of signs (u) and tangents (t)."""
    row = m.iloc[0]
    mu, sd, out = np.array(row["mu"]), np.array(row["sd"]), []
    for k, kind in enumerate(["", "u", "t"]):
        r = np.eye(_P)
        if kind:
            for i in range(_P):
                for j in range(i, _P):
                    r[i, j] = r[j, i] = row[f"{kind}{i}_{j}"]
            d = np.sqrt(np.maximum(np.diag(r), 1e-12))
            r = 0.95 * r / np.outer(d, d) + 0.05 * np.eye(_P)
            r[np.diag_indices(_P)] = 1.0
        out.append(_params(row["grp"], k, mu, r * np.outer(sd, sd)))
    return pd.DataFrame(out)


def concentrate(share: float | None):
    """A step from moments (by bin of the distance) of one group and start to the next estimate: over the nearest share of rows; None: reweighting."""

    def step(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("bin")
        n = m["n"].to_numpy()
        upper = np.exp2((m["bin"].to_numpy() + 1) / _BIN)
        if share is None:
            take = upper <= REWEIGHT4 * max(upper[np.searchsorted(np.cumsum(n), n.sum() / 2)] / MEDIAN4, 1e-9)
            if not take.any():
                take[0] = True
        else:
            take = np.arange(len(n)) <= np.searchsorted(np.cumsum(n), share * n.sum())
        total = n[take].sum()
        first = np.array([m[f"s{i}"].to_numpy()[take].sum() for i in range(_P)]) / total
        cov = np.zeros((_P, _P))
        for i in range(_P):
            for j in range(i, _P):
                cov[i, j] = cov[j, i] = m[f"s{i}_{j}"].to_numpy()[take].sum() / total - first[i] * first[j]
        cov = cov * (CONSISTENT if share is None else 1.0) + np.diag(FLOOR**2)
        return pd.DataFrame([_params(m["grp"].iloc[0], m["start"].iloc[0], np.array(m["mu"].iloc[0]) + first, cov)])

    return step


def distances(spark: SparkSession, docs: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, str, Scratch]:
    """One row for each document: me, grp, statistics, d2, keep; and the path read."""
    ship(spark)
    scratch = Scratch(spark)
    path = source_folder(docs, scratch)
    scan = spark.read.parquet(path)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = scan.select("text", identity(scan).alias("me"), key("lang").alias("lang_key"), key("source").alias("source_key"))
    kinds = f"me {IDENTITY}, lang_key string, source_key string, n_words long, " + ", ".join(f"{s} double" for s in STATS)
    rows = scratch.write(spread(rows).mapInArrow(statistics, kinds), "statistics")
    sizes = rows.where("n_words > 0").groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < min_group).groupBy("lang_key").agg(F.sum("n").alias("pooled"))
    grp = F.when(F.col("n") >= min_group, F.concat_ws(" ", "lang_key", "source_key")).when(F.col("pooled") >= min_group, F.concat_ws(" ", "lang_key", F.lit("*"))).otherwise(F.lit("*"))
    names = scratch.write(sizes.join(small, "lang_key", "left").select("lang_key", "source_key", grp.alias("grp")), "groups")
    rows = rows.join(names, ["lang_key", "source_key"], "left").select("me", "grp", "n_words", *STATS)
    used = rows.where("n_words > 0")
    pairs = [(i, j) for i in range(_P) for j in range(i, _P)]
    bins = used.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(s) / 0.005).cast("long").alias("bin")) for k, s in enumerate(STATS)])).alias("b")).groupBy("grp", "b.k", "b.bin").agg(F.count("*").alias("n"))
    middle = scratch.write(bins.groupBy("grp").applyInPandas(center, "grp string, mu array<double>, sd array<double>"), "centers")
    z = [_deviation(i) / F.col("sd")[i] for i in range(_P)]
    far = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    shaped = used.join(middle, "grp").select("grp", "mu", "sd", *[(x / far).alias(f"u{i}") for i, x in enumerate(z)], *[F.tanh(x).alias(f"t{i}") for i, x in enumerate(z)])
    products = [F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}_{j}") for k in "ut" for i, j in pairs]
    params = scratch.write(shaped.groupBy("grp").agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"), *products).groupBy("grp").applyInPandas(begin, _PARAMS), "params")
    sums = [F.sum(_deviation(i)).alias(f"s{i}") for i in range(_P)] + [F.sum(_deviation(i) * _deviation(j)).alias(f"s{i}_{j}") for i, j in pairs]
    for k, share in enumerate([SUBSET] * (2 + STEPS) + [None]):
        near = used.join(params, "grp").withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * _BIN).cast("long"))
        moments = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), F.first("mu").alias("mu"), *sums)
        found = moments.groupBy("grp", "start").applyInPandas(concentrate(share), _PARAMS)
        if k == 1:  # one of the starts goes on
            found = found.groupBy("grp").agg(F.min_by(F.struct("start", "mu", "inv", "det"), F.struct("det", "start")).alias("p")).select("grp", "p.*")
        params = scratch.write(found, "params")
    out = rows.join(params, "grp", "left").select("me", "grp", "n_words", *STATS, _distance().alias("d2"))
    return out.withColumn("keep", F.coalesce((F.col("n_words") > 0) & (F.col("d2") <= CUT4), F.lit(False))), path, scratch


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their statistics and squared distance from their group."""
    out, _, _ = distances(spark, table(spark, sf_dir, "documents"))
    return out.where("keep").select(F.col("me.doc_id").alias("doc_id"), "grp", *[F.round(s, 6).alias(s) for s in STATS], F.round("d2", 6).alias("d2"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the rejected ones."""
    out, path, scratch = distances(spark, docs)
    return without(spark, docs, path, out.where("not keep").select("me.file", "me.row"), scratch)
