"""Baselines for probes: text features or simple uses of activations with the same classifiers, and the battery that compares them."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layers as L
from ..functions import text as X
from ..sources.activations import ActivationSource
from . import estimators as E
from .probe import LinearProbe

TEXT_METHODS = ("bow", "tfidf", "random", "majority", "sentence_length", "sentence_transformers", "perplexity")
ACTIVATION_METHODS = ("random_direction", "pca", "layer_0")


class BaselineProbe:
    """Fits on prompts (prompt_id, text, label). Vocabulary and document frequencies are frozen at fitting; unseen terms are dropped.

    `embed` gives an array<float> column of a text column, for sentence_transformers; `source` gives token losses for perplexity.
    """

    def __init__(self, method: str, classifier="logistic_regression", random_state: int | None = None, max_features: int = 10_000, ngram_range: tuple[int, int] = (1, 1), source: ActivationSource | None = None, embed: Callable[[Column], Column] | None = None):
        if method not in TEXT_METHODS:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(TEXT_METHODS)}")
        if method == "perplexity" and source is None:
            raise ValueError("perplexity needs a source of token losses")
        self.method, self.max_features, self.ngram_range, self.source, self.embed = method, max_features, ngram_range, source, embed
        dummy = {"random": "uniform", "majority": "most_frequent"}.get(method)
        self.estimator = E.Dummy(strategy=dummy, random_state=random_state) if dummy else E.build(classifier, random_state)
        self.model_ = self.vocab_ = None

    def _features(self, prompts: DataFrame, fitting: bool) -> DataFrame:
        """prompt_id, features."""
        if self.method in ("random", "majority"):
            return prompts.select("prompt_id", F.array(F.lit(0.0)).alias("features"))
        if self.method == "sentence_length":
            f = X.length_features(prompts)
            return f.select("prompt_id", F.array(F.col("char_count").cast("double"), F.col("word_count").cast("double"), "avg_word_length").alias("features"))
        if self.method == "sentence_transformers":
            if self.embed is None:
                raise ImportError("sentence_transformers needs an embed function")
            return prompts.select("prompt_id", self.embed(F.col("text")).cast("array<double>").alias("features"))
        if self.method == "perplexity":
            from ..sources.activations import with_hash
            from . import perplexity as ppl

            p = with_hash(prompts)
            f = ppl.features(self.source.losses(p), p.select("prompt_hash").distinct(), "prompt_hash")
            return p.join(f, "prompt_hash").select("prompt_id", F.array("mean_ppl", "min_ppl", "max_ppl").alias("features"))
        words = prompts.select("prompt_id", F.coalesce(X.ngrams(X.tokens(F.col("text")), *self.ngram_range), F.array().cast("array<string>")).alias("terms"))
        if fitting:
            n = prompts.count()
            rows = X.top_terms(X.term_sums(prompts, *self.ngram_range, key="prompt_id"), self.max_features).collect()  # max_features rows at most
            terms = sorted((r["term"], r["df"]) for r in rows)
            if not terms:
                raise ValueError("the prompts have no terms")
            self.vocab_ = self.terms_ = [t for t, _ in terms]
            self.idf_ = [float(np.log((1 + n) / (1 + df)) + 1) for _, df in terms]
        out = CountVectorizerModel.from_vocabulary(self.terms_, inputCol="terms", outputCol="counts").transform(words)
        if self.method == "bow":
            return out.select("prompt_id", F.col("counts").alias("features"))
        out = ElementwiseProduct(scalingVec=Vectors.dense(self.idf_), inputCol="counts", outputCol="weights").transform(out)
        return Normalizer(p=2.0, inputCol="weights", outputCol="features").transform(out).select("prompt_id", "features")

    def fit(self, prompts: DataFrame) -> BaselineProbe:
        rows = self._features(prompts, True).join(prompts.select("prompt_id", "label"), "prompt_id").persist()
        self.model_ = self.estimator.clone().fit(rows)
        rows.unpersist()
        return self

    def _check(self) -> None:
        if self.model_ is None:
            raise E.NotFitted("the baseline has not been fitted")

    def predict(self, prompts: DataFrame) -> DataFrame:
        self._check()
        return self.model_.predict(self._features(prompts, False)).select("prompt_id", "pred")

    def predict_proba(self, prompts: DataFrame) -> DataFrame:
        self._check()
        return self.model_.predict_proba(self._features(prompts, False)).select("prompt_id", "proba")

    def score(self, prompts: DataFrame) -> float:
        return accuracy(prompts.select("prompt_id", "label").join(self.predict(prompts), "prompt_id"))

    def feature_names(self) -> list[str] | None:
        self._check()
        return list(self.terms_) if self.vocab_ is not None else None

    def top_features(self, n: int = 20) -> dict[str, list[tuple[str, float]]] | None:
        """The terms of the n greatest and the n least coefficients; None without a vocabulary or coefficients."""
        names = self.feature_names()
        if names is None or not np.asarray(self.model_.coef_).size:
            return None
        w = np.asarray(self.model_.coef_)[0]
        o = np.argsort(w, kind="stable")
        return {"positive": [(names[i], float(w[i])) for i in o[::-1][:n]], "negative": [(names[i], float(w[i])) for i in o[:n]]}


class ActivationBaseline:
    """One random direction, principal components, or the first layer alone, of pooled activations."""

    def __init__(self, method: str, source: ActivationSource, cache=None, layers="middle", pooling: str = "last_token", classifier="logistic_regression", random_state: int | None = 0, n_components: int = 10):
        if method not in ACTIVATION_METHODS:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(ACTIVATION_METHODS)}")
        if pooling not in ("last_token", "first_token", "mean"):
            raise ValueError(f"a baseline needs one vector a prompt; pooling {pooling!r} gives many")
        self.method, self.seed, self.n_components = method, random_state, n_components
        self.layers = [0] if method == "layer_0" else L.resolve(layers, source.num_layers())
        self.probe = LinearProbe(source, cache, layers=self.layers, pooling=pooling, normalize_layers=False)
        self.pooling, self.estimator, self.model_ = pooling, E.build(classifier, random_state), None

    def _features(self, prompts: DataFrame, fitting: bool) -> DataFrame:
        rows = self.probe._features(self.probe._vectors(prompts, self.layers, self.pooling))
        if self.method == "random_direction":
            if fitting:
                u = np.random.RandomState(self.seed).randn(len(rows.first()["features"]))
                self.direction_ = u / np.linalg.norm(u)
            from .linear import constant, dot

            return rows.select("prompt_id", F.array(dot(F.col("features"), constant(self.direction_))).alias("features"))
        if self.method == "pca":
            if fitting:
                self.pca_ = E.PCA(self.n_components).fit(rows)
            return self.pca_.transform(rows)
        return rows

    fit, _check, predict, predict_proba, score = BaselineProbe.fit, BaselineProbe._check, BaselineProbe.predict, BaselineProbe.predict_proba, BaselineProbe.score


def accuracy(pairs: DataFrame) -> float:
    return pairs.agg(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0))).first()[0]


#: name -> (class, arguments, needs activations or losses)
REGISTRY = {m: (BaselineProbe, {"method": m}, m == "perplexity") for m in ("bow", "tfidf", "random", "majority", "sentence_length", "sentence_transformers", "perplexity")} | {m: (ActivationBaseline, {"method": m}, True) for m in ACTIVATION_METHODS}


@dataclass
class BaselineResult:
    name: str
    score: float
    baseline: object
    fit_time: float
    predict_time: float


class BaselineResults(list):
    """Results by score, the best first (ties keep the registry's order); indexed by place or by name."""

    def __init__(self, results):
        super().__init__(sorted(results, key=lambda r: -r.score))

    def __getitem__(self, key):
        if isinstance(key, str):
            for r in self:
                if r.name == key:
                    return r
            raise KeyError(f"{key!r}; there are {', '.join(r.name for r in self)}")
        return super().__getitem__(key)

    def get_best(self, n: int = 1) -> list[BaselineResult]:
        return self[:n]

    def best(self) -> BaselineResult:
        return self[0]

    def summary(self) -> str:
        return "\n".join(f"  {r.name:<30} {r.score:.4f}  (fit: {r.fit_time:.2f}s, predict: {r.predict_time:.2f}s)" for r in self)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(r.name, float(r.score), r.fit_time, r.predict_time) for r in self], "name string, score double, fit_time double, predict_time double")


class BaselineBattery:
    """Fits the baselines that apply; what fails is reported and left out. scorer: (prompt_id, label, pred) rows -> a number."""

    def __init__(self, source: ActivationSource | None = None, cache=None, include=None, exclude=None, classifier="logistic_regression", random_state: int | None = 0, scorer: Callable[[DataFrame], float] = accuracy, **options):
        for n in [*(include or []), *(exclude or [])]:
            if n not in REGISTRY:
                raise ValueError(f"unknown baseline {n!r}; one of {', '.join(REGISTRY)}")
        self.source, self.cache, self.include, self.exclude = source, cache, include, exclude or []
        self.classifier, self.random_state, self.scorer, self.options, self.results_ = classifier, random_state, scorer, options, None

    def available(self) -> list[str]:
        return list(REGISTRY)

    def applicable(self) -> list[str]:
        return [n for n, (_, _, needs) in REGISTRY.items() if (self.source is not None or not needs) and (self.include is None or n in self.include) and n not in self.exclude]

    def _make(self, name: str):
        kind, args, _ = REGISTRY[name]
        args = args | {"classifier": self.classifier, "random_state": self.random_state} | self.options.get(name, {})
        return kind(source=self.source, cache=self.cache, **args) if kind is ActivationBaseline else kind(source=self.source, **args)

    def fit(self, prompts: DataFrame, test: DataFrame | None = None) -> BaselineResults:
        if test is not None and "label" not in test.columns:
            raise ValueError("test prompts need a label column")
        test = prompts if test is None else test
        found = []
        for name in self.applicable():
            try:
                b = self._make(name)
                t0 = time.monotonic()
                b.fit(prompts)
                t1 = time.monotonic()
                pairs = test.select("prompt_id", "label").join(b.predict(test), "prompt_id").persist()
                pairs.count()
                t2 = time.monotonic()
                found.append(BaselineResult(name, self.scorer(pairs), b, t1 - t0, t2 - t1))
                pairs.unpersist()
            except Exception as e:  # one baseline's failure doesn't stop the others
                warnings.warn(f"baseline {name} failed: {e}", stacklevel=2)
        self.results_ = BaselineResults(found)
        return self.results_

    def _check(self):
        if self.results_ is None:
            raise E.NotFitted("the battery has not been fitted")
        return self.results_

    def get_best(self, n: int = 1) -> list[BaselineResult]:
        return self._check().get_best(n)

    def get_baseline(self, name: str):
        return self._check()[name].baseline
