"""Classifiers over rows (prompt_id, features array<double>, label). Data stay distributed; the driver holds d or d x d numbers.

Every fitted model is linear (coefficients by class, intercepts, classes), so that applying it is one expression.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import constant, dot, sigmoid, vector_dot


class NotFitted(RuntimeError):
    pass


def classes_of(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]


def is_vector(rows: DataFrame) -> bool:
    return isinstance(rows.schema["features"].dataType, VectorUDT)


def dense(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", vector_to_array("features")) if is_vector(rows) else rows


def _add(frame):
    import pandas as pd

    total = np.sum([np.frombuffer(m) for m in frame["m"]], axis=0)
    return pd.DataFrame({"i": frame["i"].iloc[:1], "part": [0], "m": [total.tobytes()]})


def moments(rows: DataFrame, target: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum of (1, x, t), and the matrix of their products: partial sums in Arrow batches, added in blocks of about a MB in two rounds."""

    def run(frames):
        import pandas as pd

        total = None
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["features"].to_numpy())
            z = np.concatenate([np.ones((len(x), 1)), x, f["t"].to_numpy()[:, None]], axis=1)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            step = max(1, (1 << 17) // len(total))
            for i in range(0, len(total), step):
                yield pd.DataFrame({"i": [i], "m": [total[i : i + step].tobytes()]})

    schema = "i int, part int, m binary"
    parts = dense(rows).select("features", target.cast("double").alias("t")).mapInPandas(run, "i int, m binary")
    some = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("i", "part").applyInPandas(_add, schema)
    blocks = some.groupBy("i").applyInPandas(_add, schema).select("i", "m").collect()  # d x d numbers
    flat = np.concatenate([np.frombuffer(r["m"]) for r in sorted(blocks, key=lambda r: r["i"])])
    d = int(round(len(flat) ** 0.5))
    m = flat.reshape(d, d)
    return int(m[0, 0]), m[0], m


class Linear:
    """Base: coef_ (k, d), intercept_ (k,), classes_; k is 1 for two classes. proba tells how scores become probabilities."""

    proba: Callable[[list[Column]], list[Column]] | None = None
    has_proba = True
    vector_ = False  # whether the rows at hand have MLlib vectors instead of arrays

    def __init__(self, **params):
        self.params = {k: v for k, v in params.items() if v is not None}
        self.coef_ = None

    def clone(self):
        return type(self)(**self.params)

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params):
        self.params.update(params)
        return self

    def _check(self):
        if self.coef_ is None:
            raise NotFitted(f"{type(self).__name__} has not been fitted")

    def decision(self, features: Column) -> list[Column]:
        self._check()
        out = []
        for w, b in zip(np.atleast_2d(self.coef_), np.atleast_1d(self.intercept_)):
            width = F.unwrap_udt(features)["size"] if self.vector_ else F.size(features)
            width = F.coalesce(width, F.size(F.unwrap_udt(features)["values"])) if self.vector_ else width
            score = (vector_dot if self.vector_ else dot)(features, constant(w)) + F.lit(float(b))
            wrong = F.raise_error(F.lit(f"the model has {len(w)} features, the rows have another number")).cast("double")
            out.append(F.when(width == len(w), score).otherwise(wrong))
        return out

    def probabilities(self, features: Column) -> Column:
        s = self.decision(features)
        if len(s) == 1:
            return F.array(1 - sigmoid(s[0]), sigmoid(s[0]))
        top = F.greatest(*s)
        e = F.array(*[F.exp(x - top) for x in s])
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    def label(self, features: Column) -> Column:
        s = self.decision(features)
        if len(s) == 1:
            return F.when(s[0] > 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0]))
        scores = F.array(*s)
        return F.element_at(F.array(*[F.lit(c) for c in self.classes_]), F.array_position(scores, F.array_max(scores)).cast("int"))

    def predict(self, rows: DataFrame) -> DataFrame:
        self.vector_ = is_vector(rows)
        return rows.withColumn("pred", self.label(F.col("features")))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        if not self.has_proba:
            raise AttributeError(f"{type(self).__name__} has no probabilities")
        self.vector_ = is_vector(rows)
        return rows.withColumn("proba", self.probabilities(F.col("features")))

    def score(self, rows: DataFrame) -> float:
        return self.predict(rows).agg(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0))).first()[0]


def _indexed(rows: DataFrame, classes: list[int]) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    features = F.col("features") if is_vector(rows) else array_to_vector("features")
    return rows.select(features.alias("features"), at.cast("double").alias("label")).persist()


class LogisticRegression(Linear):
    """Minimises sum of log losses + |w|^2 / 2C, intercept free: MLlib with regParam 1 / (n C) and without standardisation."""

    def fit(self, rows: DataFrame) -> LogisticRegression:
        from pyspark.ml.classification import LogisticRegression as Spark

        self.classes_ = classes_of(rows)
        if len(self.classes_) < 2:
            raise ValueError("at least two classes are needed")
        data = _indexed(rows, self.classes_)
        reg = self.params.get("reg", 1.0 / (data.count() * self.params.get("C", 1.0)))
        m = Spark(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=self.params.get("max_iter", 1000), tol=self.params.get("tol", 1e-6 if is_vector(rows) else 1e-10)).fit(data)
        data.unpersist()
        self.coef_, self.intercept_ = m.coefficientMatrix.toArray(), np.asarray(m.interceptVector.toArray())
        return self


class SGD(LogisticRegression):
    """Log loss with penalty alpha, as one full-batch problem: the optimum that shuffled epochs approach."""

    def fit(self, rows: DataFrame) -> SGD:
        self.params["reg"] = self.params.get("alpha", 1e-4)
        return super().fit(rows)


def folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """Stratified folds in the order of prompt_id, unshuffled: each class is cut into k runs."""
    w = Window.partitionBy("label").orderBy("prompt_id")
    n = F.count("*").over(Window.partitionBy("label"))
    return rows.withColumn("fold", F.floor((F.row_number().over(w) - 1) * k / n).cast("int"))


class LogisticRegressionCV(LogisticRegression):
    """The C of ten between 1e-4 and 1e4 with the best mean accuracy over five folds (the first of equals), then refitted."""

    def fit(self, rows: DataFrame) -> LogisticRegressionCV:
        k = self.params.get("cv", 5)
        split = folds(rows, k).persist()
        best, grid = (-1.0, None), np.logspace(-4, 4, self.params.get("Cs", 10))
        for c in grid:
            acc = [LogisticRegression(C=float(c)).fit(split.where(F.col("fold") != i)).score(split.where(F.col("fold") == i)) for i in range(k)]
            if np.mean(acc) > best[0] + 1e-12:
                best = (float(np.mean(acc)), float(c))
        split.unpersist()
        self.C_ = self.params["C"] = best[1]
        return super().fit(rows)


class Ridge(Linear):
    """Least squares on -1 and 1 with penalty alpha |w|^2, intercept free; one problem a class beyond two. Solved from the moments."""

    has_proba = False

    def fit(self, rows: DataFrame) -> Ridge:
        self.classes_ = classes_of(rows)
        alpha, coef, intercept = self.params.get("alpha", 1.0), [], []
        for c in self.classes_[1:] if len(self.classes_) == 2 else self.classes_:
            if is_vector(rows):  # many sparse features: no matrix of their products
                from pyspark.ml.regression import LinearRegression

                data = rows.select("features", F.when(F.col("label") == c, 1.0).otherwise(-1.0).alias("label")).persist()
                fit = LinearRegression(regParam=alpha / data.count(), elasticNetParam=0.0, standardization=False, solver="auto", maxIter=1000, tol=1e-8).fit(data)
                data.unpersist()
                coef.append(fit.coefficients.toArray())
                intercept.append(fit.intercept)
                continue
            n, s, m = moments(rows, F.when(F.col("label") == c, 1.0).otherwise(-1.0))
            mx, mt = s[1:-1] / n, s[-1] / n
            gram = m[1:-1, 1:-1] - n * np.outer(mx, mx)
            w = np.linalg.solve(gram + alpha * np.eye(len(mx)), m[1:-1, -1] - n * mx * mt)
            coef.append(w)
            intercept.append(mt - mx @ w)
        self.coef_, self.intercept_ = np.array(coef), np.array(intercept)
        return self


class SVM(Linear):
    """Linear SVM (hinge loss, C = 1) by MLlib, with probabilities by a logistic curve over its scores (Platt). Two classes."""

    def fit(self, rows: DataFrame) -> SVM:
        from pyspark.ml.classification import LinearSVC

        self.classes_ = classes_of(rows)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        data = _indexed(rows, self.classes_)
        m = LinearSVC(regParam=1.0 / data.count(), standardization=False, maxIter=self.params.get("max_iter", 1000), tol=1e-9).fit(data)
        data.unpersist()
        self.coef_, self.intercept_ = m.coefficients.toArray()[None], np.array([m.intercept])
        self.vector_ = is_vector(rows)
        one = rows.select("label", F.array(super().decision(F.col("features"))[0]).alias("features"))
        platt = LogisticRegression(C=1e6).fit(one)
        self.platt_ = float(platt.coef_[0, 0]), float(platt.intercept_[0])
        return self

    def probabilities(self, features: Column) -> Column:
        p = sigmoid(self.decision(features)[0] * self.platt_[0] + self.platt_[1])
        return F.array(1 - p, p)


class MassMean(Linear):
    """Unit difference of the class means, threshold halfway between them. Labels are 0 and 1; others are left out."""

    def fit(self, rows: DataFrame) -> MassMean:
        vec = F.col("features") if is_vector(rows) else array_to_vector("features")
        means = rows.where("label in (0, 1)").groupBy("label").agg(Summarizer.mean(vec).alias("m")).collect()  # two rows
        by = {r["label"]: r["m"].toArray() for r in means}
        if len(by) < 2:
            raise ValueError("both classes, 0 and 1, are needed")
        m1, m0 = by[1], by[0]
        theta = m1 - m0
        norm = np.linalg.norm(theta)
        theta = theta / norm if norm else theta
        self.coef_, self.intercept_, self.classes_ = theta[None], np.array([-(m1 + m0) @ theta / 2]), [0, 1]
        return self


class LDA(Linear):
    """Pooled within-class covariance (n - k), solved by pseudo-inverse; priors are the classes' shares."""

    def fit(self, rows: DataFrame) -> LDA:
        self.classes_ = classes_of(rows)
        if len(self.classes_) < 2:
            raise ValueError("at least two classes are needed")
        means, counts, within = [], [], 0.0
        for c in self.classes_:
            n, s, m = moments(rows.where(F.col("label") == c), F.lit(0.0))
            mu = s[1:-1] / n
            means.append(mu)
            counts.append(n)
            within = within + m[1:-1, 1:-1] - n * np.outer(mu, mu)
        total = sum(counts)
        inverse = np.linalg.pinv(within / (total - len(counts)), hermitian=True)
        w = np.array(means) @ inverse
        b = -0.5 * np.sum(w * np.array(means), axis=1) + np.log(np.array(counts) / total)
        self.coef_, self.intercept_ = (w[1:] - w[:1], b[1:] - b[:1]) if len(counts) == 2 else (w, b)
        return self


class GroupLasso(Linear):
    """Mean log loss + alpha times the sum of the layers' coefficient norms, without an intercept, by accelerated proximal gradients.

    Labels are the lower class as -1 and the higher as 1. Each step's gradient is a sum over Arrow batches; the driver keeps d numbers.
    """

    LOCAL, MAX_ITER = 4_000_000, 2000

    def fit(self, rows: DataFrame) -> GroupLasso:
        h, layers, alpha = self.params["hidden_dim"], self.params["n_layers"], self.params.get("alpha", 0.01)
        self.classes_ = classes_of(rows)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed")
        rows = dense(rows)
        bad = rows.where(F.size("features") != h * layers).limit(1).count()
        if bad:
            raise ValueError(f"expected {h} x {layers} = {h * layers} features")
        data = rows.select("features", F.when(F.col("label") == self.classes_[0], -1.0).otherwise(1.0).alias("t")).persist()
        n, _, m = moments(data, F.col("t"))
        step = 4.0 * n / max(np.linalg.eigvalsh(m[1:-1, 1:-1])[-1], 1e-12)
        spark = data.sparkSession
        # The same steps either way: a sum that fits the driver easily is taken there, without a job a step.
        local = None
        if n * h * layers <= self.LOCAL:
            pdf = data.toPandas()
            local = np.stack(pdf["features"].to_numpy()), pdf["t"].to_numpy()

        def gradient(w: np.ndarray) -> np.ndarray:
            import pandas as pd

            if local is not None:
                x, t = local
                return -x.T @ (t / (1 + np.exp(np.clip(t * (x @ w), -500, 500)))) / n
            shared = spark.sparkContext.broadcast(w)

            def run(frames):
                g = np.zeros(len(shared.value))
                for f in frames:
                    if len(f):
                        x, t = np.stack(f["features"].to_numpy()), f["t"].to_numpy()
                        g -= x.T @ (t / (1 + np.exp(np.clip(t * (x @ shared.value), -500, 500))))
                yield pd.DataFrame({"g": [g]})

            got = data.mapInPandas(run, "g array<double>").collect()
            shared.unpersist()
            return np.sum([r["g"] for r in got], axis=0) / n

        w = z = np.zeros(h * layers)
        t = 1.0
        for _ in range(steps := self.params.get("max_iter", self.MAX_ITER)):
            v = (z - step * gradient(z)).reshape(layers, h)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            new = (v * np.maximum(1 - step * alpha / np.maximum(norm, 1e-300), 0)).ravel()
            faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
            if (z - new) @ (new - w) > 0:  # restart
                faster, z_next = 1.0, new
            else:
                z_next = new + (t - 1) / faster * (new - w)
            change = np.max(np.abs(new - w), initial=0.0)
            w, z, t = new, z_next, faster
            if change < self.params.get("tol", 1e-7):
                break
        else:
            warnings.warn(f"group lasso has not converged in {steps} steps", stacklevel=2)
        data.unpersist()
        self.coef_, self.intercept_ = w[None], np.zeros(1)
        self.group_norms_ = np.linalg.norm(w.reshape(layers, h), axis=1)
        self.selected_groups_ = [int(i) for i in np.flatnonzero(self.group_norms_ > 1e-6)]
        return self


class Dummy(Linear):
    """"most_frequent" (ties: the lowest class) or "uniform" (a hash of seed and prompt_id, so that it doesn't depend on partitions)."""

    def fit(self, rows: DataFrame) -> Dummy:
        self.classes_ = classes_of(rows)
        self.top_ = rows.groupBy("label").count().orderBy(F.desc("count"), "label").first()[0]
        self.coef_, self.intercept_ = np.zeros((1, 0)), np.zeros(1)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        self._check()
        if self.params.get("strategy", "most_frequent") == "most_frequent":
            return rows.withColumn("pred", F.lit(self.top_))
        pick = F.pmod(F.xxhash64(F.lit(self.params.get("random_state", 0)), "prompt_id"), F.lit(len(self.classes_))) + 1
        return rows.withColumn("pred", F.element_at(F.array(*[F.lit(c) for c in self.classes_]), pick.cast("int")))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        self._check()
        frequent = self.params.get("strategy", "most_frequent") == "most_frequent"
        p = [float(c == self.top_) if frequent else 1.0 / len(self.classes_) for c in self.classes_]
        return rows.withColumn("proba", F.array(*[F.lit(x) for x in p]))


class UserEstimator(Linear):
    """Any object with fit(X, y) and predict(X), fitted on the driver; the number of rows is checked first. Applied in Arrow batches."""

    MAX_ROWS = 1_000_000

    def __init__(self, template):
        if not hasattr(template, "fit") or not hasattr(template, "predict"):
            raise TypeError("a classifier has fit and predict")
        if not hasattr(template, "predict_proba"):
            warnings.warn("the classifier has no predict_proba; probabilities won't be available", stacklevel=3)
        super().__init__()
        self.template, self.has_proba = template, hasattr(template, "predict_proba")

    def clone(self):
        return UserEstimator(self.template)

    def fit(self, rows: DataFrame) -> UserEstimator:
        import copy

        n = rows.count()
        if n > self.MAX_ROWS:
            raise ValueError(f"{n} rows are too many for an estimator on the driver")
        pdf = dense(rows).select("features", "label").toPandas()
        self.model_ = copy.deepcopy(self.template)
        self.model_.fit(np.stack(pdf["features"].to_numpy()), pdf["label"].to_numpy())
        self.coef_ = getattr(self.model_, "coef_", np.zeros((1, 0)))
        self.classes_ = sorted(int(c) for c in pdf["label"].unique())
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        self._check()
        model = self.model_

        @F.pandas_udf("int")
        def run(features):
            return _series(int(y) for y in model.predict(np.stack(features.to_numpy())))

        return dense(rows).withColumn("pred", run("features"))

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        if not self.has_proba:
            raise AttributeError("the classifier has no predict_proba")
        self._check()
        model = self.model_

        @F.pandas_udf("array<double>")
        def run(features):
            return _series([list(map(float, p)) for p in model.predict_proba(np.stack(features.to_numpy()))])

        return dense(rows).withColumn("proba", run("features"))


def _series(values):
    import pandas as pd

    return pd.Series(list(values))


NAMES = {
    "logistic_regression": LogisticRegression, "logistic_regression_cv": LogisticRegressionCV, "ridge": Ridge, "svm": SVM, "sgd": SGD, "mass_mean": MassMean, "lda": LDA,
}


def build(classifier, random_state: int | None = None) -> Linear:
    """A name of NAMES, one of this module's objects (cloned), or any object with fit and predict. The seed goes to names only."""
    if isinstance(classifier, str):
        if classifier not in NAMES:
            raise ValueError(f"unknown classifier {classifier!r}; one of {', '.join(NAMES)}")
        return NAMES[classifier](random_state=random_state)
    return classifier.clone() if isinstance(classifier, Linear) else UserEstimator(classifier)


class PCA:
    """Principal components of centred rows; of each component the largest loading is positive. At most min(n, d) components."""

    def __init__(self, n_components: int = 10):
        self.n_components = n_components

    def fit(self, rows: DataFrame) -> PCA:
        n, s, m = moments(rows, F.lit(0.0))
        self.mean_ = s[1:-1] / n
        values, vectors = np.linalg.eigh(m[1:-1, 1:-1] - n * np.outer(self.mean_, self.mean_))
        k = min(self.n_components, n, len(self.mean_))
        c = vectors[:, ::-1][:, :k].T
        sign = np.sign(c[np.arange(k), np.argmax(np.abs(c), axis=1)])
        self.components_ = c * np.where(sign == 0, 1, sign)[:, None]
        self.explained_variance_ = values[::-1][:k] / max(n - 1, 1)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        x = F.col("features")
        parts = [dot(x, constant(c)) - float(c @ self.mean_) for c in self.components_]
        return rows.withColumn("features", F.array(*parts))
