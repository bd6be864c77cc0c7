import warnings

import numpy as np
import pytest

from fathomry.operators import estimators as E
from fathomry.operators.baselines import ActivationBaseline, BaselineBattery, BaselineProbe
from fathomry.operators.probe import LinearProbe
from fathomry.sources.activations import HashSource, ModelSource, prompt_table
from fathomry.sources.cache import ActivationCache


def frame(spark, x, y):
    return spark.createDataFrame([(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))], "prompt_id long, features array<double>, label int")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    y = np.repeat([1, 0], 30)
    x = rng.normal(size=(60, 6))
    x[:, 0] += 1.5 * y
    return x, y, frame(spark, x, y).persist()


def test_logistic_regression_is_optimal(data):
    x, y, rows = data
    m = E.LogisticRegression(C=0.5).fit(rows)
    p = 1 / (1 + np.exp(-(x @ m.coef_[0] + m.intercept_[0])))
    assert np.abs(0.5 * x.T @ (p - y) + m.coef_[0]).max() < 1e-4 and abs((p - y).sum()) < 1e-4


def test_ridge_and_lda_closed_forms(data):
    x, y, rows = data
    t = 2.0 * y - 1
    m = E.Ridge().fit(rows)
    xc = x - x.mean(0)
    assert np.allclose(m.coef_[0], np.linalg.solve(xc.T @ xc + np.eye(6), xc.T @ (t - t.mean())))
    with pytest.raises(AttributeError):
        m.predict_proba(rows)
    m = E.LDA().fit(rows)
    s = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / 58
    assert np.allclose(m.coef_[0], np.linalg.solve(s, x[y == 1].mean(0) - x[y == 0].mean(0)))


def test_mass_mean(spark):
    x = np.array([[1, 0], [2, 0], [3, 0], [-1, 0], [-2, 0], [-3, 0]], float)
    y = np.array([1, 1, 1, 0, 0, 0])
    m = E.MassMean().fit(frame(spark, x, y))
    assert m.coef_[0].tolist() == [1.0, 0.0] and m.score(frame(spark, x, y)) == 1.0
    with pytest.raises(ValueError):
        E.MassMean().fit(frame(spark, x[:2], [1, 1]))


def test_group_lasso_conditions(data, monkeypatch):
    x, y, rows = data
    t, alpha = 2.0 * y - 1, 0.12
    fits = [E.GroupLasso(hidden_dim=2, n_layers=3, alpha=alpha).fit(rows)]
    monkeypatch.setattr(E.GroupLasso, "LOCAL", 0)
    fits.append(E.GroupLasso(hidden_dim=2, n_layers=3, alpha=alpha, max_iter=5).fit(rows))
    w = fits[0].coef_[0]
    g = (-x.T @ (t / (1 + np.exp(t * (x @ w)))) / 60).reshape(3, 2)
    for i, v in enumerate(w.reshape(3, 2)):
        n = np.linalg.norm(v)
        assert np.linalg.norm(g[i] + alpha * v / n) < 1e-4 if n else np.linalg.norm(g[i]) <= alpha + 1e-9
    assert 0 in fits[0].selected_groups_
    assert np.abs(fits[1].coef_[0] - w).max() < 0.3
    with pytest.raises(ValueError):
        E.GroupLasso(hidden_dim=4, n_layers=3).fit(rows)


@pytest.mark.parametrize("local", [0, 4_000_000])
def test_group_lasso_has_one_limit(data, monkeypatch, local):
    monkeypatch.setattr(E.GroupLasso, "LOCAL", local)
    monkeypatch.setattr(E.GroupLasso, "MAX_ITER", 3, raising=False)
    with pytest.warns(UserWarning, match="not converged in 3 steps"):
        E.GroupLasso(hidden_dim=2, n_layers=3, alpha=0.12).fit(data[2])


def test_svm_dummy_user(data):
    x, y, rows = data
    m = E.SVM().fit(rows)
    t, w = 2.0 * y - 1, m.coef_[0]
    objective = np.maximum(0, 1 - t * (x @ w + m.intercept_[0])).sum() + w @ w / 2
    assert objective < 36.613 * 1.002  # the optimum, from 200,000 subgradient steps
    assert abs(sum(m.predict_proba(rows).first()["proba"]) - 1) < 1e-9
    assert E.Dummy(strategy="most_frequent").fit(rows).predict(rows).first()["pred"] == 0  # a tie: the lowest
    u = E.Dummy(strategy="uniform", random_state=1).fit(rows)
    assert {r["pred"] for r in u.predict(rows).collect()} == {0, 1}

    class Mine:
        def fit(self, X, y):
            self.up = X[y == 1].mean(0)[0] > X[y == 0].mean(0)[0]

        def predict(self, X):
            return (X[:, 0] > 0.75).astype(int)

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        m = E.build(Mine()).fit(rows)
    assert any("predict_proba" in str(w.message) for w in said)
    assert m.score(rows) > 0.6
    with pytest.raises(TypeError):
        E.build(3)
    with pytest.raises(ValueError):
        E.build("forest")
    with pytest.raises(E.NotFitted):
        E.Ridge().predict(rows)


def test_pca_is_centred(data):
    x, _, rows = data
    m = E.PCA(3).fit(rows)
    z = np.array([r["features"] for r in m.transform(rows).orderBy("prompt_id").collect()])
    assert np.allclose(z, (x - x.mean(0)) @ m.components_.T) and np.allclose(z.mean(0), 0)


POS = ["dogs bark and wag their tails", "the dog chased its ball", "a puppy loves its owner", "dogs fetch sticks in the park"]
NEG = ["cats purr and nap all day", "the cat climbed the curtain", "a kitten plays with yarn", "cats watch birds at the window"]


@pytest.fixture(scope="module")
def prompts(spark):
    return prompt_table(spark, POS + NEG, [1] * 4 + [0] * 4).persist()


@pytest.mark.parametrize("config", [{"layers": "all", "classifier": "mass_mean"}, {"layers": 0, "classifier": "ridge", "inference_pooling": "max"}, {"layers": "fast_auto", "auto_candidates": [0, 2, 3], "fast_auto_top_k": 2, "pooling": "mean"}, {"layers": "auto", "auto_candidates": [0, 1], "auto_alpha": 0.05, "inference_pooling": "max"}])
def test_probe(spark, prompts, tmp_path, config):
    p = LinearProbe(HashSource(), **config).fit(prompts)
    pred = p.predict(prompts)
    assert pred.count() == 8 and p.score(prompts) > 0.6
    p.save(str(tmp_path / "p"))
    q = LinearProbe.load(str(tmp_path / "p"), spark, HashSource())
    assert {tuple(r) for r in q.predict(prompts).collect()} == {tuple(r) for r in pred.collect()}
    total = sum(v for _, v in p.compute_layer_importance())
    assert abs(total - 1) < 1e-9
    if str(config["layers"]).endswith("auto"):
        assert p.importance_table(spark).count() == len(config["auto_candidates"])


def test_probe_errors(prompts):
    p = LinearProbe(HashSource())
    with pytest.raises(RuntimeError):
        p.predict(prompts)
    for bad in ({"fast_auto_top_k": 0}, {"normalize_layers": "all"}, {"pooling": "eos"}, {"classifier": "forest"}):
        with pytest.raises(ValueError):
            LinearProbe(HashSource(), **bad)


def test_cache(spark, prompts, tmp_path):
    c, s = ActivationCache(spark, f"file://{tmp_path}/cache"), HashSource()
    first = c.warmup(prompts, s, [0, 1], perplexity=True)
    assert (first.activations_cached, first.activations_extracted, first.perplexity_extracted) == (0, 8, 8)
    again = c.warmup(prompts, s, [0, 1], perplexity=True)
    assert (again.activations_extracted, again.perplexity_extracted, again.cache_hit_rate) == (0, 0, 1.0)
    need, _ = c.status(prompts, s, [0, 1, 2])
    assert {r["layer"] for r in need.select("layer").distinct().collect()} == {2}  # only what is missing
    direct = LinearProbe(s, layers=[0, 2], classifier="mass_mean").fit(prompts).predict(prompts)
    cached = LinearProbe(s, c, layers=[0, 2], classifier="mass_mean").fit(prompts).predict(prompts)
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in cached.collect()}
    assert c.perplexity(prompts, s).count() == 8
    c.invalidate(prompts.where("prompt_id < 2"), s.name)
    assert c.warmup(prompts, s, [0, 1]).activations_extracted == 2
    assert c.clear() == 8 and c.warmup(prompts.limit(0), s, [0]).cache_hit_rate == 0.0
    with pytest.raises(ValueError):
        c.warmup(prompts, s, [0], pooling="all")


def test_model_source(spark, prompts):
    def forward(model, texts, layers):
        return [([[[float(len(w)), float(layer)] for w in t.split()] for layer in layers], [0.5] * (len(t.split()) - 1)) for t in texts]

    s = ModelSource("toy", 3, lambda: "model", forward, batch_size=2)
    p = LinearProbe(s, layers=[0, 1], pooling="mean", classifier="mass_mean").fit(prompts)
    assert p.predict(prompts).count() == 8
    assert s.losses(prompts).count() == sum(len(t.split()) - 1 for t in POS + NEG)


@pytest.mark.parametrize("method", ["bow", "tfidf", "sentence_length", "majority", "random", "perplexity"])
def test_text_baselines(prompts, method):
    b = BaselineProbe(method, source=HashSource(), ngram_range=(1, 2)).fit(prompts)
    assert b.predict(prompts).count() == 8 and 0 <= b.score(prompts) <= 1
    if method in ("bow", "tfidf"):
        top = b.top_features(5)
        assert len(top["positive"]) == 5 and top["positive"][0][1] > 0 > top["negative"][0][1]
        assert "dogs" in b.feature_names()
    else:
        assert b.top_features() is None


@pytest.mark.parametrize("method", ["random_direction", "pca", "layer_0"])
def test_activation_baselines(prompts, method):
    b = ActivationBaseline(method, HashSource(), n_components=3, classifier="mass_mean").fit(prompts)
    assert 0 <= b.score(prompts) <= 1


def test_battery(spark, prompts):
    b = BaselineBattery(include=["bow", "majority", "sentence_transformers"], classifier="mass_mean")
    with pytest.raises(RuntimeError):
        b.get_best()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        r = b.fit(prompts)
    assert any("sentence_transformers" in str(w.message) for w in said)
    assert [x.name for x in r] == ["bow", "majority"] and r.best().name == "bow" and r["majority"].score == 0.5
    assert "bow" in r.summary() and r.table(spark).count() == 2 and b.get_baseline("bow").method == "bow"
    with pytest.raises(KeyError):
        r["x"]
    with pytest.raises(ValueError):
        BaselineBattery(include=["x"])
    for bad in ({"method": "x"}, {"method": "perplexity"}):
        with pytest.raises(ValueError):
            BaselineProbe(**bad)
    with pytest.raises(ValueError):
        ActivationBaseline("pca", HashSource(), pooling="all")


def test_stream(spark, tmp_path):
    from fathomry.streaming.scorer import running_max

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", [1.0]), (1, "2024-01-01 00:00:02", [3.0]), (2, "2024-01-01 00:00:03", [-1.0])], "prompt_id long, ts string, vec array<double>").selectExpr("prompt_id", "cast(ts as timestamp) ts", "vec")
    rows.write.parquet(str(tmp_path / "in"))
    s = running_max(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), [1.0], 0.0)
    q = s.writeStream.outputMode("update").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["prompt_id"]: (round(r["p_max"], 4), r["tokens"]) for r in spark.table("running").collect()}
    assert got == {1: (0.9526, 2), 2: (0.2689, 1)}
