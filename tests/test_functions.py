import pytest

from fathomry.functions import layers as L
from fathomry.functions import pooling as P
from fathomry.functions import text as X
from fathomry.operators import linear
from fathomry.operators.scaling import LayerScaler, resolve_strategy


@pytest.mark.parametrize("spec, n, want", [(None, 32, [7, 15, 23]), ([0.0, 0.5, 1.0], 32, [0, 15, 31]), ([10, 16, 22], 32, [10, 16, 22]), ([-8, -4, -1], 32, [24, 28, 31]), ([10, 10, 16], 32, [10, 16]), ([22, 10, 16], 32, [10, 16, 22]), (None, 4, [0, 1, 2])])
def test_auto_candidates(spec, n, want):
    assert L.auto_candidates(spec, n) == want


@pytest.mark.parametrize("spec", [[], [50], [0.5, 3], [1.5]])
def test_auto_candidates_refused(spec):
    with pytest.raises(ValueError):
        L.auto_candidates(spec, 32)


def test_resolve_layers():
    assert L.resolve("middle", 32) == list(range(10, 22))
    assert L.resolve("middle", 2) == [0, 1]
    assert L.resolve("last", 5) == [4] and L.resolve(-1, 5) == [4] and L.resolve("all", 3) == [0, 1, 2]
    assert L.resolve([3, 1], 5) == [3, 1]
    for bad in (7, "top", None, True):
        with pytest.raises(ValueError):
            L.resolve(bad, 5)


def test_resolve_pooling():
    assert P.resolve() == ("last_token", "last_token")
    assert P.resolve("mean") == ("mean", "mean")
    assert P.resolve("mean", inference="max") == ("mean", "max")
    for bad in ({"train": "max"}, {"pooling": "eos"}, {"inference": "sum"}):
        with pytest.raises(ValueError):
            P.resolve(**bad)


def test_pooling_and_reduction(spark):
    t = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0]), (2, 0, [5.0, 5.0])], "prompt_id long, pos int, vec array<double>")
    get = lambda s: {r["prompt_id"]: r["vec"] for r in P.pool(t, s, ["prompt_id"]).collect()}
    assert get("last_token") == {1: [3.0, 6.0], 2: [5.0, 5.0]}
    assert get("first_token") == {1: [1.0, 2.0], 2: [5.0, 5.0]}
    assert get("mean") == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    assert P.pool(t, "all", ["prompt_id"]).count() == 3
    with pytest.raises(ValueError):
        P.pool(t, "eos", ["prompt_id"])
    votes = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, 0)], "prompt_id long, pred int")
    assert {tuple(r) for r in P.majority(votes, ["prompt_id"]).collect()} == {(1, 0), (2, 1)}


def test_scaler(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 7.0]), (2, 0, [3.0, 7.0])], "prompt_id long, layer int, vec array<double>")
    s = LayerScaler("per_neuron").fit(rows)
    out = {r["prompt_id"]: r["vec"] for r in s.transform(rows).collect()}
    assert out == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    back = {r["prompt_id"]: r["vec"] for r in s.inverse_transform(s.transform(rows)).collect()}
    assert back == {1: [1.0, 7.0], 2: [3.0, 7.0]}
    with pytest.raises(Exception):
        s.transform(spark.createDataFrame([(1, 0, [1.0])], rows.schema)).collect()
    with pytest.raises(RuntimeError):
        LayerScaler().transform(rows)
    with pytest.raises(ValueError):
        LayerScaler("x")
    assert resolve_strategy(True) == "per_neuron" and resolve_strategy(False) is None


def test_importance_and_top(spark):
    coef = spark.createDataFrame([(0, [3.0, -4.0]), (1, [0.0, 5.0]), (2, [1.0, 0.0])], "layer int, w array<double>")
    value = lambda m: [round(r["value"], 6) for r in linear.importance(coef, m).orderBy("layer").collect()]
    assert value("l2") == [5.0, 5.0, 1.0] and value("l1") == [7.0, 5.0, 1.0] and value("mean_abs") == [3.5, 2.5, 0.5] and value("max_abs") == [4.0, 5.0, 1.0]
    assert [r["layer"] for r in linear.top_layers(linear.importance(coef), 1).collect()] == [1]  # the later of equals
    assert [r["layer"] for r in linear.top_layers(linear.importance(coef)).collect()] == [1]
    with pytest.raises(ValueError):
        linear.importance(coef, "l3")
    with pytest.raises(ValueError):
        linear.top_layers(coef, 0)


def test_tokens_and_ngrams(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The cat, a CAT sat!",), ("x",), ("",)], "text string")
    out = [r[0] for r in df.select(X.ngrams(X.tokens(F.col("text")), 1, 2)).collect()]
    assert out == [["the", "cat", "cat", "sat", "the cat", "cat cat", "cat sat"], [], []]
    lengths = [(r["char_count"], r["word_count"]) for r in X.length_features(df).collect()]
    assert lengths == [(19, 5), (1, 1), (0, 0)]
    assert X.list_hash(["a", "b"]) != X.list_hash(["b", "a"])
