"""Vocabularies and what is built on them, at sizes and on rows that the tables don't have."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomry.functions import text as X


def brute(rows, low, high):
    import re

    docs = {}
    for k, t in rows:
        w = re.findall(r"\w{2,}", (t or "").lower())
        docs.setdefault(k, Counter()).update(" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1))
    ctf, df = Counter(), Counter()
    for c in docs.values():
        ctf.update(c)
        df.update(c.keys())
    return {(t, ctf[t], df[t]) for t in ctf}, {(k, t, n) for k, c in docs.items() for t, n in c.items()}


ROWS = [(1, "The cat, a CAT sat on the mat!"), (2, ""), (3, None), (4, "x"), (5, "übergroß 42 ٣٤ 漢字 the_cat the cat"), (6, "cat " * 50)]


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, (1, "cat dog"), (None, "the cat"), (None, "the dog")]])
@pytest.mark.parametrize("low, high", [(1, 1), (1, 3)])
def test_counts_and_sums(spark, rows, low, high, monkeypatch):
    monkeypatch.setattr(X, "HELD", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums, counts = brute(rows, low, high)
    assert {tuple(r) for r in X.term_sums(docs, low, high, key="doc_id").select("term", "ctf", "df").collect()} == sums
    assert {tuple(r) for r in X.term_counts(docs, low, high).collect()} == counts


def test_worker_words_are_the_jvms(spark):
    """Each code point between two letters: a word of three, or none."""
    every = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = [" ".join(f"a{c}b" for c in every[i : i + 20_000]) for i in range(0, len(every), 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = X.splitter(spark)
    for lowered, words in docs.select(F.lower("text"), X.tokens(F.col("text"))).collect():
        assert split(lowered.encode()) == words


def test_bigrams_of_a_long_text_are_linear(spark):
    """An n-gram must not tokenise its text again: 30,000 words would take hours."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"))
    assert docs.select(F.size(X.ngrams(X.tokens(F.col("text")), 1, 2))).first()[0] == 59_999
    assert X.term_sums(docs, 1, 2, key="doc_id").count() == 59_999


def _written(df, path):
    df.write.parquet(str(path))
    return df


def test_class_terms_move_no_counts(spark, tmp_path):
    """Repeated documents and labels count as in SQL; nothing is grouped by document and term."""
    import duckdb

    from fathomry.plans import text_queries as T

    _written(spark.createDataFrame([(1, "aa bb bb"), (1, "aa cc"), (2, "bb dd"), (3, "zz"), (None, "aa"), (4, None)], "doc_id long, text string"), tmp_path / "documents.parquet")
    _written(spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 0), (4, 0, 1), (3, 0, 2), (9, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path / "labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = T.top_class_terms(spark, str(tmp_path))
    assert "doc_id" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(T.SQL["top_class_terms"]).fetchall())


@pytest.mark.parametrize("strategy", ["mean", "last_token", "first_token"])
def test_pooled_in_the_source(spark, strategy):
    """What a source pools itself is what its tokens give, and no vector of a token is shuffled."""
    from fathomry.functions import pooling as P
    from fathomry.operators.probe import LinearProbe
    from fathomry.sources.activations import HashSource, with_hash

    prompts = with_hash(spark.createDataFrame([(1, "a b  c a"), (2, ""), (3, None), (4, "  x\ty"), (5, "a b  c a")], "prompt_id long, text string"))
    source = HashSource(layers=3, width=4)
    got = LinearProbe(source, pooling=strategy)._vectors(prompts, [2, 0], strategy)
    wanted = prompts.select("prompt_hash", "text").distinct().withColumn("layer", F.explode(F.array(F.lit(0), F.lit(2))))
    tokens = prompts.select("prompt_id", "prompt_hash").join(source.extract(wanted), "prompt_hash").drop("prompt_hash")
    key = lambda r: (r["prompt_id"], r["layer"])
    want = {key(r): r["vec"] for r in P.pool(tokens, strategy, ["prompt_id", "layer"]).collect()}
    assert {key(r) for r in got.collect()} == want.keys() and len(want) == 8
    for r in got.collect():
        assert r["vec"] == pytest.approx(want[key(r)], abs=1e-12)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("frequent", [1, 7, 400_000])
def test_perplexity_with_and_without_a_table(spark, tmp_path, monkeypatch, frequent):
    """Terms of the table and joined ones give SQL's figures; only the rare ones are rows of a join."""
    import duckdb

    from fathomry.plans import text_queries as T

    monkeypatch.setattr(T, "FREQUENT", frequent)
    rows = [(1, "aa bb bb cc"), (1, "aa aa dd"), (2, "ee " * 9 + "aa"), (3, ""), (4, None), (None, "aa bb"), (5, "gg " + "h" * 80)]
    docs = _written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, T.perplexity_unigram(spark, str(tmp_path)).collect()))) == sorted(map(str, c.sql(T.SQL["perplexity_unigram"]).fetchall()))
    assert X.known_losses(docs, {"aa": 1.0, "bb": 2.0}).where("s is null").count() == 5


def test_baselines_need_no_counts_by_prompt(spark, monkeypatch):
    from fathomry.operators.baselines import BaselineProbe

    monkeypatch.setattr(X, "term_counts", None)
    prompts = spark.createDataFrame([(1, "aa bb bb", 1), (2, "aa cc", 0), (3, "", 0), (4, "bb dd", 1)], "prompt_id long, text string, label int")
    b = BaselineProbe("tfidf", classifier="mass_mean", max_features=3).fit(prompts)
    assert b.feature_names() == ["aa", "bb", "cc"] and b.idf_ == pytest.approx([1 + 0.5108256237659907, 1 + 0.5108256237659907, 1 + 0.9162907318741551])
