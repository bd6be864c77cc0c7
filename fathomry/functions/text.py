"""Text features: lengths, tokens, n-grams, vocabularies, counts, TF-IDF, and the hashes of cache keys."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that Python's str.split() gives.
SPLIT = r"[^\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Tokens of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def spread(docs: DataFrame) -> DataFrame:
    """Rebalance a scan so small that it has fewer partitions than the cluster has cores: text expressions are what costs. Runs no job."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return docs.repartition(cores) if int(str(size)) < cores << 22 else docs


def length_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """char_count, word_count and characters (white space included) for each word."""
    chars, words = F.char_length(text).cast("long"), F.size(F.regexp_extract_all(F.col(text), F.lit(SPLIT), F.lit(0))).cast("long")
    return spread(docs).withColumns({"char_count": chars, "word_count": words}).withColumn("avg_word_length", F.col("char_count") / F.greatest("word_count", F.lit(1)).cast("double"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _transform(at: Column, words: Column, n: int) -> Column:
    """The words are bound to a variable first: an expression inside of a lambda would be evaluated again for each n-gram, and slice reads the whole array."""
    return F.get(F.transform(F.array(words), lambda w: F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i - 1 + k) for k in range(n)]))), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams from low to high words, joined by one space."""
    if not 1 <= low <= high:
        raise ValueError("an n-gram range is 1 <= low <= high")
    parts = []
    for n in range(low, high + 1):
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(words if n == 1 else _transform(at, words, n))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


#: Distinct terms that a Python worker adds up before it hands the sums on.
HELD = 300_000


_differences: dict[str, tuple[str, str]] = {}


def _letters(spark: SparkSession) -> tuple[str, str]:
    """Characters of TOKEN in the JVM that Python's \\w lacks, and the reverse: the two may know different versions of Unicode."""
    app = spark.sparkContext.applicationId
    if app not in _differences:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        of_jvm = set(spark._jvm.java.util.regex.Pattern.compile(r"[^\p{L}\p{N}_]+").matcher(every).replaceAll(""))
        of_python = set(re.findall(r"\w", every))
        _differences[app] = "".join(sorted(of_jvm - of_python)), "".join(sorted(of_python - of_jvm))
    return _differences[app]


def splitter(spark: SparkSession, low: int = 1, high: int = 1) -> Callable[[bytes], list[str]]:
    """What gives the n-grams of a lowered text in a Python worker, with the JVM's letters and digits."""
    if not 1 <= low <= high:
        raise ValueError("an n-gram range is 1 <= low <= high")
    more, less = _letters(spark)
    word, foreign = rf"[\w{re.escape(more)}]{{2,}}", dict.fromkeys(map(ord, less), " ")
    # A class of thousands of characters beyond 16 bits is searched one by one: whether a text has any such is asked first.
    some = f"[\U00010000-\U0010ffff{re.escape(''.join(c for c in less if c < chr(0x10000)))}]"

    def run(text: bytes) -> list[str]:
        import re

        t = text.decode("utf-8", "replace")
        if foreign and not t.isascii() and re.search(some, t):
            t = t.translate(foreign)
        words = re.findall(word, t)
        if high == 1:
            return words
        return [g for n in range(low, high + 1) for g in (words if n == 1 else map(" ".join, zip(*[words[i:] for i in range(n)])))]

    return run


def _lowered(text: str) -> Column:
    return F.lower(text).cast("binary").alias("text")


def distinct_keys(docs: DataFrame, key: str) -> bool:
    """Whether each key has one row: reads that column alone."""
    return docs.groupBy(key).count().where("count > 1").isEmpty()


def _explode_counts(docs: DataFrame, low: int, high: int, key: str) -> DataFrame:
    """Counts of keys that repeat: all rows of a key come together."""
    return docs.select(key, F.explode(ngrams(tokens(F.col("text")), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, low: int = 1, high: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf. A text is counted in its row, without a shuffle, unless keys repeat."""
    docs = docs.select(key, F.col(text).alias("text"))
    if not distinct_keys(docs, key):
        return _explode_counts(spread(docs), low, high, key)
    split = splitter(docs.sparkSession, low, high)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            at, terms, tf = [], [], []
            for i, t in enumerate(b.column(1)):
                c = Counter(split(t.as_py()))
                at += [i] * len(c)
                terms += c
                tf += c.values()
                if len(terms) > 100_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], [key, "term", "tf"])
                    at, terms, tf = [], [], []

    rows = spread(docs.where("text is not null")).select(key, _lowered("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, tf long")


def term_sums(docs: DataFrame, low: int = 1, high: int = 1, by: str | None = None, text: str = "text", key: str | None = None, df: bool = True) -> DataFrame:
    """(by,) term, ctf, df: sums over all texts (of each value of the integers in by). Workers add up before anything is shuffled.

    df counts rows; with a key that repeats it counts keys; it is 0 if it isn't asked for.
    """
    if key is not None and not distinct_keys(docs, key):
        counts = _explode_counts(spread(docs.select(key, F.col(text).alias("text"))), low, high, key)
        return counts.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df"))
    split, held, wanted = splitter(docs.sparkSession, low, high), HELD, df

    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        def flush():
            for k, (ctf, df) in sums.items():
                names = list(ctf)
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int64()), pa.array(part, pa.string()), pa.array([ctf[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())], ["by", "term", "ctf", "df"])
            sums.clear()

        sums = defaultdict(lambda: (Counter(), Counter()))
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                terms = split(t.as_py())
                ctf, df = sums[k]
                ctf.update(terms)
                if wanted:
                    df.update(set(terms))
                if len(ctf) > held:
                    yield from flush()
        yield from flush()

    kind = F.lit(0) if by is None else F.col(by)
    rows = spread(docs.select(kind.cast("long").alias("by"), F.col(text).alias("text")).where("text is not null")).select("by", _lowered("text"))
    sums = rows.mapInArrow(run, "by long, term string, ctf long, df long")
    if by is not None:
        return sums.groupBy(F.col("by").alias(by), "term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))
    return sums.groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def known_losses(docs: DataFrame, loss: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, n, s, lo, hi: a row a text of its terms with a loss (their number, sum, least and greatest), with a term that none is; and a row for each other term and its number, s, lo and hi null."""
    split, shared = splitter(docs.sparkSession), docs.sparkSession.sparkContext.broadcast(loss)

    def run(batches):
        import math
        from collections import Counter

        import pyarrow as pa

        known = shared.value
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                n, s, lo, hi = 0, [], math.inf, -math.inf
                for term, tf in Counter(split(t.as_py())).items():
                    x = known.get(term)
                    if x is None:
                        rows.append((i, term, tf, None, None, None))
                    else:
                        n += tf
                        s.append(tf * x)
                        lo, hi = min(lo, x), max(hi, x)
                if n:
                    rows.append((i, f"\0{hash((i, n, lo))}", n, math.fsum(s), lo, hi))  # spread over the partitions of a join
                if len(rows) > 100_000 or i == b.num_rows - 1:
                    at, *columns = zip(*rows) if rows else [()] * 6
                    kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "term", "n", "s", "lo", "hi"])
                    rows = []

    rows = spread(docs.select(key, F.col(text).alias("text")).where("text is not null")).select(key, _lowered("text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, n long, s double, lo double, hi double")


def top_terms(sums: DataFrame, max_features: int = 10_000) -> DataFrame:
    """term, ctf, df of the most frequent terms (ties: alphabetical order)."""
    return sums.orderBy(F.desc("ctf"), "term").limit(max_features)


def vocabulary(counts: DataFrame, max_features: int = 10_000) -> DataFrame:
    """top_terms of counts (key, term, tf)."""
    return top_terms(counts.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df")), max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: Column, key: str = "doc_id") -> DataFrame:
    """key, term, weight: tf (ln((1 + n) / (1 + df)) + 1), each document's vector of length 1. Terms outside of the vocabulary are dropped."""
    from pyspark.sql.window import Window

    raw = counts.join(vocab.select("term", "df"), "term").select(key, "term", (F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def list_hash(prompts: list[str]) -> str:
    """Hash of a list as a whole, order included."""
    return hashlib.sha256(json.dumps(list(prompts)).encode()).hexdigest()
