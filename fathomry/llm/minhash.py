"""Near-duplicates by MinHash with tensored banding.

COLLECTIONS small collections of WIDTH minhashes are computed for each document. A table's key is a pair of
collections, so m collections give m(m-1)/2 tables: 28 collections of 3 stand for 378 tables of 6 hashes, with 84
hash functions instead of 2,268. A collection's value that no other document has can be in no pair that matches
and is left out before pairs are formed, which loses nothing.

Candidates are the members of a bucket against its leaders (the smallest rows), round by round, four times as many
leaders in each. Every candidate is verified in its round by the Jaccard similarity of the two whole sets of word
3-shingles. Only pairs that verified ones join already are left out: members go on, those of small groups as leaders
first, until all members left in a bucket are of one group. Groups are the connected components of verified pairs.

Texts are compared in lower case, by their words (letters, digits, underscore). A text without words, empty or null,
is no near-duplicate of anything. Exact copies are near-duplicates with similarity 1. The document with the
smallest doc_id stays (nulls last, then by file and row); at equal similarities nothing is chosen, since groups are
components. Repeated rows are copies. Very long texts are compared as a whole, all their shingles with all. Empty
tables give no rows. Columns beside `doc_id` and `text` aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .kernel import Words, list_array, segmented_min, shingles, slices
from .runtime import IDENTITY, Scratch, identity, semi, ship, source_folder, spread, table, without

SHINGLE, THRESHOLD = 3, 0.5
COLLECTIONS, WIDTH = 28, 3
LEADERS = 4

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1 << 31, dtype=np.uint32, size=COLLECTIONS * WIDTH) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(1 << 32, dtype=np.uint64, size=COLLECTIONS * WIDTH).astype(np.uint32)


def shingle_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingle hashes of each row, and their number."""
    w = Words(arr)
    s, n = shingles(w.hashes(), w.count, SHINGLE)
    return (s >> np.uint64(32)).astype(np.uint32), n


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s, n = shingle_sets(batch.column("text"))
        has = np.flatnonzero(n)
        sig = np.empty((len(has), len(_A)), np.uint32)
        starts = (np.cumsum(n) - n)[has]
        if len(has):
            for j in range(len(_A)):
                sig[:, j] = np.minimum.reduceat(s * _A[j] + _B[j], starts)
        kept = batch.drop_columns(["text"]).take(pa.array(has))
        lists = list_array(sig.view(np.int32).ravel(), np.full(len(has), len(_A)), pa.int32())
        yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*kept.schema.names, "sig"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingle hashes of each row, sorted, as binary."""
    for batch in slices(batches):
        s, n = shingle_sets(batch.column("text"))
        key = np.unique(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | s)
        count = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(n))
        off = np.concatenate([[0], np.cumsum(count) * 4]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(key.astype(np.uint32))])
        yield pa.RecordBatch.from_arrays([batch.column("rid"), data], ["rid", "words"])


def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of the two sets of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part, keys, sizes = batch.slice(at, 1024), [], []
            for c in ("words_a", "words_b"):
                arr = part.column(c).cast(pa.large_binary())
                off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
                data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32)
                n = np.diff(off) // 4
                keys.append(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | data)
                sizes.append(n)
            both = np.sort(np.concatenate(keys))
            same = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            common = np.bincount(same.astype(np.int64), minlength=part.num_rows)
            j = common / np.maximum(sizes[0] + sizes[1] - common, 1)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(j)], ["a", "b", "jaccard"])


def _bucket(i: Column, x: Column, j: Column, y: Column) -> Column:
    return F.xxhash64(i, x, j, y)


def verified(pairs: DataFrame, contents: DataFrame, scan: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity THRESHOLD."""
    involved = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(contents.select("rid", "me"), "rid").select("rid", "me"), "involved")
    texts = semi(scan, involved, ["me"], "inner").select("text", "rid")
    words = scratch.write(texts.mapInArrow(sets, "rid long, words binary"), "sets")
    side = lambda c: words.select(F.col("rid").alias(c), F.col("words").alias(f"words_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= THRESHOLD).select("a", "b")


def matches(contents: DataFrame, scan: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified pairs (a, b): every pair of a bucket is one of them, or is joined by them, or isn't similar; contents: rid, sig, me; scan: text, me."""
    m = COLLECTIONS
    value = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.xxhash64(F.slice("sig", i * WIDTH + 1, WIDTH)))
    single = contents.select("rid", F.posexplode(value).alias("i", "v"))
    w = Window.partitionBy("i", "v")
    shared = single.withColumn("n", F.count("*").over(w)).where("n > 1").groupBy("rid").agg(F.collect_list(F.struct("i", "v")).alias("k"))
    shared = shared.where("size(k) > 1").select("rid", F.array_sort("k").alias("k"))
    keys = shared.select("rid", F.explode(F.flatten(F.transform("k", lambda x: F.transform(F.filter("k", lambda y: y["i"] > x["i"]), lambda y: _bucket(x["i"], x["v"], y["i"], y["v"]))))).alias("bucket"))
    keys = scratch.write(keys, "buckets")
    # Tables mostly repeat the same bucket: of those with the same members one is enough.
    whole = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("n > 1")
    whole = whole.groupBy("n", "s", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    left = scratch.write(keys.join(whole.select("bucket"), "bucket"), "members")
    scratch.drop(keys)
    edges, leaders = None, LEADERS
    left = left.withColumn("component", F.col("rid"))
    while True:
        crowd = F.lit(1) if edges is None else F.count("*").over(Window.partitionBy("bucket", "component"))
        size = F.count("*").over(Window.partitionBy("bucket"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("crowd", "rid"))
        ranked = scratch.write(left.withColumn("crowd", crowd).withColumn("r", rank).withColumn("size", size).select("bucket", "rid", "component", "r", "size"), "ranked")
        ranks = ranked.drop("size")
        first = ranks.where(F.col("r") <= leaders)
        pairs = first.toDF("bucket", "a", "ca", "ra").join(ranks.toDF("bucket", "b", "cb", "rb"), "bucket").where("ra < rb and ca != cb")
        tried = scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
        same = scratch.write(verified(tried, contents, scan, scratch), "same")
        edges = same if edges is None else scratch.write(edges.union(same).distinct(), "edges")
        rest = ranked.where((F.col("r") > leaders) & (F.col("size") > leaders + 1)).select("bucket", "rid")
        if not rest.limit(1).count():
            break
        rest = rest.join(components(edges, scratch), "rid", "left").select("bucket", "rid", F.coalesce("component", "rid").alias("component"))
        of = Window.partitionBy("bucket")
        rest = rest.withColumn("lo", F.min("component").over(of)).withColumn("hi", F.max("component").over(of)).where("lo != hi")
        left = scratch.write(rest.select("bucket", "rid", "component"), "left")
        for done in (ranked, tried):
            scratch.drop(done)
        leaders *= 4
        if not left.limit(1).count():
            break
    return edges


def groups(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str, Scratch]:
    """One row for each document that has a near-duplicate: doc_id, file, row, keep (struct), group size; and the path read."""
    ship(spark)
    scratch = Scratch(spark)
    path = source_folder(docs, scratch)
    scan = spark.read.parquet(path)
    scan = scan.select("text", identity(scan).alias("me"), F.unhex(F.md5("text")).alias("ck"))
    rows = scratch.write(spread(scan).mapInArrow(signatures, f"me {IDENTITY}, ck binary, sig array<int>"), "signatures")
    contents = rows.groupBy("ck").agg(F.first("sig").alias("sig"), F.min("me").alias("me"), F.count("*").alias("copies")).withColumn("rid", F.monotonically_increasing_id())
    contents = scratch.write(contents, "contents")
    edges = matches(contents.select("rid", "sig", "me"), scan.select("text", "me"), scratch)
    label = components(edges, scratch)
    member = contents.join(label, "rid", "left").select("ck", F.coalesce("component", "rid").alias("component"), F.col("component").isNull().alias("alone"), "copies").where("not alone or copies > 1")
    found = rows.select("me", "ck").join(member.select("ck", "component"), "ck").select("me", "component")
    keep = found.groupBy("component").agg(F.min("me").alias("keep"), F.count("*").alias("n"))
    return found.join(keep, "component").select("me", "keep", "n"), path, scratch


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near-duplicate, with the document of its group that stays."""
    found, _, _ = groups(spark, table(spark, sf_dir, "documents"))
    return found.where("me != keep").select(F.col("me.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("duplicate_of"), F.col("n").alias("group_size"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    found, path, scratch = groups(spark, docs)
    return without(spark, docs, path, found.where("me != keep").select("me.file", "me.row"), scratch)
