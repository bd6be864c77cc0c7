"""Exact deduplication by a stateful stream.

The stream keys documents by the SHA-256 of their text. Its state lies on disk (RocksDB), never expires, and
holds for each digest the count, the smallest stable identifier and the content locator (file, row) of that
document. A micro-batch reports the digests that were hit; hits are then compared byte by byte with the text at
the retained locator, so that a collision of digests can't remove a document.

Null text: no duplicate of anything. Empty texts are copies of one another. Ties: the smallest doc_id stays, nulls
last, then the smallest locator. Repeated rows are copies. An empty table gives no rows. Very long texts are digested
whole and read again only on hits. Columns beside `doc_id` and `text` are not read.

With `state`, a durable folder, the stream goes on where an earlier run ended: only files that were added to the
folder of documents since are read into the state, and they meet all digests retained before. Without it the state
lasts as long as the call.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, identity, semi, source_folder, table, without

_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stream_state(spark: SparkSession, path: str, digest, scratch: Scratch, max_files: int | None = None, state: str | None = None) -> DataFrame:
    """Run the stream over all files below path; one row for each digest that was hit: digest, n, keep."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A stream reads folders or globs; a single file is named by a glob that matches it alone.
    source = reader.parquet(re.sub(r"(.)$", r"[\1]", path) if path.endswith(".parquet") else path)
    groups = source.where("text is not null").select(digest(F.col("text")).alias("digest"), identity(source).alias("keep")).groupBy("digest").agg(F.count("*").alias("n"), F.min("keep").alias("keep"))
    root = state.rstrip("/") if state else scratch.path("state")
    hits = f"{root}/hits"
    with _settings(spark):
        query = (
            groups.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{root}/stream")
            .foreachBatch(lambda df, batch: df.where("n > 1").coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(f"{hits}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    kind = spark.createDataFrame([], groups.schema).schema
    probe = spark._jvm.org.apache.hadoop.fs.Path(hits)
    if not probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(hits).groupBy("digest").agg(F.max("n").alias("n"), F.min("keep").alias("keep"))


def duplicates(spark: SparkSession, docs: DataFrame, digest=sha256, max_files: int | None = None, state: str | None = None) -> tuple[DataFrame, str]:
    """One row for each document that has an earlier copy: doc_id, file, row, duplicate_of, n_copies, digest; and the path read."""
    scratch = Scratch(spark)
    path = source_folder(docs, scratch)
    if state and path.startswith(scratch.root):
        raise ValueError("a retained state needs documents that are a folder of Parquet files as it is")
    hits = scratch.write(stream_state(spark, path, digest, scratch, max_files, state), "keys")
    scan = spark.read.parquet(path)
    located = scan.where("text is not null").select("doc_id", "text", identity(scan).alias("me"), digest(F.col("text")).alias("digest"))
    found = scratch.write(semi(located, hits, ["digest"], "inner"), "found")
    first = found.where("me = keep").select("digest", F.col("text").alias("kept_text"))
    checked = scratch.write(found.join(first, "digest").select("digest", "n", "me", "keep", F.expr("text = kept_text").alias("same")), "checked")
    sound = checked.where("same and me != keep").select("digest", "n", "me", "keep")
    if checked.where("not same").limit(1).count():
        # Digests that collide: documents whose bytes differ from the kept text are grouped by their full bytes.
        odd = found.join(checked.where("not same").select("digest", "me"), ["digest", "me"]).select("digest", "me", "text")
        groups = odd.groupBy("digest", "text").agg(F.min("me").alias("keep"), F.count("*").alias("n"))
        rest = odd.join(groups, ["digest", "text"]).where("me != keep").select("digest", "n", "me", "keep")
        clash = checked.where("not same").groupBy("digest").agg(F.count("*").alias("others"))
        sound = sound.join(clash, "digest", "left").withColumn("n", F.expr("n - coalesce(others, 0)")).drop("others").unionByName(rest)
    out = sound.select(F.col("me.doc_id").alias("doc_id"), F.col("me.file").alias("file"), F.col("me.row").alias("row"), F.col("keep.doc_id").alias("duplicate_of"), F.col("n").alias("n_copies"), "digest")
    return out, path


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is an exact copy, with the document that stays."""
    out, _ = duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "duplicate_of", "n_copies", F.lower(F.hex("digest")).alias("digest"))


SQL = """
select doc_id, keep as duplicate_of, n_copies, sha256(text) as digest
from (select doc_id, text, min(doc_id) over (partition by text) as keep, count(*) over (partition by text) as n_copies
      from documents where text is not null)
where doc_id <> keep
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their exact copies."""
    out, path = duplicates(spark, docs)
    return without(spark, docs, path, out.select("file", "row"), Scratch(spark))
