"""Best-fit-decreasing bin packing of indivisible groups into shards of fixed capacity.

A group is a set of documents with the same text: its copies stay together. Groups sorted by size enter the bin
with the tightest remaining capacity that still holds them. The bins lie in a balanced (AVL) tree keyed by
remaining capacity.

The packing is exact best-fit-decreasing and yet runs on a histogram: groups of one size are interchangeable, so
the driver packs (size, count) pairs, at most capacity / unit of them whatever the corpus, and moves whole runs of
equal bins at once. Each group then finds its bin by its rank within its size, in a join with the runs.

Sizes are UTF-8 bytes rounded up to `unit`. Null and empty texts have size 0 and count as one unit, so that
every document has a shard. A group over the capacity has a shard of its own. Ties within a size are ordered by the
digest. Repeated rows are copies and both returned. An empty table gives no rows. Very long texts are groups like
others. Columns beside `doc_id`, the key and those of the size aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .runtime import Scratch, small, table

CAPACITY = 1 << 24
UNIT = 64


class _Node:
    __slots__ = ("key", "runs", "left", "right", "height")

    def __init__(self, key: int, runs: list):
        self.key, self.runs, self.left, self.right, self.height = key, runs, None, None, 1


def _h(n: _Node | None) -> int:
    return n.height if n else 0


def _fix(n: _Node) -> _Node:
    n.height = 1 + max(_h(n.left), _h(n.right))
    lean = _h(n.left) - _h(n.right)
    if lean > 1:
        if _h(n.left.left) < _h(n.left.right):
            n.left = _turn_left(n.left)
        return _turn_right(n)
    if lean < -1:
        if _h(n.right.right) < _h(n.right.left):
            n.right = _turn_right(n.right)
        return _turn_left(n)
    return n


def _turn_left(n: _Node) -> _Node:
    up = n.right
    n.right, up.left = up.left, n
    n.height = 1 + max(_h(n.left), _h(n.right))
    up.height = 1 + max(_h(up.left), _h(up.right))
    return up


def _turn_right(n: _Node) -> _Node:
    up = n.left
    n.left, up.right = up.right, n
    n.height = 1 + max(_h(n.left), _h(n.right))
    up.height = 1 + max(_h(up.left), _h(up.right))
    return up


class CapacityTree:
    """Balanced tree from remaining capacity to the runs [first bin, bins] that have it."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: int, first: int, bins: int) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key, [[first, bins]])
            if key == n.key:
                n.runs.append([first, bins])
                return n
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return _fix(n)

        self.root = put(self.root)

    def tightest(self, size: int) -> _Node | None:
        n, best = self.root, None
        while n:
            if n.key >= size:
                best, n = n, n.left
            else:
                n = n.right
        return best

    def remove(self, key: int) -> None:
        def least(n: _Node) -> _Node:
            while n.left:
                n = n.left
            return n

        def cut(n: _Node | None, key: int) -> _Node | None:
            if n is None:
                return None
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif not n.left or not n.right:
                return n.left or n.right
            else:
                up = least(n.right)
                n.key, n.runs = up.key, up.runs
                n.right = cut(n.right, up.key)
            return _fix(n)

        self.root = cut(self.root, key)


def pack(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing over (size, count) pairs.

    Gives runs (size, first rank, last rank + 1, first bin, groups in each bin) and the number of bins: the groups of
    this size with these ranks enter the bins from `first bin` on, so many in each.
    """
    tree, runs, bins = CapacityTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        if size > capacity:
            runs.append((size, 0, count, bins, 1))
            bins += count
            continue
        while rank < count:
            node = tree.tightest(size)
            if node is None:
                room, first, free = capacity, bins, -(-(count - rank) // (capacity // size))
                bins += free
            else:
                room = node.key
                first, free = node.runs.pop(0)
                if not node.runs:
                    tree.remove(room)
            each = room // size
            full = min(free, (count - rank) // each)
            if full:
                runs.append((size, rank, rank + full * each, first, each))
                rank += full * each
                if room - each * size:
                    tree.add(room - each * size, first, full)
            first, free = first + full, free - full
            if free and rank < count and full < free + full:
                rest = count - rank
                if rest < each:
                    runs.append((size, rank, count, first, each))
                    rank = count
                    tree.add(room - rest * size, first, 1)
                    first, free = first + 1, free - 1
            if free:
                tree.add(room, first, free)
    return runs, bins


def assign(docs: DataFrame, key: list, size, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The rows of docs with shard_id and group_bytes; key: columns that name a row's indivisible group; size: bytes of a row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.write(docs.select("doc_id", F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1enull")) for k in key])).alias("group_key"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes")), "rows")
    groups = rows.groupBy("group_key").agg(F.sum("bytes").alias("group_bytes"), F.count("*").alias("n_docs"))
    groups = groups.select("*", F.greatest(F.lit(1), F.ceil(F.col("group_bytes") / unit)).cast("long").alias("units"), F.pmod(F.xxhash64("group_key"), F.lit(64)).cast("int").alias("salt"))
    groups = scratch.write(groups, "groups")
    # Ranks within a size: salted, so that a size that very many groups have is no hot partition.
    cells = groups.groupBy("units", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("units", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("units", "salt").orderBy("group_key")) - 1
    ranked = groups.withColumn("within", within).join(cells, ["units", "salt"]).select("group_key", "group_bytes", "units", (F.col("before") + F.col("within")).alias("rank"))
    # At most capacity / unit sizes reach the driver, besides those of single groups over the capacity.
    counts = [tuple(r) for r in groups.groupBy("units").agg(F.count("*").alias("n")).collect()]
    runs, _ = pack(counts, capacity // unit)
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in ("units", "lo", "hi", "first_bin", "each")])
    # A row for each run of equal bins: small, and broadcast after a check, so that a size that most groups have isn't one partition.
    runs = scratch.write(spark.createDataFrame(runs, schema), "runs")
    runs = F.broadcast(runs) if small(spark, runs) else runs
    placed = ranked.join(runs, ["units"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("group_key", "group_bytes", (F.col("first_bin") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("shard_id"))
    return rows.join(placed, "group_key").select("doc_id", "shard_id", "group_key", "bytes", "group_bytes")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of at most 16 MiB of text."""
    docs = table(spark, sf_dir, "documents")
    return assign(docs.select("doc_id", "text"), ["text"], F.octet_length("text"))
