"""Related-document packing: a nearest-neighbour graph, greedy low-degree-first paths, windows filled along the paths.

Documents are related by their key terms: the TERMS rarest words of a document among those that other documents have,
too (in lower case; ties by hash). Document frequencies are counted over all documents: those of the FREQUENT most
frequent words are sent to all tasks, the others are counted where their occurrences meet. Similarity is the Jaccard
similarity of the sets of key terms. Near copies share most of them, documents with a rare passage many, documents on
one rare subject some. Documents that share a class of terms (all its terms have the same documents) are compared
completely up to LINKS + 1 of them; in larger classes each is first compared with the LINKS that follow it in an order
that brings similar ones together and with the LINKS of the fewest terms, and so again among those that share two such
classes. Then each is compared with all that, by sizes and remaining classes, may be more similar than the last of its
NEIGHBOURS so far. Each document keeps its NEIGHBOURS most similar, exactly (of equals those of the least hash of the pair).

Paths are grown from the edges in one order: low degree first (the lesser of the two documents' numbers of
neighbours), then the most similar, then the hash of the pair. An edge is taken if it joins the ends of two paths. A
walk from document to document is the same greed but needs a component in one task, and nearly all documents are one
component; so in each round every path names its first edge, and edges that both their paths name are taken, which
gives what taking all edges in their order would. Rounds go on until at most FINISH edges are left, which one
task takes in their order. A document without neighbours is a path by itself.

Paths follow one another in packs of about PACK tokens; windows of WINDOW tokens (words) are cut along them, and a
document that crosses a border goes on in the next window.

Null, empty and blank texts have no tokens and are in no window. Very long texts are read whole and fill windows of
their own. Repeated rows are documents of their own, neighbours of one another. Documents are numbered by doc_id (nulls
last), file and row, so that the result doesn't depend on partitions. A null doc_id is kept as null. Empty tables give
no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import VISIBLE, Words, list_array, slices
from .runtime import IDENTITY, Scratch, identity, numbered, ship, source_folder, spread, table

TERMS, FREQUENT = 8, 1 << 20
LINKS, NEIGHBOURS = 8, 5
FINISH = 2_000_000
WINDOW, PACK = 2048, 1 << 21


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words of each text, sorted, the text of each, and the number of tokens of each text."""
    tokens = Words(text, VISIBLE, lower=False).count
    w = Words(text)
    h, row = w.hashes(), w.row
    o = np.lexsort((h, row))
    h, row = h[o], row[o]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new].view(np.int64), row[new], tokens


def word_counts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """word, n: partial sums over about `limit` words at once."""
    words, counts, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def summed():
        both, which = np.unique(np.concatenate([words, *more]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([counts, np.ones(len(which) - len(words), np.int64)]), minlength=len(both)).astype(np.int64)
        more.clear()
        return both, n

    def out():
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["word", "n"])

    for batch in slices(batches):
        more.append(distinct_words(batch.column("text"))[0])
        if sum(map(len, more)) > limit // 2:
            words, counts = summed()
            if len(words) > limit:
                yield out()
                words, counts = words[:0], counts[:0]
    words, counts = summed()
    yield out()


def candidates(batches: Iterator[pa.RecordBatch], known: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """me, tokens, word, df, rare: of each document all words that aren't known (rare), and of the known ones the TERMS rarest that others have, too."""
    for batch in slices(batches):
        word, row, tokens = distinct_words(batch.column("text"))
        n = len(tokens)
        at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
        found = known[at] == word if len(known) else np.zeros(len(word), bool)
        f = np.where(found, df[at], 0) if len(known) else np.zeros(len(word), np.int64)
        some = np.flatnonzero(found & (f > 1))
        some = some[np.lexsort((word[some], f[some], row[some]))]
        first = np.searchsorted(row[some], np.arange(n))
        some = some[np.arange(len(some)) - first[row[some]] < TERMS]
        lists = [list_array(x[at], np.bincount(row[at], minlength=n), pa.int64()) for x, at in ((word, some), (f, some), (word, np.flatnonzero(~found)))]
        yield pa.RecordBatch.from_arrays([batch.column("me"), pa.array(tokens), *lists], ["me", "tokens", "word", "df", "rare"])


def key_terms(docs: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """rid, doc_id, tokens, ord (the least hash of a term), n, terms of all documents with tokens."""
    spark = docs.sparkSession
    scan = spark.read.parquet(source_folder(docs, scratch))
    # The texts are read twice: a table of the hashes of all their words would be larger than the texts in Parquet.
    counts = spread(scan.select("text")).mapInArrow(word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))
    counts = scratch.write(counts.where("df > 1").withColumn("bin", F.floor(16 * F.log2("df")).cast("int")), "counts")
    # As many bins of the most frequent words as have no more than `frequent` together: 16 bytes a word for the driver and the tasks.
    least, words = 1 << 30, 0
    for r in counts.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():  # a thousand bins at most
        words += r["n"]
        if words > frequent:
            break
        least = r["bin"]
    top = counts.where(F.col("bin") >= least).select("word", "df").toArrow()  # columns, not a Row object a word
    scratch.drop(counts)
    word, df = top["word"].to_numpy(), top["df"].to_numpy()
    o = np.argsort(word)
    known = spark.sparkContext.broadcast((word[o], df[o]))
    texts = spread(scan.select("text", identity(scan).alias("me")))
    found = texts.mapInArrow(lambda b: candidates(b, *known.value), f"me {IDENTITY}, tokens long, word array<long>, df array<long>, rare array<long>").where("tokens > 0")
    found = scratch.write(found.withColumn("t", F.monotonically_increasing_id()), "candidates")
    rare = found.select("t", F.explode("rare").alias("word")).withColumn("df", F.count("*").over(Window.partitionBy("word"))).where("df > 1")
    rare = rare.groupBy("t").agg(F.collect_list(F.struct("df", "word")).alias("more"))
    rows = found.select("t", "me", "tokens", F.arrays_zip("df", "word").alias("k")).join(rare, "t", "left")
    rarest = F.slice(F.array_sort(F.when(F.col("more").isNull(), F.col("k")).otherwise(F.concat("k", "more"))), 1, TERMS).alias("k")
    rows = numbered(rows.select("me", "tokens", rarest).select("me", "tokens", F.col("k.word").alias("terms")), "me", "rid", scratch)
    scratch.drop(found)
    order = F.coalesce(F.shiftrightunsigned(F.array_min(F.transform("terms", lambda x: F.xxhash64(x))), 40), F.lit(0))
    return scratch.write(rows.select("rid", F.col("me.doc_id").alias("doc_id"), "tokens", order.alias("ord"), F.size("terms").cast("long").alias("n"), "terms"), "terms")


def neighbours(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, similarity: each document's nearest; rows: rid, ord, n, terms."""
    # Terms with the same documents are one class, with its number of terms in w.
    post = rows.select("rid", "ord", "n", F.explode("terms").alias("p"))
    of = Window.partitionBy("p")
    mark = [F.bit_xor(F.xxhash64("rid", F.lit(i))).over(of) for i in range(2)]
    size = F.count("*").over(of)
    shared = post.select("rid", "ord", "n", size.alias("df"), F.xxhash64(size, *mark).alias("k")).where("df > 1")
    classes = shared.repartition("rid").groupBy("rid", "ord", "n", "k").agg(F.count("*").alias("w"), F.first("df").alias("df"))
    classes = scratch.write(classes.withColumn("large", F.max(F.col("df") > LINKS + 1).over(Window.partitionBy("rid"))), "classes")
    # Documents that share two large classes: keys of two that follow one another in a document's list.
    large = classes.where(F.col("df") > LINKS + 1)
    after = F.lead("k").over(Window.partitionBy("rid").orderBy("k"))
    twice = large.withColumn("next", after).where("next is not null").select("rid", "ord", "n", F.xxhash64("k", "next").alias("k"))
    twice = twice.withColumn("df", F.count("*").over(Window.partitionBy("k"))).where("df > 1").select("k", "rid", "ord", "n", F.lit(0).cast("long").alias("w"), F.lit(True).alias("large"))
    # Each with those that follow it in the order of likeness. Small classes are complete, so that their terms are summed
    # here; what two documents have in common in large ones is looked up.
    small = classes.select("k", "rid", "ord", "n", F.when(F.col("df") > LINKS + 1, 0).otherwise(F.col("w")).alias("w"), "large")
    w = Window.partitionBy("k").orderBy("ord", "rid")
    me = F.struct("rid", "n", "large")
    follow = small.unionByName(twice).select(me.alias("x"), "w", F.collect_list(me).over(w.rowsBetween(1, LINKS)).alias("ys")).select("x", "w", F.explode("ys").alias("y"))
    # In large classes each also with the documents of the fewest terms: at one class in common they are the most similar.
    least = large.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("n", "rid"))).where(F.col("r") <= LINKS).select("k", me.alias("y"))
    pairs = follow.unionByName(large.select("k", me.alias("x")).join(least, "k").select("x", F.lit(0).cast("long").alias("w"), "y")).where("x.rid != y.rid")
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "w")
    about = F.expr("x.n * 16777216 + y.n * 2 + if(x.large and y.large, 1, 0)").alias("about")  # one number moves instead of three
    pairs = pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), about, "w").groupBy("a", "b", "about").agg(F.sum("w").alias("c"))
    pairs = scratch.write(pairs.select("a", "b", F.expr("about div 16777216 as na"), F.expr("about div 2 % 8388608 as nb"), F.expr("about % 2 = 1 as both"), "c"), "pairs")
    lists = large.groupBy("rid").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    side = lambda c: lists.select(F.col("rid").alias(c), F.col("n").alias(f"n{c}"), F.col("m").alias(f"m{c}"))
    common = F.aggregate(F.array_intersect(F.map_keys("ma"), F.map_keys("mb")), F.lit(0).cast("long"), lambda t, k: t + F.element_at("ma", k))
    looked_up = lambda df: df.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", (F.col("c") + common).alias("c"))
    ratio = (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity")
    order = [F.desc("similarity"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), "b"]
    best = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("r") <= NEIGHBOURS)
    mutual = lambda df: df.union(df.select("b", "a", "similarity"))
    found = pairs.where("not both").select("a", "b", "na", "nb", "c").unionByName(looked_up(pairs.where("both").drop("na", "nb")))
    found = scratch.write(best(mutual(found.select("a", "b", ratio))), "nearest")
    # What is found so far bounds the rest: all pairs that may be more similar than a document's last. They meet in large classes alone.
    last = found.where(F.col("r") == NEIGHBOURS).select(F.col("a").alias("rid"), F.col("similarity").alias("least"))
    rest = F.sum("w").over(Window.partitionBy("rid").orderBy(F.desc("df"), F.desc("k")))
    open_ = classes.where("large").withColumn("rest", rest).where(F.col("df") > LINKS + 1).join(last, "rid", "left")
    open_ = open_.select("k", "rid", "n", "rest", F.coalesce("least", F.lit(0.0)).alias("least")).repartition("k")
    more = scratch.write(open_.mapInArrow(probes, "a long, b long").distinct().join(pairs.where("both").select("a", "b"), ["a", "b"], "left_anti"), "more")
    closer = looked_up(more.withColumn("c", F.lit(0).cast("long"))).select("a", "b", ratio)
    out = scratch.write(best(found.select("a", "b", "similarity").union(mutual(closer))).select("a", "b", "similarity"), "neighbours")
    for done in (pairs, found, more):
        scratch.drop(done)
    return out


def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within a class that may be more similar than the `least` that one of them has; a partition holds whole classes.

    `rest` is the number of a document's terms in this class and those after it, classes being in one order
    (rarest first) for all. The first class that two documents share bounds what they have in common by both rests.
    """
    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    k, rid, n, rest, least = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("k", "rid", "n", "rest", "least"))
    o = np.lexsort((n, k))
    k, rid, n, rest, least = k[o], rid[o], n[o], rest[o], least[o]
    # Sizes that another document may have: more than least x n, less than where all of rest in common isn't enough.
    base = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) << 40
    with np.errstate(divide="ignore"):
        top = np.minimum(np.where(least > 0, rest * (1 + 1 / least) - n, np.inf), (1 << 40) - 2)
    lo = np.searchsorted(base + n, base + np.floor(least * n * (1 - 1e-9)).astype(np.int64))
    hi = np.searchsorted(base + n, base + np.ceil(np.maximum(top, 0)).astype(np.int64), "right")
    count = np.maximum(hi - lo, 0)
    piece = np.cumsum(count) >> 20
    for at in np.split(np.arange(len(k)), np.flatnonzero(np.diff(piece)) + 1):
        a = np.repeat(at, count[at])
        b = np.repeat(lo[at] - (np.cumsum(count[at]) - count[at]), count[at]) + np.arange(len(a))
        c = np.minimum(np.minimum(rest[a], rest[b]), n[b])
        ok = (c > least[a] * (n[a] + n[b] - c) * (1 + 1e-12)) & (rid[a] != rid[b])
        a, b = rid[a[ok]], rid[b[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


_PATH = ("label", "round", "size", "head", "tail")


def chains(a: np.ndarray, b: np.ndarray, tails: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, ...]:
    """Takes edges in their order if they join ends of two paths: path, label, round, offset, flip of each path that was joined.

    a, b: the labels of each edge's paths; tails: whether it meets a's tail (1) and b's (2); info: a row of _PATH for each label, in order.
    Flat arrays of numbers, so that an edge takes some 20 bytes and a path some 150.
    """
    label = info[:, 0]
    unit_a, unit_b = (np.searchsorted(label, x).astype(np.int32) for x in (a, b))
    flat = lambda x: array("q", np.ascontiguousarray(x, np.int64).tobytes())
    # The sides of a path: 0 the head, 1 the tail; the one document of a single has both. links has both sides of each path.
    single = (info[:, 3] == info[:, 4]).tobytes()
    root, links = flat(np.arange(len(label))), array("q", [-1]) * (2 * len(label))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(tails), 1 << 12):
        piece = slice(at, at + (1 << 12))
        for a, b, tail in zip(unit_a[piece].tolist(), unit_b[piece].tolist(), tails[piece].tolist()):
            i, j = tail & 1, tail >> 1
            if single[a]:
                i = 1 if links[2 * a] >= 0 else 0
            if single[b]:
                j = 1 if links[2 * b] >= 0 else 0
            if links[2 * a + i] >= 0 or links[2 * b + j] >= 0:
                continue
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                links[2 * a + i], links[2 * b + j] = 2 * b + j, 2 * a + i
    size, name = flat(info[:, 2]), flat(label)
    unit, offset, path, flip = array("q"), array("q"), array("q"), bytearray()
    done = bytearray(len(label))
    for start in range(len(label)):
        head, tail = links[2 * start], links[2 * start + 1]
        if done[start] or (head >= 0) == (tail >= 0):
            continue
        at, enter, so_far, begin, low = start, 0 if head < 0 else 1, 0, len(unit), name[start]
        while True:
            done[at] = 1
            unit.append(at), offset.append(so_far), flip.append(enter)
            so_far, low = so_far + size[at], min(low, name[at])
            to = links[2 * at + 1 - enter]
            if to < 0:
                break
            at, enter = to >> 1, to & 1
        path.extend(repeat(low, len(unit) - begin))
    unit, offset, path = (np.frombuffer(x, np.int64) for x in (unit, offset, path))
    return path, label[unit], info[unit, 1].astype(np.int32), offset, np.frombuffer(flip, bool)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chains() of edges that come in their order; of each only its paths' labels and ends are kept, of each path one row."""
    edges: list[tuple[np.ndarray, ...]] = []
    seen, known = [np.zeros((0, len(_PATH)), np.int64)], 0
    whole = lambda parts: (t := np.concatenate(parts))[np.unique(t[:, 0], return_index=True)[1]]
    for batch in batches:
        of = lambda c: batch.column(c).to_numpy().astype(np.int64)  # noqa: E731, B023
        u, v, a, b = of("u"), of("v"), *(np.stack([of(f"{side}_{f}") for f in _PATH], 1) for side in "ab")
        edges.append((a[:, 0].copy(), b[:, 0].copy(), (u == a[:, 4]).astype(np.uint8) | (v == b[:, 4]).astype(np.uint8) << 1))
        seen.append(whole([a, b]))
        if sum(map(len, seen)) > 2 * known + (1 << 16):
            seen = [whole(seen)]
            known = len(seen[0])
    if edges:
        out = [pa.array(c) for c in chains(*(np.concatenate(c) for c in zip(*edges)), whole(seen))]
        for part in pa.Table.from_arrays(out, ["path", "label", "round", "offset", "flip"]).to_batches(1 << 16):
            yield part


def cover(edges: DataFrame, scratch: Scratch, finish: int = FINISH) -> DataFrame:
    """rid, path (its least rid), place of all documents on paths of several; edges: a, b, similarity."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    own = lambda c: F.struct(F.col(c).alias("label"), F.lit(0).alias("round"), F.lit(1).cast("long").alias("size"), F.col(c).alias("head"), F.col(c).alias("tail"))
    cur = edges.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    cur = cur.select(F.least("da", "db").alias("d"), (-F.col("similarity")).alias("s"), F.xxhash64("a", "b").alias("h"), F.col("a").alias("u"), F.col("b").alias("v"), own("a").alias("A"), own("b").alias("B"))
    cur = scratch.write(cur, "open")
    taken: list[DataFrame] = []
    while cur.count() > finish:
        key = F.struct("d", "s", "h", "u", "v", "A", "B").alias("key")
        best = cur.select(key, F.explode(F.array("A.label", "B.label")).alias("p")).groupBy("p").agg(F.min("key").alias("key"))
        both = best.groupBy("key").agg(F.count("*").alias("n")).where("n = 2").select("key.*")
        flip_a, flip_b = F.expr("A.head = u and A.head != A.tail"), F.expr("B.tail = v and B.head != B.tail")
        head, tail = F.when(flip_a, F.col("A.tail")).otherwise(F.col("A.head")), F.when(flip_b, F.col("B.head")).otherwise(F.col("B.tail"))
        new = F.struct(F.least("A.label", "B.label").alias("label"), F.lit(len(taken) + 1).alias("round"), F.expr("A.size + B.size").alias("size"), head.alias("head"), tail.alias("tail"))
        both = scratch.write(both.select("u", "v", "A", "B", flip_a.alias("flip_a"), flip_b.alias("flip_b"), new.alias("C")), "taken")
        taken.append(both)
        ends = both.select(F.col("A.label").alias("old"), F.col("u").alias("used"), "C").union(both.select("B.label", "v", "C"))
        on = lambda side: ends.toDF(f"old_{side}", f"used_{side}", f"new_{side}")
        left = cur.join(on("a"), F.col("A.label") == F.col("old_a"), "left").join(on("b"), F.col("B.label") == F.col("old_b"), "left")
        left = left.where(~F.coalesce(F.expr("used_a = u and A.head != A.tail"), F.lit(False)) & ~F.coalesce(F.expr("used_b = v and B.head != B.tail"), F.lit(False)))
        left = left.select("d", "s", "h", "u", "v", F.coalesce("new_a", "A").alias("A"), F.coalesce("new_b", "B").alias("B")).where("A.label != B.label")
        rest = scratch.write(left, "open")
        scratch.drop(cur)
        cur = rest
    flat = cur.select("d", "s", "h", "u", "v", *[F.col(f"{side.upper()}.{f}").alias(f"{side}_{f}") for side in "ab" for f in _PATH])
    flat = flat.coalesce(1).sortWithinPartitions("d", "s", "h", "u", "v").drop("d", "s", "h")
    found = [scratch.write(flat.mapInArrow(_chains, "path long, label long, round int, offset long, flip boolean"), "chains")]
    for n in range(len(taken), 0, -1):  # from the last joins back to documents
        above = found[0]
        for f in found[1:]:
            above = above.unionByName(f)
        above = above.where(F.col("round") == n)
        both = taken[n - 1].withColumn("label", F.col("C.label")).join(above, "label", "left")
        both = both.withColumns({"path": F.coalesce("path", "label"), "offset": F.coalesce("offset", F.lit(0).cast("long")), "flip": F.coalesce("flip", F.lit(False))})
        part = lambda side, other, first: F.struct(F.col(f"{side}.label").alias("label"), F.col(f"{side}.round").alias("round"), (F.col("offset") + F.when(F.col("flip") == first, F.col(f"{other}.size")).otherwise(0)).alias("offset"), (F.col("flip") != F.col(f"flip_{side.lower()}")).alias("flip"))
        found.append(scratch.write(both.select("path", F.explode(F.array(part("A", "B", True), part("B", "A", False))).alias("x")).select("path", "x.*"), "parts"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = scratch.write(out.where("round = 0").select(F.col("label").alias("rid"), "path", F.col("offset").alias("place")), "placed")
    # A path begins at the lesser of its ends.
    ends = out.groupBy("path").agg(F.min_by("rid", "place").alias("head"), F.max_by("rid", "place").alias("tail"), F.max("place").alias("last"))
    return out.join(ends, "path").select("rid", "path", F.expr("if(head < tail, place, last - place)").alias("place"))


def pack(docs: DataFrame, window: int = WINDOW, finish: int = FINISH) -> DataFrame:
    """pack, window, offset, doc_id, path, place, start_token, end_token (within the document)."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = key_terms(docs, scratch)
    near = neighbours(rows.select("rid", "ord", "n", "terms"), scratch)
    edges = scratch.write(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct(), "graph")
    walked = scratch.write(cover(edges, scratch, finish), "paths")
    placed = rows.select("rid", "doc_id", "tokens").join(walked, "rid", "left").select("doc_id", "tokens", "rid", F.coalesce("path", "rid").alias("path"), F.coalesce("place", F.lit(0)).alias("place"))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    placed = placed.withColumn("pack", F.pmod(F.xxhash64("path"), F.lit(max(1, -(-total // PACK)))))
    sofar = F.sum("tokens").over(Window.partitionBy("pack").orderBy("path", "place", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = placed.withColumn("stop", sofar).withColumn("begin", F.col("stop") - F.col("tokens"))
    out = spans.select("*", F.explode(F.sequence(F.floor(F.col("begin") / window), F.floor((F.col("stop") - 1) / window))).alias("window"))
    lo, hi = F.greatest(F.col("begin"), F.col("window") * window), F.least(F.col("stop"), (F.col("window") + 1) * window)
    return out.select("pack", "window", (lo - F.col("window") * window).alias("offset"), "doc_id", "path", "place", (lo - F.col("begin")).alias("start_token"), (hi - F.col("begin")).alias("end_token"))


def op3_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's pieces of documents in their order."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
