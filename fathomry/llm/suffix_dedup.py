"""Repeated passages by merging the Burrows-Wheeler transforms of shards.

Texts are sequences of words (lower case; letters, digits, underscore). A passage of LENGTH words that two documents
share holds a common anchor: the least hash of its word 12-grams. Anchors that one document alone has are dropped,
which loses nothing; each other anchor takes the suffixes whose first LENGTH words have it as their least, with those
words. Suffixes that share LENGTH words thus meet under one anchor, and anchors are distributed.

A task handles some anchors at a time. Equal segments of an anchor become one string with their number. The strings
are split into shards by document. Each shard's suffixes are sorted for its multi-string transform; then the
transforms alone are merged: the interleave starts with the first symbols, shard after shard, and is refined by stable
passes along the transforms, after pass h being right for h + 1 symbols. A border that first appears in pass h has a
common prefix of h, so the passes give the prefix lengths and, after LENGTH passes, the repeated intervals: runs
without a border. No suffixes are sorted again; blocks of one suffix are settled and take part in no further pass.

Anchors of more than HOT documents don't fit a task: their windows of LENGTH words are grouped by two 64-bit hashes
instead, which gives the same intervals.

Symbols are 32-bit word hashes; two passages would have to collide in a different word to be taken as equal. A
result is a maximal stretch of a document covered by passages that other documents have too; other_doc_id is the
first of those by doc_id. `within`: repeats in one document alone count too (the query reports those across documents).
Null, empty and short texts have none. Very long texts are cut into segments like others. Repeated rows are documents
of their own. A null doc_id is kept as null and comes last. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import Words, hash_ranges, list_array, mix, shingles, slices, winnow
from .runtime import IDENTITY, Scratch, identity, semi, ship, source_folder, spread, table

LENGTH, GRAM = 50, 12
SHARDS, CHUNK, HOT = 4, 300_000, 20_000
#: Factors of the two hashes of a hot anchor's windows.
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def anchors(arr: pa.Array, gram: int = GRAM, length: int = LENGTH):
    """Words, word hashes, and of each anchor: hash, row, first and last suffix that it takes (indices of words)."""
    w = Words(arr)
    h = w.hashes()
    g, n = shingles(h, w.count, gram)
    stretch = length - gram + 1
    n_ok = np.where(w.count >= length, n, 0)
    first_g, first_w = np.cumsum(n) - n, np.cumsum(w.count) - w.count
    use = np.repeat(n_ok > 0, n)
    at, count = winnow(g[use], n_ok, stretch)
    at = np.flatnonzero(use)[at]
    row = np.repeat(np.arange(len(n)), count)
    # Suffix p has the last least gram of p .. p + stretch - 1: an anchor takes those from after where the next smaller ends.
    local = at - first_g[row]
    lo, hi = _taken(g, at, local, n[row], stretch)
    return w, h, g[at], row, first_w[row] + lo, first_w[row] + hi


def _taken(g: np.ndarray, at: np.ndarray, local: np.ndarray, n: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of suffix starts (within the row) whose least gram, the last of equals, is the one at `local`."""
    left, right = np.zeros(len(at), np.int64), np.full(len(at), stretch - 1)
    mine = g[at]
    for d in range(1, stretch):
        back = local >= d
        smaller = back & (g[np.maximum(at - d, 0)] < mine)
        left = np.where((left == 0) & smaller, d, left)
        fore = local + d < n
        smaller = fore & (g[np.minimum(at + d, len(g) - 1)] <= mine)
        right = np.where((right == stretch - 1) & smaller, np.minimum(d - 1, right), right)
    reach = np.where(left > 0, left - 1, stretch - 1)
    lo = np.maximum(local - reach, 0)
    lo = np.maximum(lo, local - stretch + 1)
    hi = np.minimum(local, local + right - stretch + 1)
    return np.maximum(lo, 0), np.minimum(np.minimum(hi, local), n - stretch)


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling over the groups that are still tied; the last symbol of each string is its own."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    border = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(border, np.arange(n), 0))
    h = 1
    while True:
        group = rank[order]
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos, g = order[at], group[at]
        key = g * n + rank[pos + h]
        o = np.argsort(key, kind="stable")
        pos, key = pos[o], key[o]
        order[at] = pos
        border = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(border, at, 0))
        h *= 2


def merge(bwts: list[np.ndarray], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms (0: end of a string) as shard numbers, and each row's common prefix with the one before, `depth` at most.

    A row's symbol sends it to its own shard's row of the suffix that begins one symbol earlier; these places are
    counted once. A pass distributes the rows, in the order of the interleave, over the blocks that they send to.
    Blocks of one row are settled: later passes leave them where they are.
    """
    first = np.cumsum([0, *map(len, bwts)])
    n = int(first[-1])
    after, symbol = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # the row of the suffix without its first symbol
    for s, (b, m) in enumerate(zip(bwts, strings)):
        at = np.flatnonzero(b)
        key = np.sort(b[at] << 32 | at)
        after[first[s] + m : first[s + 1]] = first[s] + (key & 0xFFFFFFFF)
        symbol[first[s] + m : first[s + 1]] = key >> 32
    before = np.full(n, -1, np.int64)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    key = np.sort(symbol << 32 | np.arange(n))
    order, symbol = key & 0xFFFFFFFF, key >> 32  # row at each place
    border = np.ones(n, bool)
    border[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)
    prefix = np.where(border, 0, depth).astype(np.int16)
    place, block = np.empty(n, np.int64), np.empty(n, np.int64)  # of each row: its place, and that of the first row of its block
    place[order] = np.arange(n)
    block[order] = np.maximum.accumulate(np.where(border, np.arange(n), 0))
    slots = np.flatnonzero(~border | ~np.append(border[1:], True))  # places in blocks of several rows
    for h in range(1, depth):
        if not len(slots):
            break
        row = order[slots]
        key = np.sort(block[row] << 32 | place[after[row]])
        source = order[key & 0xFFFFFFFF]
        row, old, far = before[source], key >> 32, block[source]
        border = np.ones(len(slots), bool)
        border[1:] = (old[1:] != old[:-1]) | (far[1:] != far[:-1])
        prefix[slots[border & (prefix[slots] == depth)]] = h
        order[slots], place[row] = row, slots
        block[row] = slots[np.maximum.accumulate(np.where(border, np.arange(len(slots)), 0))]
        slots = slots[~border | ~np.append(border[1:], True)]
    return (np.searchsorted(first, order, side="right") - 1).astype(np.int8), prefix


def repeats(symbols: np.ndarray, off: np.ndarray, doc: np.ndarray, anchor_starts: np.ndarray, length: int, shards: int = SHARDS, high: np.ndarray | None = None, weight: np.ndarray | None = None, within: bool = False):
    """Of segments (symbols between offsets; the first anchor_starts[i] positions count): segment, position, least and greatest document, occurrences.

    A segment may stand for `weight` equal ones, of documents from doc to `high`. within: also repeats in one document.
    """
    high, weight = doc if high is None else high, np.ones(len(doc), np.int64) if weight is None else weight
    _, dense = np.unique(symbols, return_inverse=True)
    dense = dense.astype(np.int64) + 1
    n = np.diff(off)
    of = np.abs(doc) % shards if shards > 1 else np.zeros(len(doc), np.int64)
    bwts, counts, seg_of, pos_of = [], [], [], []
    for s in range(shards):
        mine = np.flatnonzero(of == s)
        size = n[mine] + 1
        start = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(mine)), size)
        pos = np.arange(int(size.sum())) - start[seg]
        t = np.zeros(len(pos), np.int64)
        body = pos < n[mine][seg]
        t[body] = dense[off[:-1][mine][seg[body]] + pos[body]] + len(mine)
        t[~body] = seg[~body]  # string i ends with symbol i
        order = suffix_order(t) if len(t) else np.zeros(0, np.int64)
        last = t[order - 1]
        bwts.append(np.where(last < len(mine), 0, last - len(mine)) if len(t) else last)
        counts.append(len(mine))
        seg_of.append(mine[seg[order]])
        pos_of.append(pos[order])
    shard, prefix = merge(bwts, counts, length)
    seg, pos = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for s in range(shards):
        here = shard == s
        seg[here], pos[here] = seg_of[s], pos_of[s]
    block = np.cumsum(prefix < length) - 1
    first = np.flatnonzero(prefix < length)
    if not len(first):
        return seg, pos, seg, seg, seg
    low, top, size = np.minimum.reduceat(doc[seg], first), np.maximum.reduceat(high[seg], first), np.add.reduceat(weight[seg], first)
    hit = ((low != top) | (within & (size > 1)))[block] & (pos < anchor_starts[seg])
    b = block[hit]
    return seg[hit], pos[hit], low[b], top[b], size[b]


def distinct(words: np.ndarray, off: np.ndarray, anchor: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the segments of each content (anchor, number of starts and all words), and each segment's place among those."""
    h = hash_ranges(words.view(np.uint8), off[:-1] * 4, off[1:] * 4) ^ mix(anchor.view(np.uint64) + starts.astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    n, twin = np.diff(off), first[which]
    same = (n == n[twin]) & (starts == starts[twin]) & (anchor == anchor[twin])
    at = np.flatnonzero(same & (twin != np.arange(len(n))))
    size = n[at]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wrong = words[np.repeat(off[:-1][at], size) + step] != words[np.repeat(off[:-1][twin[at]], size) + step]
    same[np.repeat(at, size)[wrong]] = False
    other = np.flatnonzero(~same)  # a collision of hashes: each for itself
    which[other] = len(first) + np.arange(len(other))
    return np.append(first, other), which


def intervals(words: np.ndarray, off: np.ndarray, doc: np.ndarray, anchor: np.ndarray, starts: np.ndarray, length: int = LENGTH, within: bool = False):
    """Runs of starts of repeated passages: segment, first position, last position, least and greatest document, occurrences.

    Equal segments are one string with their number; an anchor all of whose segments are equal needs no merge.
    """
    one, which = distinct(words, off, anchor, starts)
    weight = np.bincount(which, minlength=len(one))
    o = np.argsort(which, kind="stable")
    begin = np.cumsum(weight) - weight
    low, high = np.minimum.reduceat(doc[o], begin), np.maximum.reduceat(doc[o], begin)
    _, of, strings = np.unique(anchor[one], return_inverse=True, return_counts=True)
    lone = strings[of] == 1
    whole = np.flatnonzero(lone & ((low != high) | (within & (weight > 1))))
    found = [(whole, np.zeros(len(whole), np.int64), starts[one[whole]] - 1, low[whole], high[whole], weight[whole])]
    # A segment of several starts may repeat within itself, so that within a document even a lone one is merged.
    several = np.flatnonzero(~lone | within)
    if len(several):
        s = one[several]
        size = np.diff(off)[s]
        cut = np.concatenate([[0], np.cumsum(size)])
        text = words[np.repeat(off[:-1][s] - cut[:-1], size) + np.arange(cut[-1])]
        seg, pos, lo, hi, n = repeats(text, cut, low[several], starts[s], length, high=high[several], weight=weight[several], within=within)
        order = np.lexsort((pos, seg))
        seg, pos, lo, hi, n = seg[order], pos[order], lo[order], hi[order], n[order]
        fresh = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (pos[1:] != pos[:-1] + 1)])) if len(seg) else np.zeros(0, np.int64)
        if len(fresh):
            last = np.append(fresh[1:], len(seg)) - 1
            found.append((several[seg[fresh]], pos[fresh], pos[last], np.minimum.reduceat(lo, fresh), np.maximum.reduceat(hi, fresh), np.maximum.reduceat(n, fresh)))
    unit, *rest = (np.concatenate(c) for c in zip(*found))
    times = weight[unit]
    member = o[np.repeat(begin[unit] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    return member, *(np.repeat(c, times) for c in rest)


def anchor_lists(batches: Iterator[pa.RecordBatch], within: bool = False) -> Iterator[pa.RecordBatch]:
    """The anchors of each row, each once; within: as often as they occur."""
    for batch in slices(batches):
        _, _, g, row, _, _ = anchors(batch.column("text"))
        key = np.stack([row.astype(np.uint64), g], axis=1)
        key = np.unique(key, axis=0) if len(g) and not within else key
        count = np.bincount(key[:, 0].astype(np.int64), minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("me"), list_array(key[:, 1].view(np.int64), count, pa.int64())], ["me", "anchors"])


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, anchor, start, starts, words (binary; empty: hot) and, of hot anchors, two hashes of every window."""
    for batch in slices(batches):
        w, h, g, row, lo, hi = anchors(batch.column("text"))
        wanted, n = _flat(batch.column("shared"))
        hot, n_hot = _flat(batch.column("hot"))
        here = _member(g, row, wanted, n)
        g, row, lo, hi = g[here], row[here], lo[here], hi[here]
        is_hot = _member(g, row, hot, n_hot)
        first_w = np.cumsum(w.count) - w.count
        rid = np.asarray(batch.column("rid"))[row]
        size = np.where(is_hot, 0, hi - lo + LENGTH)
        take = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        words = (h[take] >> np.uint64(32)).astype(np.uint32) if len(take) else np.zeros(0, np.uint32)
        data = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)), pa.py_buffer(words)])
        count = np.where(is_hot, hi - lo + 1, 0)
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        windows = [np.zeros(len(at), np.uint64) for _ in _ODD]
        for j in range(LENGTH if len(at) else 0):
            windows = [(w ^ h[at + j]) * c + (w >> np.uint64(31)) for w, c in zip(windows, _ODD)]
        lists = [list_array(w.view(np.int64), count, pa.int64()) for w in windows]
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(g.view(np.int64)), pa.array((lo - first_w[row]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), data, *lists], ["rid", "anchor", "start", "starts", "words", "windows", "checks"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64), n


def _member(g: np.ndarray, row: np.ndarray, wanted: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each row's own list holds the hash."""
    if not len(wanted) or not len(g):
        return np.zeros(len(g), bool)
    salt = lambda r: mix(r.astype(np.uint64) + np.uint64(1))
    return np.isin(g ^ salt(row), wanted ^ salt(np.repeat(np.arange(len(n)), n)))


def merged(batches: Iterator[pa.RecordBatch], within: bool = False) -> Iterator[pa.RecordBatch]:
    """Segments ordered by anchor -> intervals: rid, start, stop, low, high, documents."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda c: np.asarray(t.column(c).combine_chunks()).astype(np.int64)
        data = t.column("words").combine_chunks().cast(pa.large_binary())
        off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        words = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32)
        doc, start = col("rid"), col("start")
        seg, first, last, low, high, copies = intervals(words, (off - off[0]) // 4, doc, col("anchor"), col("starts"), within=within)
        columns = [doc[seg], start[seg] + first, start[seg] + last + LENGTH, low, high, copies]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["rid", "start", "stop", "low", "high", "copies"])

    waiting: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column("anchor"))
        n = np.asarray(pc.binary_length(batch.column("words")), dtype=np.int64) // 4
        cuts = np.flatnonzero(np.concatenate([[anchor[0] != last], anchor[1:] != anchor[:-1]]))
        begin = 0
        total = np.concatenate([[0], np.cumsum(n)])
        for c in cuts:
            if size + total[c] - total[begin] >= CHUNK:
                if c > begin:
                    waiting.append(batch.slice(begin, c - begin))
                if waiting:
                    yield solve(waiting)
                waiting, size, begin = [], 0, c
        waiting.append(batch.slice(begin))
        size += int(total[-1] - total[begin])
        last = anchor[-1]
    if waiting:
        yield solve(waiting)


def passages(spark: SparkSession, docs: DataFrame, hot: int = HOT, within: bool = False) -> DataFrame:
    """doc_id, start_word, end_word, other_doc_id, copies of every stretch that other documents (within: or other places) have too."""
    ship(spark)
    scratch = Scratch(spark)
    path = source_folder(docs, scratch)
    scan = spark.read.parquet(path)
    scan = scan.select("text", identity(scan).alias("me"))
    rows = spread(scan).mapInArrow(lambda b: anchor_lists(b, within), f"me {IDENTITY}, anchors array<long>").where("size(anchors) > 0")
    # Numbered in the order of doc_id, so that the result doesn't depend on files and partitions.
    rows = scratch.write(scratch.write(rows, "lists").orderBy("me").withColumn("rid", F.monotonically_increasing_id()), "anchors")
    single = rows.select("rid", F.explode("anchors").alias("anchor"))
    shared = single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    of = single.join(shared, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"))
    wanted = scratch.write(of.join(rows.select("rid", "me"), "rid").select("rid", "me", "shared", "hot"), "shared")
    texts = semi(scan, wanted, ["me"], "inner").select("text", "rid", "shared", "hot")
    found = texts.mapInArrow(segments, "rid long, anchor long, start int, starts int, words binary, windows array<long>, checks array<long>")
    found = scratch.write(found, "segments")
    cold = found.where("size(windows) = 0").select("rid", "anchor", "start", "starts", "words").repartition("anchor").sortWithinPartitions("anchor")
    spans = cold.mapInArrow(lambda b: merged(b, within), "rid long, start long, stop long, low long, high long, copies long")
    warm = found.where("size(windows) > 0").select("rid", "anchor", "start", "checks", F.posexplode("windows").alias("k", "w")).select("rid", (F.col("start") + F.col("k")).cast("long").alias("start"), "anchor", "w", F.get("checks", "k").alias("v"))
    same = warm.groupBy("anchor", "w", "v").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("copies")).where("copies > 1" if within else "low != high")
    spans = spans.unionByName(warm.join(same, ["anchor", "w", "v"]).select("rid", "start", (F.col("start") + LENGTH).alias("stop"), "low", "high", "copies"))
    spans = scratch.write(spans, "spans")
    sofar = F.max("stop").over(Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(sofar, F.lit(-1)) < F.col("start")).cast("int")
    island = F.sum("fresh").over(Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = spans.withColumn("fresh", fresh).withColumn("island", island).groupBy("rid", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("copies").alias("copies"))
    whole = whole.withColumn("other", F.when(F.col("low") == F.col("rid"), F.col("high")).otherwise(F.col("low")))
    name = lambda k, c: rows.select(F.col("rid").alias(k), F.col("me.doc_id").alias(c))
    return whole.join(name("rid", "doc_id"), "rid").join(name("other", "other_doc_id"), "other").select("doc_id", "start_word", "end_word", "other_doc_id", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words that another document has too."""
    return passages(spark, table(spark, sf_dir, "documents"))
