"""Sampled segmentations over the piece lattice, and lossless decoding.

The lattice of a text has an edge for each piece that matches at a byte position. Forward filtering sums the weights
of all paths to each position; backward sampling draws one segmentation with exactly its probability. Draws are
functions of the seed, the row key and the byte position, so that a row's segmentation never depends on the batch
or the partition. A piece's probability follows Zipf's law over its rank in the vocabulary, to the power ALPHA; a
byte that belongs to no piece of its character falls back to the byte's own piece.

No piece crosses the start of a run of spaces, so the lattice falls apart into units; each distinct unit is filtered
once for a few megabytes of text and all its occurrences are sampled together. (A vocabulary with other pieces
is given whole texts as units.) A space stands before each text and is removed in decoding. A literal U+2581 is
spelled in bytes, so that decoding is lossless for every text.

Edges are held for BLOCK bytes of units at a time. A unit longer than PART falls apart further, between characters that
no piece spans; a stretch that is longer still is filtered window by window: forward once, keeping the sums at each
window's border, and again from the last window back as it is sampled. So what grows with one text is the text itself
and a few numbers for each of its pieces, not its edges; and nothing is cut that a piece could span.

Null texts have null ids. An empty text has the pieces of one space. Repeated rows get the same segmentation. A null
key counts as a key of its own. The vocabulary file's path is a parameter; the driver reads it and sends the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import hash_ranges, list_array, mix, slices, strings
from .runtime import ship, spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA = 11, 1.0
#: Bytes and number of units whose occurrences are sampled together.
SLICE, UNITS = 1 << 22, 1 << 19
#: Bytes of units whose edges are held at once, and of a stretch that is filtered in one go.
BLOCK, PART = 1 << 17, 1 << 12

_U = np.uint64
_built: dict[tuple, Lattice] = {}


def vocabulary(path: str = MODEL) -> tuple[list[bytes], np.ndarray, int]:
    """Bytes of each piece (empty: never in a text), log weights, and the id of byte 0's piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, first_byte = [], -1
    for i in range(n):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        elif sp.is_byte(i):
            first_byte = i if first_byte < 0 else first_byte
            pieces.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
        else:
            pieces.append(sp.id_to_piece(i).replace("▁", " ").encode())
    normal = [i for i in range(n) if pieces[i] and not first_byte <= i < first_byte + 256]
    rank = np.full(n, float(n))
    rank[sorted(normal, key=lambda i: (-sp.get_score(i), i))] = np.arange(len(normal))
    return pieces, -ALPHA * np.log(rank + 2.7), first_byte


class Lattice:
    def __init__(self, pieces: list[bytes], log_weight: np.ndarray, first_byte: int):
        self.log_weight, self.first_byte = log_weight, first_byte
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        self.by_unit = True
        for i, p in enumerate(pieces):
            if not p or first_byte <= i < first_byte + 256:
                continue
            self.by_unit &= b" " not in p.lstrip(b" ")
            q = 0
            for c in p:
                if c not in nodes[q]:
                    nodes[q][c] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                q = nodes[q][c]
            ends[q] = i
        self.ends = np.array(ends)
        # Rows of the dense table are kept for inner nodes only; row 0 is the root, leaves share an empty row.
        inner = [q for q, kids in enumerate(nodes) if kids]
        row = np.full(len(nodes), len(inner), np.int32)
        row[inner] = np.arange(len(inner))
        self.row = row
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        for r, q in enumerate(inner):
            for c, t in nodes[q].items():
                self.next[r, c] = t
        size = np.array([len(p) for p in pieces])
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.longest = int(size.max(initial=1))
        self.part = max(PART, 4 * self.longest)

    def edges(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and piece of every match; stop: the end of each byte's unit."""
        n = len(raw)
        pos, state = np.arange(n), np.zeros(n, np.int32)
        found, length = [], 0
        lead = np.where(raw < 0x80, 1, np.where(raw >= 0xF0, 4, np.where(raw >= 0xE0, 3, np.where(raw >= 0xC0, 2, 0))))
        covered = np.zeros(n, bool)
        while len(pos):
            state = self.next[self.row[state], raw[pos + length]]
            go = state > 0
            pos, state = pos[go], state[go]
            length += 1
            piece = self.ends[state]
            hit = piece >= 0
            found.append((pos[hit], np.full(hit.sum(), length), piece[hit]))
            covered[pos[hit & (lead[pos] == length)]] = True
            go = pos + length < stop[pos]
            pos, state = pos[go], state[go]
        head = np.maximum.accumulate(np.where(lead > 0, np.arange(n), 0))
        bare = np.flatnonzero(~covered[head])
        found.append((bare, np.ones(len(bare), np.int64), self.first_byte + raw[bare].astype(np.int64)))
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        return start, start + size, piece

    def filter(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """For all units (off: their offsets): edges as (start, piece, border), where each position's edges begin, and log sums.

        The edges that end at one position follow one another, the likeliest first; an edge's border is the sum of
        the probabilities up to it.
        """
        *tables, total, cut = self.block(raw, off)
        # The sums over whole units: what was reached at earlier cuts is added.
        gain = np.where(cut, total[:-1], 0.0)
        before = np.cumsum(gain) - gain
        home = np.repeat(off[:-1] + np.arange(len(off) - 1), np.diff(off) + 1)
        total[:-1] += before - before[home]
        return *tables, total

    def block(self, raw: np.ndarray, off: np.ndarray, enter: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """As filter, but log sums count from the last cut, and the cuts are returned, too.

        enter: the position of each unit up to which (known) log sums are given; edges are those that end after it.
        """
        units, places = len(off) - 1, len(raw) + len(off) - 1
        home = off[:-1] + np.arange(units)
        enter = np.zeros(units, np.int64) if enter is None else enter
        given = np.repeat(home - (np.cumsum(enter + 1) - (enter + 1)), enter + 1) + np.arange((enter + 1).sum())
        known = np.zeros(units) if known is None else known
        unit = np.repeat(np.arange(units), np.diff(off))
        start, end, piece = self.edges(raw, off[1:][unit])
        # Units lie side by side; one of n bytes has n + 1 positions, so that ends of neighbours differ.
        shift = unit[start]
        s, e, low = start + shift, end + shift, (home + enter)[shift]
        if enter.any():
            new = e > low
            s, e, piece, low = s[new], e[new], piece[new], low[new]
        # Every path passes a position that no edge crosses: the lattice falls apart there, too, and sums start anew.
        cut = np.cumsum(np.bincount(s + 1, minlength=places + 1) - np.bincount(e, minlength=places + 1))[:places] == 0
        cut[given] = False
        cut[home + enter] = True
        step = e - np.maximum(np.maximum.accumulate(np.where(cut, np.arange(places), 0))[s], low)
        # By end within the part, the order of filtering; then by end and by size.
        o = np.argsort((step * (places + 1) + e) * (self.longest + 1) + e - s)
        s, e, piece, step = s[o], e[o], piece[o], step[o]
        w = self.log_weight[piece]
        total = np.full(places + 1, -np.inf)
        base = np.where(cut, 0.0, -np.inf)  # sums as the edges that start there see them
        total[given] = base[given] = known
        fresh = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        cuts = np.searchsorted(step[fresh], np.arange(1, step.max(initial=0) + 2))
        last = np.append(fresh, len(e))
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = last[a], last[b]
            x = base[s[lo:hi]] + w[lo:hi]
            group = last[a:b] - lo
            top = np.maximum.reduceat(x, group)
            sums = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(group, hi - lo)))), group)
            at = e[lo:hi][group]
            total[at] = top + np.log(sums)
            open_ = ~cut[at]
            base[at[open_]] = total[at[open_]]
        p = np.exp(base[s] + w - total[e])
        # The likeliest first, to 30 bits, then the shortest: equals don't depend on what else is in the block either.
        o = np.argsort(((e + 1 << 31) - (np.minimum(p, 1.0) * (1 << 30)).astype(np.int64)) * (self.longest + 1) + e - s)
        s, e, piece, border = s[o], e[o], piece[o], p[o]
        at = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        n = np.diff(np.append(at, len(e)))
        for k in range(1, n.max(initial=0)):  # sums within a position's edges: they don't depend on what else is in the block
            here = at[n > k] + k
            border[here] += border[here - 1]
        border[at + n - 1] = 2.0
        first = np.zeros(places + 1, np.int64)
        first[e[at]] = at
        return s, piece, border, first, total, cut

    def breaks(self, raw: np.ndarray, fresh: np.ndarray) -> None:
        """Mark where a unit falls apart: the starts of characters that no edge crosses."""
        for a in range(0, len(raw), BLOCK):
            b, lo, hi = min(a + BLOCK, len(raw)), max(a - self.longest, 0), min(a + BLOCK + self.longest, len(raw))
            s, e, _ = self.edges(raw[lo:hi], np.full(hi - lo, hi - lo))
            crossed = np.cumsum(np.bincount(s + 1, minlength=hi - lo + 1) - np.bincount(e, minlength=hi - lo + 1))
            fresh[a:b] |= (crossed[a - lo : b - lo] == 0) & (raw[a:b] & 0xC0 != 0x80)

    def units(self, fresh: np.ndarray, lo: int) -> tuple[np.ndarray, int]:
        """Where the next units begin, counted from lo, and where the last of them ends."""
        hi = lo + SLICE
        hi += int(np.argmax(fresh[hi:])) if fresh[hi:].any() else len(fresh) - hi
        begin = np.flatnonzero(fresh[lo:hi])
        return (begin[:UNITS], lo + int(begin[UNITS])) if len(begin) > UNITS else (begin, hi)

    def walk(self, tables: tuple[np.ndarray, ...], at: np.ndarray, low: np.ndarray, seed: np.ndarray, origin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rounds of (occurrence, its next piece), from each occurrence's position in the tables, at, down to low.

        origin turns a position into one within the text. at ends where the walk did.
        """
        s, piece, border, first = tables
        live = np.flatnonzero(at > low)
        while len(live):
            now = at[live]
            draw = mix(seed[live] + (now + origin[live]).astype(_U) * _U(0xD1342543DE82EF95)) >> _U(11)
            draw = draw * 2.0**-53
            edge = first[now]
            more = np.flatnonzero(draw >= border[edge])
            while len(more):
                edge[more] += 1
                more = more[draw[more] >= border[edge[more]]]
            yield live, piece[edge]
            at[live] = now = s[edge]
            live = live[now > low[live]]

    def stretches(self, raws: list[np.ndarray], which: np.ndarray, seed: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """walk over long stretches, window by window and side by side; which: the stretch of each occurrence, place: where it begins in its text."""

        def character(raw: np.ndarray, at: int) -> int:
            """The start of the character at a position."""
            return next((x for x in range(at, max(at - 4, 0), -1) if x == len(raw) or raw[x] & 0xC0 != 0x80), max(at, 0))

        grids = []
        for raw in raws:
            grids.append([0])
            while grids[-1][-1] < len(raw):
                grids[-1].append(character(raw, min(grids[-1][-1] + self.part, len(raw))))
        most = max(map(len, grids)) - 1
        sums = [[np.zeros(1)] for _ in raws]  # those that each window is entered with

        def window(k: int, own: list[int]) -> tuple[list[int], np.ndarray, tuple[np.ndarray, ...]]:
            lows = [grids[j][k] + 1 - len(sums[j][k]) for j in own]
            own_raw = [raws[j][lo : grids[j][k + 1]] for j, lo in zip(own, lows)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in own_raw])])
            enter = np.array([len(sums[j][k]) - 1 for j in own])
            return lows, off[:-1] + np.arange(len(own)), self.block(np.concatenate(own_raw), off, enter, np.concatenate([sums[j][k] for j in own]))

        for k in range(most - 1):
            own = [j for j in range(len(raws)) if len(grids[j]) > k + 2]
            lows, home, (*_, total, cut) = window(k, own)
            for j, lo, h in zip(own, lows, home):
                end = grids[j][k + 1]
                x, gain = total[h : h + end - lo + 1], np.where(cut[h : h + end - lo + 1], total[h : h + end - lo + 1], 0.0)
                x = x + np.cumsum(gain) - gain
                sums[j].append(x[character(raws[j], end - self.longest) - lo :] - x[-1])
        now = np.array([len(raw) for raw in raws])[which]
        for k in reversed(range(most)):
            own = [j for j in range(len(raws)) if len(grids[j]) > k + 1]
            lows, home, (*tables, _, _) = window(k, own)
            turn = np.zeros(len(raws), np.int64)
            turn[own] = home - np.array(lows)
            low = np.full(len(raws), np.iinfo(np.int64).max)
            low[own] = [grids[j][k] for j in own]
            who = np.flatnonzero(now > low[which])
            turn, low = turn[which[who]], low[which[who]]
            at = now[who] + turn
            for live, piece in self.walk(tables, at, low + turn, seed[who], place[who] - turn):
                yield who[live], piece
            now[who] = at - turn

    def draw(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and their number in each; seed: of each unit's text, place: where it begins there."""
        _, rep, which = np.unique(hash_ranges(raw, begin, stop), return_index=True, return_inverse=True)
        size = (stop - begin)[rep]
        o = np.argsort(size, kind="stable")
        turn = np.empty_like(o)
        turn[o] = np.arange(len(o))
        rep, size, which = rep[o], size[o], turn[which]
        order = np.argsort(which, kind="stable")
        short = int(np.searchsorted(size, self.part, side="right"))
        block = np.where(size <= self.part, (np.cumsum(size) - size) // BLOCK, len(raw) + np.maximum(np.arange(len(size)) - short, 0) // max(BLOCK // self.part, 1))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(size)]])
        reach = np.searchsorted(which[order], cuts)
        rounds = []
        count = np.zeros(len(begin), np.int64)
        for lo, hi, a, b in zip(cuts[:-1], cuts[1:], reach[:-1], reach[1:]):
            who, own = order[a:b], size[lo:hi]
            unit = which[who] - lo
            if lo >= short:
                found = self.stretches([raw[begin[i] : stop[i]] for i in rep[lo:hi]], unit, seed[who], place[who])
            else:
                off = np.concatenate([[0], np.cumsum(own)])
                *tables, _, _ = self.block(raw[np.repeat(begin[rep[lo:hi]] - off[:-1], own) + np.arange(off[-1])], off)
                home = off[:-1] + np.arange(len(own))  # position 0 of each distinct unit
                found = self.walk(tables, (home + own)[unit], home[unit], seed[who], place[who] - home[unit])
            for live, piece in found:
                live = who[live]
                rounds.append((live.astype(np.int32), piece.astype(np.int32)))
                count[live] += 1
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), np.int32)
        for live, piece in rounds:
            ends[live] -= 1
            ids[ends[live]] = piece
        return ids, count

    def sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number in each text."""
        raw, off = strings(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string())))
        fresh = np.zeros(len(raw), bool)
        if self.by_unit:
            fresh[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        fresh[off[:-1]] = True
        seed = mix(keys.astype(_U) + _U(SEED * 0x9E3779B97F4A7C15 % 2**64))
        found, n, lo = [np.zeros(0, np.int32)], np.zeros(len(keys), np.int64), 0
        while lo < len(raw):  # units that begin within SLICE bytes, also of one text; the last of them is whole
            begin, hi = self.units(fresh, lo)
            long = np.flatnonzero(np.diff(begin, append=hi - lo) > self.part)
            if len(long):
                for a, b in zip(lo + begin[long], lo + np.append(begin, hi - lo)[long + 1]):
                    self.breaks(raw[a:b], fresh[a:b])
                begin, hi = self.units(fresh, lo)
            stop = np.append(begin[1:], hi - lo)
            text = np.searchsorted(off, lo + begin, side="right") - 1
            ids, count = self.draw(raw[lo:hi], begin, stop, seed[text], lo + begin - off[text])
            found.append(ids)
            n += np.bincount(text, weights=count, minlength=len(keys)).astype(np.int64)
            lo = hi
        return np.concatenate(found), n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, the space before each included, and their offsets."""
        end = np.concatenate([[0], np.cumsum(self.size[ids])])
        raw = np.empty(end[-1], np.uint8)
        for a in range(0, len(ids), BLOCK):
            at = end[a : a + BLOCK + 1]
            raw[at[0] : at[-1]] = self.bytes[np.repeat(self.at[ids[a : a + BLOCK]] - (at[:-1] - at[0]), np.diff(at)) + np.arange(at[-1] - at[0])]
        return raw, end[np.concatenate([[0], np.cumsum(n)])]


def lattice(vocab: tuple) -> Lattice:
    key = (len(vocab[0]), vocab[2], hash(vocab[1].tobytes()))
    if key not in _built:
        _built[key] = Lattice(*vocab)
    return _built[key]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, lossless (decoding gives the text again)."""
    spark = docs.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocab.value)
        for batch in slices(batches, limit=SLICE):
            texts = batch.column("text")
            keys = pc.fill_null(batch.column("doc_id").cast(pa.int64()), -(1 << 62))
            ids, n = own.sample(texts, np.asarray(keys))
            back, off = own.decode(ids, n)
            raw, raw_off = strings(texts)
            same = np.diff(off) - 1 == np.diff(raw_off)
            if same.all():
                keep = np.ones(len(back), bool)
                keep[off[:-1]] = False
                same[np.searchsorted(raw_off, np.flatnonzero(back[keep] != raw), side="right") - 1] = False
            lists = list_array(ids, n, pa.int32())
            null = texts.is_null()
            if pc.any(null).as_py():
                lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
            count = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, count, pa.array(same)], ["doc_id", "ids", "n_pieces", "lossless"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null texts."""
    spark = encoded.sparkSession
    ship(spark)
    vocab = spark.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocab.value)
        for batch in batches:
            lists = batch.column("ids")
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            raw, off = own.decode(np.asarray(pc.list_flatten(lists), dtype=np.int64), n)
            texts = [None if not ok else raw[a + 1 : b].tobytes().decode() for ok, a, b in zip(lists.is_valid().to_pylist(), off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document."""
    return encode(table(spark, sf_dir, "documents"))
