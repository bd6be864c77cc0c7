"""Operators against brute force, and their results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import copy
import itertools
import random
import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomry.llm import exact_dedup, kernel, packing, pieces, secret_scan, sharding, toxicity, url_filter
from fathomry.llm.components import components
from fathomry.llm.runtime import Scratch, source_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, digest string, rid long, row int"


def docs(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", "web", None if t is None else len(t), "f", "d", 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "lorem ipsum dolor " * 40_000
ODD = [None, "", "   ", "a", "same text here", "same text here", LONG, LONG, "▁ \U0001f600 éé\x00", None, ""]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, None, 4]
    return docs(spark, ODD, ids).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# kernel


def test_words_and_shingles():
    texts = ["Hello, wörld  foo_1!", "", None, "a", "x" * 100 + " b"]
    w = kernel.Words(pa.array(texts))
    want = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == sum(want, [])
    h = w.hashes()
    again = kernel.Words(pa.array(["hello b x" + "x" * 99])).hashes()
    assert again[0] == h[0] and again[1] == h[-1] and again[2] == h[-2]
    s, n = kernel.shingles(h, w.count, 2)
    assert n.tolist() == [2, 0, 0, 1, 1] and len(set(s.tolist())) == 4


# op 8


def test_exact_dedup_odd(spark, odd, empty):
    out, _ = exact_dedup.duplicates(spark, odd)
    pairs = {(r["doc_id"], r["duplicate_of"]) for r in out.collect()}
    assert pairs == {(5, 4), (7, 6), (4, 1)}  # nulls aren't copies; both empty texts are
    kept = exact_dedup.stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert exact_dedup.duplicates(spark, empty)[0].count() == 0 and exact_dedup.stage(spark, empty, "").count() == 0


def test_exact_dedup_checks_bytes(spark):
    texts = ["aa", "ab", "aa", "b", "ab", "ac", "ab"]
    out, _ = exact_dedup.duplicates(spark, docs(spark, texts), digest=lambda t: F.substring(t, 1, 1).cast("binary"))
    assert {(r["doc_id"], r["duplicate_of"], r["n_copies"]) for r in out.collect()} == {(2, 0, 2), (4, 1, 3), (6, 1, 3)}


def test_exact_dedup_many_batches(spark, tmp_path):
    texts = [f"text {i % 7}" for i in range(30)]
    docs(spark, texts).repartition(6).write.parquet(str(tmp_path / "d"))
    out, _ = exact_dedup.duplicates(spark, spark.read.parquet(str(tmp_path / "d")), max_files=1)
    assert {(r["doc_id"], r["duplicate_of"]) for r in out.collect()} == {(i, i % 7) for i in range(7, 30)}


def test_exact_dedup_retains_its_state(spark, tmp_path):
    """A second run over a folder with new files reads only these into the state, and finds copies of the first run's."""
    at, state = str(tmp_path / "d"), f"file://{tmp_path}/state"
    docs(spark, ["a", "b", "c", None]).coalesce(1).write.parquet(at)
    assert exact_dedup.duplicates(spark, spark.read.parquet(at), state=state)[0].count() == 0
    docs(spark, ["b", "d", "a"], [10, 11, -1]).coalesce(1).write.mode("append").parquet(at)
    out, _ = exact_dedup.duplicates(spark, spark.read.parquet(at), state=state)
    assert {(r["doc_id"], r["duplicate_of"], r["n_copies"]) for r in out.collect()} == {(10, 1, 2), (0, -1, 2)}
    read = [int(x) for f in sorted((tmp_path / "state/stream/sources/0").glob("[0-9]*")) for x in [f.read_text().count('"path"')]]
    assert read == [1, 1] or sum(read) == 2, read
    with pytest.raises(ValueError):
        exact_dedup.duplicates(spark, docs(spark, ["a"]), state=state)


def test_a_scan_of_some_files_reads_no_others(spark, tmp_path):
    at = tmp_path / "d"
    docs(spark, [f"t{i}" for i in range(9)]).repartition(3).write.parquet(str(at))
    files = sorted(map(str, at.glob("*.parquet")))
    some = spark.read.parquet(*files[:2])
    scratch = Scratch(spark)
    assert spark.read.parquet(source_folder(some, scratch)).count() == some.count() < 9
    assert source_folder(spark.read.parquet(str(at)), scratch).endswith("/d") and source_folder(spark.read.parquet(files[0]), scratch).endswith(".parquet")


# op 1


def brute_bfd(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b >= s]
        if s > capacity or not fit:
            bins.append(max(capacity - s, 0) if s <= capacity else 0)
        else:
            bins.remove(b := min(fit))
            bins.append(b - s)
    return sorted(bins)


def test_pack_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randrange(5, 60)
        sizes = [rng.randrange(1, capacity + 4) for _ in range(rng.randrange(0, 120))]
        runs, n = sharding.pack(list(collections.Counter(sizes).items()), capacity)
        load = collections.Counter()
        for size, lo, hi, first, each in runs:
            for r in range(lo, hi):
                load[first + (r - lo) // each] += size
        assert n == len(load)
        assert sorted(max(capacity - v, 0) for v in load.values()) == brute_bfd(sizes, capacity)


def test_tree_stays_balanced():
    t = sharding.CapacityTree()
    for k in range(1000):
        t.add(k, k, 1)
    assert t.root.height <= 14 and t.tightest(500).key == 500
    for k in range(0, 1000, 2):
        t.remove(k)
    assert t.root.height <= 14 and t.tightest(500).key == 501


@pytest.mark.parametrize("capacity", [1 << 12, 1 << 16])
def test_shards_of_the_tables(spark, sf, capacity):
    """Loads equal those of packing all groups one by one; no shard exceeds the capacity but by one group of that size."""
    out = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), ["text"], F.octet_length("text"), capacity=capacity).toPandas()
    groups = out.drop_duplicates("group_key")
    units = lambda b: (b + 63) // 64 if b else 1
    assert (groups.group_bytes == out.groupby("group_key").bytes.sum().loc[groups.group_key].to_numpy()).all()
    load = groups.assign(u=groups.group_bytes.map(units)).groupby("shard_id").agg(u=("u", "sum"), b=("group_bytes", "sum"), n=("u", "size"))
    assert ((load.b <= capacity) | (load.n == 1)).all()
    assert sorted((capacity // 64 - load.u).clip(lower=0)) == brute_bfd(groups.group_bytes.map(units).tolist(), capacity // 64)


def test_ties_do_not_depend_on_the_order(spark):
    """Equal sizes: the same bins whatever the order of the rows."""
    texts = [f"{i:064d}" for i in range(200)]
    out = sharding.assign(docs(spark, texts), ["text"], F.octet_length("text"), capacity=640).toPandas()
    assert out.groupby("shard_id").size().max() == 10 and out.shard_id.nunique() == 20
    again = sharding.assign(docs(spark, texts[::-1], list(range(199, -1, -1))), ["text"], F.octet_length("text"), capacity=640).toPandas()
    assert dict(zip(out.doc_id, out.shard_id)) == dict(zip(again.doc_id, again.shard_id))


def test_sharding_odd(spark, odd, empty):
    out = sharding.assign(odd, ["text"], F.octet_length("text"), capacity=1 << 16).collect()
    assert len(out) == len(ODD)
    shard = collections.defaultdict(set)
    for r in out:
        shard[r["group_key"]].add(r["shard_id"])
    assert all(len(v) == 1 for v in shard.values())  # groups stay whole, the one over the capacity too
    assert sharding.assign(empty, ["text"], F.octet_length("text")).count() == 0


# op 10


def test_automaton_against_regex():
    rng = random.Random(5)
    alphabet = "ab/.é漢😀"
    rules = ["*", "a*b", "?a", "[ab]/*", "*a*b*a", "ab", "*.a", "", "a?*?b", "a?b", "??", "*é?*", "[é漢]*", "*[a漢]b*", "[!a]?*", "*[^a.]", "*[a-b]/?", "?*[é-ü]", "*漢", "[]", "[a"] + ["".join(rng.choice("ab*?/") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    urls = ["", "a", "ab", "ba", "a/b.a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    got = url_filter.Automaton(rules).run(*kernel.strings(pa.array(urls)))
    want = [[bool(re.fullmatch(url_filter._regex(r), u)) for r in rules] for u in urls]
    assert got.tolist() == want
    with pytest.raises(ValueError):
        url_filter.Automaton(["[!é]"])


def test_url_filter_columns(spark):
    rows = [(1, "http://x.org/aéb", "r", 5, True), (2, "http://x.org/ab", "r", 5, True)]
    d = spark.createDataFrame(rows, "page_id long, url string, canonical_url string, rules int, blocked boolean")
    out = {r["page_id"]: (r["canonical_url"], r["rules"]) for r in url_filter.match(d, ["*/a?b", "*b", "*"]).collect()}
    assert out == {1: ("http://x.org/aéb", [0, 1, 2]), 2: ("http://x.org/ab", [1, 2])}


def test_url_filter_odd(spark):
    rows = [(1, None), (2, "  "), (3, "HTTP://User@Ads.Example.com:80"), (4, "http://x.org/a#frag"), (4, "http://x.org/a#frag"), (5, "no scheme/login"), (6, "https://y.net/" + "p/" * 20_000 + "login"), (7, "https://z.org/sitemap.xml"), (None, "https://e.org:443?x=1")]
    out = {r["page_id"]: r for r in url_filter.match(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[3]["canonical_url"] == "http://ads.example.com/" and out[3]["blocked"]
    assert out[4]["canonical_url"] == "http://x.org/a" and not out[4]["blocked"]
    assert out[1]["rules"] == [] and not out[1]["blocked"] and out[2]["rules"] == []
    assert out[5]["blocked"] and out[6]["blocked"] and not out[7]["blocked"] and out[None]["canonical_url"] == "https://e.org/?x=1"
    assert url_filter.match(spark.createDataFrame([], "page_id long, url string")).count() == 0


# op 9


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(*pieces.vocabulary())


def segmentations(lat, text):
    """All segmentations of b' ' + text and their probabilities, by enumeration."""
    raw = b" " + text.encode()
    edges = collections.defaultdict(list)
    s, e, p = lat.edges(np.frombuffer(raw, np.uint8), np.full(len(raw), len(raw)))
    for a, b, i in zip(s.tolist(), e.tolist(), p.tolist()):
        edges[a].append((b, i))
    out, todo = {}, [(0, (), 0.0)]
    while todo:
        at, ids, w = todo.pop()
        if at == len(raw):
            out[ids] = np.exp(w)
        todo += [(b, (*ids, i), w + lat.log_weight[i]) for b, i in edges[at]]
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_sampling_has_the_lattice_distribution(lattice):
    want = segmentations(lattice, "theory")
    n = 20_000
    ids, count = lattice.sample(pa.array(["theory"] * n), np.arange(n))
    cut = np.cumsum(count)[:-1]
    got = collections.Counter(tuple(x.tolist()) for x in np.split(ids, cut))
    assert set(got) <= set(want)
    assert sum(abs(got[k] / n - p) for k, p in want.items()) < 0.03


def test_filter_sums_all_paths(lattice):
    raw = b" theory"
    *_, total = lattice.filter(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    weights = sum(np.exp(sum(lattice.log_weight[i] for i in k)) for k in segmentations(lattice, "theory"))
    assert np.isclose(total[len(raw)], np.log(weights))


@pytest.mark.parametrize("text", ["a", "  x", "漢字ab", "😀é", "the cat", "==--a1", "mm\n\n", "ﬁx"])
def test_each_edge_has_its_share_of_paths(lattice, text):
    """Sums and the probability of every segmentation, as a product of the edges' shares, equal enumeration."""
    raw = b" " + text.encode()
    s, piece, border, first, total = lattice.filter(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    want = segmentations(lattice, text)
    weights = sum(np.exp(sum(lattice.log_weight[i] for i in k)) for k in want)
    assert np.isclose(total[len(raw)], np.log(weights))
    size = {i: lattice.size[i] for i in set(piece.tolist())}
    for ids, p in want.items():
        at, q = len(raw), 1.0
        for i in reversed(ids):
            k, low = first[at], 0.0
            while piece[k] != i:
                low, k = border[k], k + 1
            q *= min(border[k], 1.0) - low
            at -= size[i]
        assert at == 0 and np.isclose(q, p, rtol=1e-6, atol=1e-12)


def test_long_texts_without_spaces(lattice):
    """One unit each: not cut at all, cut between characters, and with pieces across."""
    rng = random.Random(3)
    texts = ["x" * 30_000, "漢字仮名" * 5000, "".join(rng.choice("abcXYZ019+/") for _ in range(30_000)), "\n" * 5000]
    ids, n = lattice.sample(pa.array(texts), np.arange(4))
    back, off = lattice.decode(ids, n)
    assert [back[a + 1 : b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == texts


def test_pieces_of_any_length():
    """Pieces of 64 bytes and more keep their order and their share."""
    pieces_ = [bytes([i]) for i in range(256)] + [b"a" * 64, b"a" * 128, b"a"]
    lat = pieces.Lattice(pieces_, np.array([-9.0] * 256 + [-1.0, -1.5, -2.0]), 0)
    ids, n = lat.sample(pa.array(["a" * 200] * 50), np.arange(50))
    back, off = lat.decode(ids, n)
    assert {back[a + 1 : b].tobytes() for a, b in zip(off[:-1], off[1:])} == {b"a" * 200} and {256, 257} <= set(ids.tolist())


def words_of(rng, size):
    """About `size` bytes of made words, few of them twice."""
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 12))) for _ in range(size // 9))


@pytest.mark.parametrize("kind", ["many texts", "one text", "no spaces", "no cuts"])
def test_sampling_memory_has_a_bound(lattice, kind):
    """Edges of a few megabytes of text that is all different are never held at once."""
    rng = random.Random(4)
    texts = {
        "many texts": lambda: [words_of(rng, 2000) for _ in range(2000)],
        "one text": lambda: [words_of(rng, 8_000_000)],
        "no spaces": lambda: ["".join(rng.choices("abcXYZ019+/漢字", k=3_000_000))],
        "no cuts": lambda: ["".join(rng.choices("ACGT", k=50_000)) for _ in range(60)],
    }[kind]()
    size = sum(len(x.encode()) for x in texts)
    arr = pa.array(texts)
    tracemalloc.start()
    ids, n = lattice.sample(arr, np.arange(len(texts)))
    back, off = lattice.decode(ids, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [back[a + 1 : b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == texts
    assert peak < 120e6 + 20 * size, peak / 1e6


def test_a_text_alone_and_among_others(lattice):
    """Equal probabilities keep their order, and borders their value, whatever is sampled with a text."""
    rng = random.Random(5)
    texts = [words_of(rng, 4_000_000)] + ["".join(rng.choice("efgh") for _ in range(12)) for _ in range(20_000)]
    texts += ["fff", "=====", "aaaa"] * 2000
    ids, n = lattice.sample(pa.array(texts), np.arange(len(texts)))
    alone, m = lattice.sample(pa.array(texts[1:]), np.arange(1, len(texts)))
    assert n[1:].tolist() == m.tolist() and np.array_equal(ids[n[0] :], alone)


def test_long_stretches_window_by_window(lattice):
    """Windows give the segmentations that filtering in one go gives."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGT", k=k)) for k in (500, 801, 2000, 3001)] * 2 + ["x" * 3000, "é" * 900 + "ACGT" * 300 + "😀漢" * 200, " " * 2000 + "a b", "=" * 1500 + "ab" * 700]
    whole, cut = (copy.copy(lattice) for _ in range(2))
    whole.part, cut.part = 1 << 20, 4 * lattice.longest
    assert max(map(len, texts)) > 5 * cut.part
    for a, b in zip(whole.sample(pa.array(texts), np.arange(len(texts))), cut.sample(pa.array(texts), np.arange(len(texts)))):
        assert a.tolist() == b.tolist()


def test_pieces_round_trip(spark, odd, empty):
    enc = pieces.encode(odd).persist()
    assert all(r["lossless"] for r in enc.collect())
    back = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decode(enc).collect())
    assert back == collections.Counter((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect())
    again = {(r["doc_id"], tuple(r["ids"] or ())) for r in pieces.encode(odd.repartition(3)).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"] or ())) for r in enc.collect()}  # whatever the partitions
    assert pieces.encode(empty).count() == 0


# op 7


def run(texts, learned=()):
    keys, kinds = toxicity.lexicon(toxicity.word_hashes(list(learned)).view(np.int64).tolist())
    return toxicity.score(pa.array(texts), keys, kinds, *toxicity.grammar().tables())[0].round(3).tolist()


def brute_score(text):
    """By the meaning of the grammar, without its machines: phrases by looking back, distances by counting words."""
    words_of = {k: set(v.split()) for k, v in toxicity.LEXICON.items()}
    I, T, G, N, R = toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT
    name = {"INSULT": I, "THREAT": T, "TARGET": G}
    total = 0.0
    for clause in re.split(r"[.!?;\n\r]", text.lower()):
        ws = re.findall(r"\w+", clause)
        kind = [next((k for k, v in words_of.items() if w in v), None) for w in ws]
        for k in (I, T, G):
            old = list(kind)
            for p in [p.split() for p in toxicity.PHRASES[k].split(", ")]:
                for i in range(len(ws) - len(p) + 1):
                    if all(old[i + j] == name[x] if x in name else ws[i + j] == x and old[i + j] == next((c for c, v in words_of.items() if x in v), None) for j, x in enumerate(p)):
                        kind[i + len(p) - 1] = k
        at = [i for i, k in enumerate(kind) if k in (I, T)]
        aims = [i for i, k in enumerate(kind) if k == G]
        for i in at:
            soft = any(kind[j] == N for j in range(max(0, i - 3), i)) or any(kind[j] == R for j in range(i))
            after = next((j for j in aims if j > i), None)
            aimed = any(0 < i - j <= 3 for j in aims) or after is not None and after - i <= 3 and not any(i < j < after for j in at)
            base, bonus = {(I, False): (1.0, 0.6), (T, False): (0.2, 1.7), (I, True): (0.25, 0.1), (T, True): (0.0, 0.2)}[kind[i], soft]
            total += base + bonus * aimed
    return round(total, 3)


def test_grammar_against_word_by_word():
    rng = random.Random(7)
    words = ["idiot", "moron", "kill", "you", "not", "said", "the", "tree", "house", ".", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    assert run(texts) == [brute_score(t) for t in texts]
    some = ["you", "them", "burn", "idiot"] + [w for k in toxicity.PHRASES for p in toxicity.PHRASES[k].split(", ") for w in [p.replace("TARGET", "you").replace("THREAT", "burn")]] * 2
    texts = [" ".join(rng.choice(some + words) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    texts += [" ".join(rng.choice(" ".join(some).split()) for _ in range(30)) for _ in range(300)]
    assert run(texts) == [brute_score(t) for t in texts]


def test_scores_of_the_tables(spark, sf):
    """Every document's score under the lexicon and what was learned, word by word."""
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = set(toxicity.learn(d, l, Scratch(spark)))
    texts = {r[0]: r[1] for r in d.select("doc_id", "text").collect()}
    names = sorted({w for t in texts.values() for w in re.findall(r"\w+", t.lower())})
    new = {w for w, h in zip(names, kernel.Words(pa.array([" ".join(names)])).hashes().view(np.int64).tolist()) if h in learned} - set(toxicity._CLASS)
    lexicon = toxicity.LEXICON | {toxicity.INSULT: " ".join([toxicity.LEXICON[toxicity.INSULT], *new])}
    got = {r["doc_id"]: round(r["score"], 3) for r in toxicity.scores(d, l).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "LEXICON", lexicon)
        assert got == {i: brute_score(t) for i, t in texts.items()} and sum(v >= toxicity.THRESHOLD for v in got.values()) > 3


def test_a_tie_is_toxic(spark):
    texts = ["Idiot. Not an idiot. Not an idiot.", "Idiot. Not an idiot."]
    out = {r["doc_id"]: r["score"] for r in toxicity.scores(docs(spark, texts), spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert out == {0: toxicity.THRESHOLD, 1: 1.25}


def test_copies_and_neighbours_teach_nothing(spark):
    """Twelve copies that begin with a word give it one context, whatever rows stand between them."""
    rng = random.Random(2)
    bad, clean = "zorgu and a thing", [" ".join(f"c{rng.randrange(400)}" for _ in range(12)) for _ in range(12)]
    texts = [t for c in clean for t in (c, bad)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    for d in (docs(spark, texts).coalesce(1), docs(spark, texts[1::2] + texts[::2], [*range(1, 24, 2), *range(0, 24, 2)]).repartition(3)):
        assert toxicity.learn(d, labels, Scratch(spark)) == []


def test_grammar_meaning():
    you, alone, negated, quoted, threat, weapon = run(["You are an idiot.", "idiot", "You are not an idiot.", "He said you idiot", "I will kill you", "they kill time slowly over there and later"])
    assert you > toxicity.THRESHOLD > alone > negated and quoted < alone and threat > toxicity.THRESHOLD and weapon <= threat
    assert run(["a zorgu and a zorgu"], ["zorgu"]) == [2.0] and run(["", None]) == [0.0, 0.0]
    assert run(["You waste of space.", "a waste of the space", "I will make you pay", "make you a pay", "not a brain dead", "this guy is an idiot", "That garbage!"], ["garbage"]) == [1.6, 0.0, 1.9, 0.0, 0.25, 1.6, 1.0]


def test_toxicity_learns_words(spark, odd, empty):
    rng = random.Random(1)
    filler = [f"w{i}x" for i in range(300)]
    texts, labels = [], []
    for i in range(120):
        ws = [rng.choice(filler) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                ws[rng.randrange(40)] = "zorgu"
        texts.append(" ".join(ws))
        labels.append((i, int(i % 4 == 0)))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.scores(docs(spark, texts), lab).collect()}
    assert {i for i, s in out.items() if s >= toxicity.THRESHOLD} == {i for i, t in labels if t and texts[i].split().count("zorgu") > 1}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(odd, none).count() == len(ODD) and toxicity.scores(empty, none).count() == 0


# op 6


def test_linking_against_all_pairs(spark):
    rng = random.Random(9)
    bits = ["client_id=app42", "password=abc1", "https://h.example/x", "user: bob", "token = 'deadbeefcafe0123456789'", "AKIA" + "A1B2C3D4E5F6G7H8", "\n\n", "words " * 12, "more " * 30, "10.0.0.1"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    check_links(spark, docs(spark, texts), dict(enumerate(texts)), 50)


def test_scan_of_the_tables(spark, sf):
    """Every place of every text tried with every pattern by itself, and all pairs of parts of a scope."""
    d = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").where("text is not null")
    check_links(spark, d, {r[0]: r[1] for r in d.select("doc_id", "text").collect()}, 3)


def check_links(spark, d, texts, least):
    got = collections.Counter((r["doc_id"], r["start"], r["stop"], r["kind"], r["strength"], r["links"], r["nearest_start"]) for r in secret_scan.findings(d).collect())
    single = [(k, role, strength, re.compile(p)) for k, role, strength, p in secret_scan.PATTERNS]
    want = collections.Counter()
    for i, t in texts.items():
        ps, at = [], 0 if any(p.search(t) for *_, p in single) else len(t)
        while at < len(t):
            m, kind, role, strength = next(((m, k, r, s) for k, r, s, p in single if (m := p.match(t, at))), (None, None, None, None))
            if not m:
                at += 1
                continue
            value = next((v for v in m.groupdict().values() if v is not None), m.group())
            share = collections.Counter(value)
            bits = -sum(n / len(value) * np.log2(n / len(value)) for n in share.values())
            if kind != "bare" or bits >= 3.2:
                strong = strength == "strong" or kind == "named" and len(value) >= 12 and bits >= 2.8 and not any(c.isspace() for c in value)
                ps.append((kind, role, strong, m.start(), m.end()))
            at = m.end()
        for p in ps:
            others = {"secret": ("identifier", "endpoint"), "identifier": ("secret",)}.get(p[1], ())
            links = [q for q in ps if q[1] in others and not re.search(r"\n[ \t]*\n", t[min(p[3], q[3]) : max(p[3], q[3]) + 1])]
            if p[1] != "endpoint" and (p[2] or links):
                near = min(((max(q[3] - p[4], p[3] - q[4]), q[3]) for q in links), default=(0, None))[1]
                want[i, p[3], p[4], p[0], "strong" if p[2] else "weak", len(links), near] += 1
    assert got == want and len(want) > least, (got - want, want - got)


def test_parts_of_a_scope_are_linked_at_any_distance(spark):
    text = "user: bob\n" + "word " * 5000 + "\npassword = abc1"
    assert [(r["kind"], r["links"]) for r in secret_scan.findings(docs(spark, [text])).orderBy("start").collect()] == [("user_name", 1), ("named", 1)]
    assert secret_scan.findings(docs(spark, [text.replace("bob\n", "bob\n \n")])).count() == 0


@pytest.mark.parametrize("text, gone", [
    ('{"private_key": "-----BEGIN PRIVATE KEY-----\\nMIIEabcd09\\nQx==\\n-----END PRIVATE KEY-----\\n", "client_id": "app42"}', ["MIIE", "Qx==", "app42"]),
    ("-----BEGIN PGP PRIVATE KEY BLOCK-----\n\nlQOYBabcd\n=x1y2\n-----END PGP PRIVATE KEY BLOCK-----", ["lQOY", "x1y2"]),
    ('host: db1.example\npassword: "two words, and; more"', ["two", "words", "more"]),
    ("A_VERY_LONG_NAME_OF_AN_ENVIRONMENT_VARIABLE_THAT_ENDS_IN_PASSWORD        =        k9Zq7LmX2bVw", ["k9Zq7LmX2bVw"]),
    ("https://" + "h" * 3000 + ".example/x user=bob token=abcd", ["bob", "abcd"]),
    ("login=bob, secret => 'it\\'s here1'", ["bob", "here1"]),
])
def test_nothing_of_a_secret_is_left(text, gone):
    left = secret_scan.masked(text)
    assert not any(g in left for g in gone), left


@pytest.mark.parametrize("secret", [
    "token=" + "a1B2c3D4" * 100,
    "k9Zq7LmX2bVw" * 25,
    "https://bob:" + "p4ssW" * 60 + "@h.example",
    "-----BEGIN RSA PRIVATE KEY-----\n" + "MIIEabcd09+/" * 800 + "\n-----END RSA PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + "MIIEabcd09+/\n" * 80 + "-----END RSA PRIVATE KEY-----",
    "-----BEGIN PRIVATE KEY-----\n" + ("MIIEabcd09+/" * 5 + "\n") * 20 + "Qx09==",
])
def test_long_secrets_are_taken_whole(secret):
    text = "see " + secret + "\nand so on"
    p = secret_scan.parts(text)
    assert [(x[4], x[5]) for x in p if x[2] == "secret"] == [(4, 4 + len(secret))]


def test_secret_stage(spark, odd, empty):
    assert secret_scan.findings(odd).count() == 0 and secret_scan.findings(empty).count() == 0
    twice = docs(spark, ["token=" + "a1B2c3D4" * 3] * 2, [1, 1])
    assert secret_scan.findings(twice).count() == 2
    texts = ["key AKIA" + "A1B2C3D4E5F6G7H8 end", "password=abc1 alone", "user=bob password=abc1 é", "clean"]
    d = docs(spark, texts)
    out = {r["doc_id"]: r for r in secret_scan.stage(spark, d, "").collect()}
    assert out[0]["text"] == "key [AWS_KEY_ID] end" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] == texts[1] and out[2]["text"] == "[USER_NAME] [NAMED] é" and out[3]["text"] == "clean"
    same = secret_scan.stage(spark, odd, "")
    assert same.columns == odd.columns and same.exceptAll(odd).count() == 0 and same.count() == len(ODD)
    assert secret_scan.stage(spark, empty, "").count() == 0


# op 3


def test_winnowing_against_definition():
    rng = random.Random(2)
    for n in (0, 1, 5, 31, 32, 33, 200):
        g = np.array([rng.randrange(50) for _ in range(n)], np.uint64)
        at, count = kernel.winnow(g, np.array([n]), 32)
        want = {min(g[i : i + 32].tolist()) for i in range(max(1, n - 31))} if n else set()
        assert set(g[at].tolist()) == want and count.sum() == len(at)


def related(rng, n=120):
    words = [f"v{i}" for i in range(4000)]
    passages = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    out = []
    for _ in range(n):
        ws = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            ws += p
        out.append(" ".join(ws))
    return out + [" ".join(rng.choice(words) for _ in range(30))]


def brute_terms(texts):
    """The TERMS rarest words of each text that another has, too, and their hashes."""
    sets = [set(re.findall("[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())) for t in texts]
    df = collections.Counter(w for s in sets for w in s)
    names = sorted(df)
    code = dict(zip(names, kernel.Words(pa.array([" ".join(names)])).hashes().view(np.int64).tolist()))
    return [{code[w] for w in sorted((w for w in s if df[w] > 1), key=lambda w: (df[w], code[w]))[: packing.TERMS]} for s in sets]


@pytest.mark.parametrize("frequent", [packing.FREQUENT, 40, 0])
def test_key_terms_against_brute_force(spark, sf, frequent):
    """Whichever words are sent to the tasks; over a table, and over odd texts."""
    d = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs(spark, ODD, range(-1, -12, -1)).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = {r[0]: r[1] for r in d.select("doc_id", "text").collect()}
    want = dict(zip(texts, brute_terms(texts.values())))
    rows = packing.key_terms(d, Scratch(spark), frequent).collect()
    assert {r["doc_id"]: set(r["terms"]) for r in rows} == {i: want[i] for i, t in texts.items() if (t or "").split()}
    assert sorted(r["rid"] for r in rows) == list(range(len(rows))) and all(r["n"] == len(r["terms"]) for r in rows)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rid"])] == sorted(r["doc_id"] for r in rows)


class Counted(Scratch):
    """Bytes of the tables that are there, and the most at a time."""

    def __init__(self, spark):
        super().__init__(spark)
        self.held, self.most = {}, 0

    def write(self, df, name="t"):
        out = super().write(df, name)
        at = out._scratch_path
        self.held[at] = sum(p.stat().st_size for p in Path(at.removeprefix("file://")).rglob("*.parquet"))
        self.most = max(self.most, sum(self.held.values()))
        return out

    def drop(self, df):
        super().drop(df)
        self.held.pop(df._scratch_path)


def test_key_terms_write_less_than_the_texts(spark, sf):
    """No table of all words of all documents is written."""
    scratch = Counted(spark)
    assert packing.key_terms(spark.read.parquet(f"{sf}/documents.parquet"), scratch).count() > 100
    assert 0 < scratch.most < 0.7 * Path(f"{sf}/documents.parquet").stat().st_size


@pytest.mark.parametrize("kind", ["made", "tables"])
def test_neighbours_against_brute_force(spark, sf, kind):
    """The similarities of each document's nearest are those of comparing it with all."""
    texts = related(random.Random(4), 500) if kind == "made" else [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    rows = packing.key_terms(docs(spark, texts), Scratch(spark)).persist()
    terms = {r["rid"]: set(r["terms"]) for r in rows.collect()}
    got = collections.defaultdict(list)
    for r in packing.neighbours(rows.select("rid", "ord", "n", "terms"), Scratch(spark)).collect():
        assert abs(r["similarity"] - len(terms[r["a"]] & terms[r["b"]]) / len(terms[r["a"]] | terms[r["b"]])) < 1e-9
        got[r["a"]].append(r["similarity"])
    for i, x in terms.items():
        best = sorted((len(x & y) / len(x | y) for j, y in terms.items() if j != i and x & y), reverse=True)[: packing.NEIGHBOURS]
        assert np.allclose(sorted(got[i], reverse=True), best)
    assert len(got) > 100


def test_neighbours_of_many_hot_passages_are_exact(spark):
    """Each document has 3 to 12 of 30 passages that hundreds share."""
    rng, n = np.random.default_rng(11), 2000
    hot = np.zeros((n, 30), np.int64)
    for row in hot:
        row[rng.choice(30, rng.integers(3, 13), replace=False)] = 1
    own = rng.integers(0, 12, n)
    lists = [[int(100 * c + j) for c in np.flatnonzero(h) for j in range(1 + c % 3)] + [int(10**6 + 100 * i + j) for j in range(own[i])] for i, h in enumerate(hot)]
    rows = spark.createDataFrame([(i, int(rng.integers(1 << 60)), len(p), p) for i, p in enumerate(lists)], "rid long, ord long, n long, terms array<long>")
    got = collections.defaultdict(list)
    for r in packing.neighbours(rows, Scratch(spark)).collect():
        got[r["a"]].append(r["similarity"])
    size = np.array([len(p) for p in lists])
    common = (hot * (1 + np.arange(30) % 3)) @ hot.T
    similarity = common / (size[:, None] + size[None] - common)
    np.fill_diagonal(similarity, 0)
    want = -np.sort(-similarity, axis=1)[:, : packing.NEIGHBOURS]
    have = np.array([sorted(got[i], reverse=True) for i in range(n)])
    assert have.shape == want.shape and np.abs(have - want).max() < 1e-9


def brute_paths(edges, order):
    """Takes edges in their order where they join ends of two paths."""
    path = {}
    for a, b, _ in edges:
        path[a], path[b] = [a], [b]
    for a, b, _ in sorted(edges, key=order):
        x, y = path[a], path[b]
        if x is y or a not in (x[0], x[-1]) or b not in (y[0], y[-1]):
            continue
        x, y = x if x[-1] == a else x[::-1], y if y[0] == b else y[::-1]
        whole = x + y
        for n in whole:
            path[n] = whole
    return {tuple(min(p, p[::-1])) for p in path.values() if len(p) > 1}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "ties"])
def test_paths_of_rounds_and_of_one_task(spark, kind):
    """Joined in rounds, in one task, and one by one: the same paths."""
    rng = random.Random(5)
    pairs = {"random": {tuple(sorted(rng.sample(range(150), 2))) for _ in range(350)}, "chain": {(i, i + 1) for i in range(60)}, "star": {(0, i) for i in range(1, 40)} | {(50, 51)}, "ties": {(i, j) for i in range(14) for j in range(i)}}[kind]
    pairs = sorted((min(p), max(p)) for p in pairs)
    rows = [(a, b, 0.5 if kind == "ties" else rng.choice([0.2, 0.4, 0.6, rng.random()])) for a, b in pairs]
    edges = spark.createDataFrame(rows, "a long, b long, similarity double").repartition(3)
    h = {(r["a"], r["b"]): r["h"] for r in edges.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    degree = collections.Counter(x for a, b, _ in rows for x in (a, b))
    want = brute_paths(rows, lambda e: (min(degree[e[0]], degree[e[1]]), -e[2], h[e[:2]], e[:2]))
    for finish in (0, 20, 10**6):
        got = collections.defaultdict(list)
        for r in packing.cover(edges, Scratch(spark), finish).collect():
            got[r["path"]].append((r["place"], r["rid"]))
        for p, v in got.items():
            assert sorted(x for x, _ in v) == list(range(len(v))) and p == min(x for _, x in v)
        paths = [[x for _, x in sorted(v)] for v in got.values()]
        assert {tuple(min(p, p[::-1])) for p in paths} == want, finish
        assert sum(map(len, paths)) == len({x for p in paths for x in p})


MANY_EDGES = """
import resource, sys
import numpy as np, pyarrow as pa
from fathomry.llm import packing

def batches(n):
    rng = np.random.default_rng(3)
    for k in range(0, n, 10000):
        u = rng.integers(0, n // 3, 10000)
        v, z = u + 1 + rng.integers(0, 50, 10000), np.zeros(10000, np.int64)
        columns = {"d": z, "s": z * 1.0, "h": k + np.arange(10000), "u": u, "v": v}
        for side, x in (("a", u), ("b", v)):
            columns |= {f"{side}_label": x, f"{side}_round": z.astype(np.int32), f"{side}_size": z + 1, f"{side}_head": x, f"{side}_tail": x}
        yield pa.RecordBatch.from_pydict(columns)

peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
sum(b.num_rows for b in packing._chains(batches(10000)))
before = peak()
rows = sum(b.num_rows for b in packing._chains(batches(800_000)))
print(rows, peak() - before)
"""


def test_one_task_holds_little_of_many_edges():
    """MB that joining 800,000 edges in one task takes: FINISH allows for 2.5 times as many."""
    out = subprocess.run([sys.executable, "-c", MANY_EDGES], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    rows, mb = map(int, out.split())
    assert rows > 200_000 and mb < 160


def test_packing_does_not_depend_on_files(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    found = [sorted(map(tuple, packing.pack(x, finish=f).collect())) for x, f in ((d, packing.FINISH), (d.repartition(5, "n_chars"), 10))]
    assert found[0] == found[1] and len(found[0]) > 100


def test_packing_fills_windows(spark, odd, empty):
    texts = related(random.Random(8), 60)
    out = packing.pack(docs(spark, texts), window=100).collect()
    per = collections.defaultdict(list)
    for r in out:
        per[r["pack"], r["window"]].append((r["offset"], r["end_token"] - r["start_token"]))
    last = {p: max(w for q, w in per if q == p) for p, _ in per}
    for (p, w), parts in per.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 100 or w == last[p]
    tokens = collections.Counter()
    for r in out:
        tokens[r["doc_id"]] += r["end_token"] - r["start_token"]
    assert tokens == {i: len(t.split()) for i, t in enumerate(texts)}
    some = packing.pack(odd)
    assert {r["doc_id"] for r in some.collect()} == {3, 4, 5, 6, 7, None} and packing.pack(empty).count() == 0


def test_components_of_chains_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)] + [(999, 999)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert len(got) == len(root)
    by = collections.defaultdict(set)
    for r in got:
        by[r["component"]].add(find(r["rid"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({find(x) for x in root})
    assert list(itertools.islice(by, 1))
