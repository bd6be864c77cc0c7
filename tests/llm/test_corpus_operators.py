"""Near-duplicates, repeated passages, quality rules and the pipeline against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathomry.llm import kernel, minhash, packing, quality, queries, suffix_dedup

from .test_small_operators import LONG, ODD, docs


@pytest.fixture(scope="module")
def real(sf):
    return {r[0]: r[1] for r in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}


def groups_of(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for x in nodes:
        out[find(x)].add(x)
    return out


def shingle_set(text, k=3):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_pairs(texts, threshold):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = collections.Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    return {p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= threshold}


def near(rng):
    words = [f"u{i}" for i in range(3000)]
    texts = {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 8)):
            ws = list(base)
            for _ in range(int(len(ws) * rng.choice([0, 0.02, 0.05, 0.1]))):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            texts[len(texts)] = " ".join(ws)
    return texts


@pytest.mark.parametrize("kind", ["made", "tables"])
def test_near_dedup_recall(spark, sf, real, kind):
    texts = near(random.Random(6)) if kind == "made" else real
    df = docs(spark, list(texts.values())) if kind == "made" else spark.read.parquet(f"{sf}/documents.parquet")
    out, _, _ = minhash.groups(spark, df)
    comp = collections.defaultdict(set)
    for r in out.collect():
        comp[r["keep"]["doc_id"]].add(r["me"]["doc_id"])
        assert r["n"] >= 2
    of = {x: k for k, v in comp.items() for x in v}
    want = brute_pairs(texts, minhash.THRESHOLD)
    hit = sum(a in of and of[a] == of.get(b) for a, b in want)
    assert len(want) > 10 and hit / len(want) >= 0.95
    exact = groups_of(want, texts)
    for k, v in comp.items():  # nothing that brute force wouldn't join; the smallest stays
        assert k == min(v) and any(v <= g for g in exact.values())


def test_near_dedup_large_bucket(spark):
    """Hundreds of documents that share a passage but aren't near-duplicates, and a group of 60 that are."""
    rng = random.Random(3)
    word = lambda: f"q{rng.randrange(5000)}"
    hub, base = [word() for _ in range(20)], [word() for _ in range(60)]
    texts = [" ".join(hub + [word() for _ in range(30)]) for _ in range(200)]
    texts += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(60)]
    out, _, _ = minhash.groups(spark, docs(spark, texts))
    assert {r["me"]["doc_id"] for r in out.collect()} == set(range(200, 260))


def test_near_dedup_within_a_template(spark):
    """Pairs of similarity 0.6 in a family of 0.43 across, close under THRESHOLD."""
    template = [f"t{i}" for i in range(122)]
    texts = [" ".join(template + [f"p{i // 2}x{j}" for j in range(30)] + [f"o{i}x{j}" for j in range(50)]) for i in range(200)]
    want = brute_pairs(dict(enumerate(texts)), minhash.THRESHOLD)
    assert want == {(i, i + 1) for i in range(0, 200, 2)}
    across = len(shingle_set(texts[0]) & shingle_set(texts[2])) / len(shingle_set(texts[0]) | shingle_set(texts[2]))
    assert 0.34 < across < minhash.THRESHOLD
    out, _, _ = minhash.groups(spark, docs(spark, texts))
    got = {(r["keep"]["doc_id"], r["me"]["doc_id"]) for r in out.collect() if r["me"] != r["keep"]}
    assert got <= want and len(got) / len(want) >= 0.95, len(got)


def test_near_dedup_chain_behind_leaders(spark):
    """A member that has left for a leader is still compared with one that only it is similar to."""
    word = lambda c, i, j: [f"{c}{i}x{k}" for k in range(j)]
    # 0-3 lead the bucket; 4, 6, ... are similar to 0, and 5, 7, ... only to the one before.
    core = [f"t{k}" for k in range(122)]
    texts = [" ".join(core + word("h", 0, 32) + word("o", i, 30)) for i in range(4)]
    for i in range(40):
        texts.append(" ".join(core + word("h", 0, 32) + word("p", i, 60)))
        texts.append(" ".join(core + word("p", i, 60) + word("q", i, 40)))
    want = groups_of(brute_pairs(dict(enumerate(texts)), minhash.THRESHOLD), range(len(texts)))
    out, _, _ = minhash.groups(spark, docs(spark, texts))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r["keep"]["doc_id"]].add(r["me"]["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_near_dedup_odd(spark):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, None, 4]
    odd = docs(spark, ODD, ids)
    out, _, _ = minhash.groups(spark, odd)
    assert {(r["me"]["doc_id"], r["keep"]["doc_id"]) for r in out.collect()} == {(4, 4), (5, 4), (6, 6), (7, 6)}
    assert minhash.stage(spark, odd, "").count() == len(ODD) - 2 and minhash.stage(spark, odd, "").columns == odd.columns
    assert minhash.stage(spark, docs(spark, []), "").count() == 0
    clash = odd.selectExpr("*", "1 as me", "'c' as ck", "array(1) as sig", "2 as component", "3 as bucket")
    assert minhash.stage(spark, clash, "").columns == clash.columns and minhash.groups(spark, clash)[0].count() == 4


def test_tensored_recall():
    """The share of pairs of similarity s that meet in a table is the binomial tail of two matching collections or more."""
    p = 0.55**minhash.WIDTH
    m = minhash.COLLECTIONS
    assert 1 - (1 - p) ** m - m * p * (1 - p) ** (m - 1) >= 0.95


# op 2


def brute_passages(texts, length):
    occ = collections.defaultdict(set)
    for i, t in texts.items():
        w = re.findall(r"\w+", t.lower())
        for p in range(len(w) - length + 1):
            occ[tuple(w[p : p + length])].add((i, p))
    cover = collections.defaultdict(set)
    for v in occ.values():
        if len({i for i, _ in v}) > 1:
            for i, p in v:
                cover[i].update(range(p, p + length))
    return cover


def covered(rows):
    out = collections.defaultdict(set)
    for r in rows:
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["other_doc_id"] != r["doc_id"] and r["copies"] >= 2
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_passages_against_brute_force(spark, sf, real, hot):
    got = covered(suffix_dedup.passages(spark, spark.read.parquet(f"{sf}/documents.parquet"), hot).collect())
    want = brute_passages(real, suffix_dedup.LENGTH)
    assert len(want) > 10 and got == want


def test_merge_of_transforms():
    rng = np.random.default_rng(1)
    for trial in range(60):
        strings = [rng.integers(1, 3, size=rng.integers(1, 30)) for _ in range(rng.integers(1, 12))]
        if trial % 3 == 0:
            strings[-1] = strings[0].copy()
        doc, length = rng.integers(0, 5, size=len(strings)), int(rng.integers(2, 8))
        off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        starts = np.array([max(1, len(s) - length + 1) for s in strings])
        got = {tuple(map(int, k[:2])): tuple(map(int, k[2:])) for k in zip(*suffix_dedup.repeats(np.concatenate(strings).astype(np.uint32), off, doc.astype(np.int64), starts, length, shards=3))}
        occ, want = collections.defaultdict(list), {}
        for i, s in enumerate(strings):
            for p in range(len(s) - length + 1):
                occ[tuple(s[p : p + length].tolist())].append((i, p))
        for v in occ.values():
            ds = {int(doc[i]) for i, _ in v}
            if len(ds) > 1:
                want |= {k: (min(ds), max(ds), len(v)) for k in v}
        assert got == want


def test_merge_gives_prefix_lengths():
    """Interleave and common prefixes of two transforms equal those of sorting all suffixes."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 4, size=20) for _ in range(4)]
    bwts, counts, suffixes = [], [], []
    for s in range(2):
        mine = texts[2 * s : 2 * s + 2]
        t = np.concatenate([np.append(x + 2, i) for i, x in enumerate(mine)])
        order = suffix_dedup.suffix_order(t)
        last = t[order - 1]
        bwts.append(np.where(last < 2, 0, last - 2))
        counts.append(2)
        suffixes.append([t[o : o + list(t[o:] < 2).index(True)].tolist() for o in order])
    shard, prefix = suffix_dedup.merge(bwts, counts, 30)
    nxt, rows = [0, 0], []
    for s in shard:
        rows.append(suffixes[s][nxt[s]])
        nxt[s] += 1
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], prefix[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == common


def test_anchors_take_every_suffix_once(real):
    arr = pa.array(list(real.values()) + ["w " * 500])
    w, _, _, row, lo, hi = suffix_dedup.anchors(arr)
    taken = [p for a, b in zip(lo, hi) for p in range(a, b + 1)]
    first = np.cumsum(w.count) - w.count
    assert sorted(taken) == [int(f) + p for f, c in zip(first, w.count) for p in range(max(0, c - suffix_dedup.LENGTH + 1))]


def test_passages_do_not_depend_on_files(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    found = [sorted(map(tuple, suffix_dedup.passages(spark, x).collect())) for x in (d, d.repartition(5, "n_chars"))]
    assert found[0] == found[1] and len(found[0]) > 10


def test_repeats_within_a_document(spark):
    rng = random.Random(4)
    word = lambda: f"y{rng.randrange(9000)}"
    base = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(20)] + base + [word() for _ in range(30)] + base), " ".join(word() for _ in range(300)), " ".join(["same"] * 80)]
    for hot in (suffix_dedup.HOT, 0):
        got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.passages(spark, docs(spark, texts), hot, within=True).collect()}
        assert got == {(0, 20, 80), (0, 110, 170), (2, 0, 80)}
    assert suffix_dedup.passages(spark, docs(spark, texts)).count() == 0


def test_equal_segments_are_one_string():
    """Intervals of segments with their copies equal those of each segment by itself."""
    rng = np.random.default_rng(5)
    for trial in range(40):
        kinds = [rng.integers(1, 4, size=rng.integers(6, 12)).astype(np.uint32) for _ in range(6)]
        pick = rng.integers(0, 1 if trial % 8 == 0 else 6, size=25)
        doc, anchor = rng.integers(0, 9, size=25).astype(np.int64), np.full(25, 7, np.int64)
        off = np.concatenate([[0], np.cumsum([len(kinds[k]) for k in pick])])
        words = np.concatenate([kinds[k] for k in pick])
        for within in (False, True):
            found = suffix_dedup.intervals(words, off, doc, anchor, np.diff(off) - 4, 5, within)
            got = {(int(s), p) for s, a, b, *_ in zip(*found) for p in range(a, b + 1)}
            occ = collections.defaultdict(list)
            for i, k in enumerate(pick):
                for p in range(len(kinds[k]) - 4):
                    occ[tuple(kinds[k][p : p + 5].tolist())].append((i, p))
            again = lambda v: len(v) > 1 if within else len({int(doc[i]) for i, _ in v}) > 1
            assert got == {k for v in occ.values() if again(v) for k in v}


def test_passages_odd(spark):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, None, 4]
    got = suffix_dedup.passages(spark, docs(spark, ODD, ids)).collect()
    n = len(LONG.split())
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["other_doc_id"]) for r in got} == {(6, 0, n, 7), (7, 0, n, 6)}
    assert suffix_dedup.passages(spark, docs(spark, [])).count() == 0


# op 4


def test_quality_finds_planted_junk(spark):
    rng = random.Random(5)
    syl = ["ra", "to", "mi", "len", "sho", "var", "e", "ning"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randrange(1, 4)))
    prose = lambda: ". ".join(" ".join([word().capitalize(), *[word() for _ in range(rng.randrange(5, 14))]]) for _ in range(rng.randrange(2, 30))) + "."
    clean = [prose() for _ in range(600)]
    junk = [re.sub(" ", "!! ", prose().upper()) for _ in range(20)] + [" | ".join([word()] * 300) for _ in range(10)] + ["", None, "  "]
    out, _, _ = quality.distances(spark, docs(spark, clean + junk))
    keep = {r["me"]["doc_id"]: r["keep"] for r in out.collect()}
    assert sum(keep[i] for i in range(600)) >= 598 and not any(keep[i] for i in range(600, 633))


def brute_mcd(x, rng):
    """Fast MCD in memory: the least determinant of many random starts, each concentrated until nothing changes, then reweighted."""
    h, best = int(np.ceil(quality.SUBSET * len(x))), (np.inf, None)
    far = lambda mu, cov: np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
    floor = np.diag(quality.FLOOR**2)
    for _ in range(100):
        near, last = rng.choice(len(x), 10, replace=False), None
        while last is None or set(near) != set(last):
            mu, cov = x[near].mean(0), np.cov(x[near].T, bias=True) + floor
            near, last = np.argsort(far(mu, cov), kind="stable")[:h], near
        if np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), (mu, cov)
    d = far(*best[1])
    near = d <= quality.REWEIGHT4 * np.median(d) / quality.MEDIAN4
    return far(x[near].mean(0), np.cov(x[near].T, bias=True) * quality.CONSISTENT + floor)


def test_mcd_of_each_group_against_many_random_starts(spark):
    """Groups by language and source, one pooled by language and one over all; a fifth of each is contaminated."""
    rng = np.random.default_rng(1)
    rows = []
    for lang, source, n, p in [("en", "a", 150, 0.1), ("en", "b", 150, 0.3), ("de", "a", 130, 0.05), ("fr", "c", 70, 0.2), ("fr", "d", 60, 0.2), ("es", "e", 20, 0.1), (None, None, 90, 0.15)]:
        for _ in range(n):
            odd = rng.random() < 0.2
            words = ["X" * int(rng.integers(6, 9)) if odd and rng.random() < 0.5 else "x" * int(rng.integers(2, 9)) for _ in range(int(rng.integers(20, 200)))]
            rows.append((len(rows), " ".join(w + ("," if rng.random() < p else "") for w in words), lang, source, 1.0, 5))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d2 double, n_words long")
    pdf = quality.distances(spark, d)[0].toPandas()
    assert sorted(pdf.groupby("grp").size()) == [110, 130, 130, 150, 150]
    for _, part in pdf.groupby("grp"):
        x, want = part[quality.STATS].to_numpy(), None
        want = brute_mcd(x, rng)
        got = part["d2"].to_numpy()
        assert np.median(abs(got - want) / np.maximum(want, 0.5)) < 0.1
        assert ((got > quality.CUT4) == (want > quality.CUT4)).mean() > 0.98


def test_consistency_factor():
    """Gaussian rows cut at the 0.975 quantile have a covariance too small by the factor."""
    x = np.random.default_rng(0).normal(size=(400_000, 4))
    near = x[(x**2).sum(1) <= quality.REWEIGHT4]
    assert abs(near.var() * quality.CONSISTENT - 1) < 0.01 and abs(len(near) / len(x) - 0.975) < 0.002


def test_quality_odd(spark):
    rows = [(1, "some words here", None, None), (2, "some words here", None, "s"), (2, "some words here", "en", None), (None, "x", "en", "s"), (3, LONG, "en", "s"), (4, "", "en", "s"), (5, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {(r["me"]["doc_id"], r["n_words"]): r["keep"] for r in quality.distances(spark, d)[0].collect()}
    assert len(out) == 6 and not out[4, 0] and not out[5, 0] and out[1, 3]
    clash = d.selectExpr("*", "1 as me", "'g' as grp", "2 as n_words", "0.5 as d2", "true as keep", "3 as mu", "4 as symbols")
    assert quality.stage(spark, d, "").columns == d.columns and quality.stage(spark, clash, "").columns == clash.columns
    none = spark.createDataFrame([], d.schema)
    assert quality.stage(spark, none, "").count() == 0


# op 3


def test_path_neighbours_are_related(spark):
    """After near copies have gone (by brute force): few documents are alone, and those side by side share far more than others do."""
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    texts = {min(g): texts[min(g)] for g in groups_of(brute_pairs(texts, minhash.THRESHOLD), texts).values()}
    rows = packing.pack(docs(spark, list(texts.values()), list(texts))).toPandas().drop_duplicates("doc_id")
    alone = rows.groupby("path").doc_id.transform("size") == 1
    assert alone.mean() < 0.2, alone.mean()
    sets = {i: set(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    df = collections.Counter(w for s in sets.values() for w in s)
    weight = lambda s: sum(np.log(len(sets) / df[w]) for w in s)
    like = lambda a, b: weight(sets[a] & sets[b]) / max(weight(sets[a] | sets[b]), 1e-9)
    rows = rows.sort_values(["path", "place"])
    side = [(a, b) for a, b, p, q in zip(rows.doc_id, rows.doc_id[1:], rows.path, rows.path[1:]) if p == q]
    rng = random.Random(1)
    ids = list(rows.doc_id)
    other = [tuple(rng.sample(ids, 2)) for _ in range(len(side))]
    near, far = np.mean([like(*p) for p in side]), np.mean([like(*p) for p in other])
    assert near > 3 * far, (near, far)


# pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against brute force on what the one before kept."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    kept, df = [source.toPandas()], source
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, df, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == source.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        df = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(df.toPandas())
    good, exact, near_, secret, packed = kept[1:]
    assert len(good) < len(kept[0])
    assert exact["doc_id"].tolist() == sorted(exact["doc_id"]) or len(exact) == exact["doc_id"].nunique()
    assert set(exact["doc_id"]) == set(good.sort_values("doc_id").drop_duplicates("text")["doc_id"])
    texts = dict(zip(exact["doc_id"], exact["text"]))
    gone = set(texts) - set(near_["doc_id"])
    wanted = groups_of(brute_pairs(texts, minhash.THRESHOLD), texts)
    assert gone == {x for g in wanted.values() for x in g if x != min(g)}
    assert set(secret["doc_id"]) == set(near_["doc_id"]) and (secret["n_chars"] == secret["text"].str.len()).all()
    tokens = collections.Counter()
    for r in packed.itertuples():
        tokens[r.doc_id] += r.end_token - r.start_token
    words = {r.doc_id: int(kernel.Words(pa.array([r.text]), kernel.VISIBLE, lower=False).count[0]) for r in secret.itertuples()}
    assert tokens == {k: v for k, v in words.items() if v}


def test_queries_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(str, d[cols].values.tolist()))
    assert key(got) == key(want) and len(got) > 0
