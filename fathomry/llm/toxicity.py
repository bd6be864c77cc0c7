"""Toxicity by a weighted grammar of finite-state transducers.

Words are mapped to letters: insult, threat, target, negation, reported speech, words of phrases, other. Transducers
read the letters of a clause and are composed into one deterministic machine. The first three know the phrases of
insults, threats and targets ("waste of space", "make you pay", "that guy") and rewrite a phrase's last word as
what the phrase is; negation rewrites insults and threats that follow within three words, reported speech those that
follow in the clause; the scorer weighs what is left, more if a target stands within three words on either side. A
threat scores little without a target. A document's score is the sum over its clauses (parts between . ! ? ; and line
ends); it is toxic from THRESHOLD on.

The insults of the fixed lexicon are English. Others are learned from labels: whole words that occur in at least
MIN_CONTEXTS different contexts (the word before, none at the start of a text) in toxic texts and at most a fifth as
many in clean ones, from a sample of at most LABELLED labelled rows (the smallest hashes of doc_id). Contexts are
counted rather than documents, so that copies don't count twice.

Whole texts are read. Null and empty texts score 0. An empty table gives no rows. Repeated rows are scored each. Null
labels are left out; without labels the fixed lexicon alone works. Ties at the threshold are toxic. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, slices
from .runtime import Scratch, ship, spread, table

THRESHOLD = 1.5
LABELLED, MIN_CONTEXTS, MAX_CLEAN = 20_000, 4, 0.2
REACH = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULT_SOFT, THREAT_SOFT = range(8)

LEXICON = {
    INSULT: "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting imbecile cretin dumbass asshole bastard bitch vermin filth scumbag jerk retard degenerate parasite subhuman dimwit halfwit numbskull lowlife",
    THREAT: "kill murder hurt destroy strangle shoot stab beat lynch hang slaughter burn punish exterminate smash",
    TARGET: "you your yours yourself youre u they them he him she her these those du dich ihr dir vous toi tu ti usted ustedes",
    NEGATION: "not never no neither nor isn aren wasn weren don doesn didn hasn haven ain wouldn couldn shouldn isnt arent wasnt wont dont doesnt didnt cannot cant nicht kein keine nie pas jamais nunca ni",
    REPORT: "said says say wrote writes reported reports quoted quotes quote called calls claimed claims alleged allegedly according sagte schrieb dit dijo",
}
#: Phrases by what their last word becomes; a name in capitals stands for any word of that class.
PHRASES = {
    INSULT: "piece of shit, piece of crap, piece of garbage, piece of dirt, full of shit, waste of space, waste of oxygen, waste of skin, shut up, drop dead, go to hell, kiss my ass, get lost, fuck TARGET, screw TARGET, brain dead, good for nothing",
    THREAT: "make TARGET pay, make TARGET suffer, hunt TARGET down, put a bullet, put TARGET down, end TARGET life, slit TARGET throat, watch TARGET back, hope TARGET die, hope TARGET dies, wish TARGET dead, THREAT in hell, TARGET will pay, TARGET will regret, get what TARGET deserve",
    TARGET: "this guy, that guy, this man, that man, this woman, that woman, this bunch, that bunch, this lot, that lot",
}
_BREAK = np.isin(np.arange(256), list(b".!?;\n\r"))


class Transducer:
    """Letter-to-letter and deterministic: (state, letter) -> (state, letter, weight); weights add up along a path."""

    def __init__(self, start, step, letters: range = range(8)):
        """step(state, letter) -> (state, letter, weight); the states are those that can be reached."""
        self.start, self.letters, self.arcs, todo = start, letters, {}, [start]
        while todo:
            q = todo.pop()
            for a in letters:
                if (q, a) not in self.arcs:
                    self.arcs[q, a] = step(q, a)
                    if (self.arcs[q, a][0], letters[0]) not in self.arcs:
                        todo.append(self.arcs[q, a][0])

    def compose(self, other: Transducer) -> Transducer:
        """First this one, then the other on its output."""

        def step(q, a):
            p, b, w = self.arcs[q[0], a]
            r, c, v = other.arcs[q[1], b]
            return (p, r), c, w + v

        return Transducer((self.start, other.start), step, self.letters)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and weight by (state, letter); the start is state 0."""
        states = [self.start, *sorted({q for q, _ in self.arcs} - {self.start})]
        at = {q: i for i, q in enumerate(states)}
        go = np.array([[at[self.arcs[q, a][0]] for a in self.letters] for q in states])
        return go, np.array([[self.arcs[q, a][2] for a in self.letters] for q in states])


_NAMES = {"INSULT": INSULT, "THREAT": THREAT, "TARGET": TARGET}
_CLASS = {w: k for k, words in LEXICON.items() for w in words.split()}
#: Letters of the words that only phrases know.
_WORDS = sorted({w for text in PHRASES.values() for w in text.replace(",", "").split()} - set(_NAMES) - set(_CLASS))
LETTERS = {w: 8 + i for i, w in enumerate(_WORDS)}
_ALL = range(8 + len(LETTERS))


def phrases(kind: int, last: bool = False) -> Transducer:
    """Rewrites the last letter of each phrase of a kind; the state is the longest beginning of a phrase just read. last: other words of phrases become OTHER."""
    known = {tuple(_NAMES.get(w) or _CLASS.get(w) or LETTERS[w] for w in p.split()) for p in PHRASES[kind].split(", ")}
    begun = {p[:i] for p in known for i in range(len(p))}

    def step(q: tuple, a: int):
        read = q + (a,)
        ends = any(read[i:] in known for i in range(len(read)))
        after = next(read[i:] for i in range(len(read) + 1) if read[i:] in begun)
        return after, kind if ends else OTHER if last and a >= 8 else a, 0.0

    return Transducer((), step, _ALL)


_SOFT = {INSULT: INSULT_SOFT, THREAT: THREAT_SOFT}


def negation(left: int, a: int):
    if a == NEGATION:
        return REACH, a, 0.0
    return max(left - 1, 0), _SOFT.get(a, a) if left else a, 0.0


def reported(on: int, a: int):
    return (1, a, 0.0) if a == REPORT else (on, _SOFT.get(a, a) if on else a, 0.0)


def scorer(q: tuple[int, int, int], a: int):
    """State: words for which a target is near, words for which a hit is near, kind of that hit."""
    target, hit, kind = max(q[0] - 1, 0), max(q[1] - 1, 0), q[2]
    bonus = {INSULT: 0.6, THREAT: 1.7, INSULT_SOFT: 0.1, THREAT_SOFT: 0.2}
    base = {INSULT: 1.0, THREAT: 0.2, INSULT_SOFT: 0.25, THREAT_SOFT: 0.0}
    if a in base:
        if q[0]:
            return (target, 0, 0), a, base[a] + bonus[a]
        return (0, REACH, a), a, base[a]
    if a == TARGET:
        return (REACH, 0, 0), a, bonus[kind] if q[1] else 0.0
    return (target, hit, kind if hit else 0), a, 0.0


@functools.cache
def grammar() -> Transducer:
    """Insults, threats, targets, negation, reported speech, score: each reads what the one before writes."""
    machine = phrases(INSULT).compose(phrases(THREAT)).compose(phrases(TARGET, last=True))
    for start, step in ((0, negation), (0, reported), ((0, 0, 0), scorer)):
        machine = machine.compose(Transducer(start, step))
    return machine


def word_hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array([" ".join(words)])).hashes() if words else np.zeros(0, np.uint64)


def lexicon(learned: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their classes."""
    found = {int(h): INSULT for h in np.array(learned, dtype=np.int64).view(np.uint64)}
    for word, kind in (LETTERS | _CLASS).items():
        h = int(word_hashes([word])[0])
        found[h] = found.get(h, kind) if word in LETTERS else kind  # a learned word is an insult rather than a phrase's
    keys = np.array(sorted(found), dtype=np.uint64)
    return keys, np.array([found[int(k)] for k in keys], dtype=np.int64)


#: Letters without which a clause scores nothing: insults, threats and of each of their phrases the last word that only phrases know.
_CORE = np.isin(np.arange(len(_ALL)), [INSULT, THREAT, *([LETTERS[w] for w in p.split() if w in LETTERS][-1] for k in (INSULT, THREAT) for p in PHRASES[k].split(", "))])


def score(arr: pa.Array, keys: np.ndarray, kinds: np.ndarray, go: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of scoring clauses of each text."""
    w = Words(arr)
    total, clauses = np.zeros(len(w.count)), np.zeros(len(w.count), np.int64)
    if not len(w):
        return total, clauses
    h = w.hashes()
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    kind = np.where(keys[at] == h, kinds[at], OTHER)
    core = _CORE[kind]
    if not core.any():
        return total, clauses
    clause = np.cumsum(_BREAK[w.raw])[w.start] + w.row  # never falls; rises at breaks and between texts
    clause = np.cumsum(np.concatenate([[0], (np.diff(clause) > 0).astype(np.int64)]))
    hot = np.zeros(clause[-1] + 1, bool)
    hot[clause[core]] = True
    event = np.flatnonzero((kind != OTHER) & hot[clause])
    c, k = clause[event], kind[event]
    fresh = np.concatenate([[True], c[1:] != c[:-1]])
    gap = np.where(fresh, 0, np.diff(event, prepend=event[0]) - 1)
    gap = np.minimum(gap, REACH + 1)  # more words of no class change nothing
    letters = np.zeros(len(event) + gap.sum(), np.int64)
    ends = np.cumsum(gap + 1) - 1
    letters[ends] = k
    first = (ends - gap)[fresh]
    length = np.diff(np.append(first, len(letters)))
    row = w.row[event[fresh]]
    state, points = np.zeros(len(first), np.int64), np.zeros(len(first))
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")
    for i, n in enumerate(live):
        o = order[:n]
        a = letters[first[o] + i]
        points[o] += weight[state[o], a]
        state[o] = go[state[o], a]
    np.add.at(total, row, points)
    np.add.at(clauses, row, points > 0)
    return total, clauses


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> list[int]:
    """Hashes (as signed integers) of words that tell toxic texts."""
    sample = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = spread(docs.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column("text"))
            h = w.hashes()
            toxic = np.asarray(batch.column("toxic"))[w.row]
            before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
            before[w.first[w.count > 0]] = 0  # the first word of a text has none before it
            long = w.end - w.start >= 4
            rows = np.unique(np.stack([h, before >> np.uint64(40) << np.uint64(1) | toxic], axis=1)[long], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array((rows[:, 1] >> np.uint64(1)).astype(np.int32)), pa.array((rows[:, 1] & np.uint64(1)).astype(bool))], ["word", "before", "toxic"])

    seen = texts.mapInArrow(contexts, "word long, before int, toxic boolean").distinct()
    counts = seen.groupBy("word").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    return [r[0] for r in scratch.write(counts.where((F.col("bad") >= MIN_CONTEXTS) & (F.col("good") <= MAX_CLEAN * F.col("bad"))).select("word"), "lexicon").collect()]


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, clauses of each document."""
    spark = docs.sparkSession
    ship(spark)
    found = spark.sparkContext.broadcast((*lexicon(learn(docs, labels, Scratch(spark))), *grammar().tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds, go, weight = found.value
        for batch in slices(batches):
            total, clauses = score(batch.column("text"), keys, kinds, go, weight)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(total, 6)), pa.array(clauses)], ["doc_id", "score", "clauses"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, clauses long")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where(F.col("score") >= THRESHOLD)
