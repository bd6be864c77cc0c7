"""Multipart credential linking.

Parts are access identifiers, secrets and endpoints, found with their character positions in whole texts. Parts
within one scope (a stretch without a blank line) are linked whatever their distance, by an interval join: a sweep over
the scope's parts in the order of their positions, which counts the complementary ones and finds the nearest. A
document and so its scopes are in one task; nothing is shuffled, and a text full of parts costs no more than its length.

Strong parts (a format that only credentials have, or a named value of high entropy) are reported in any case. Weak
candidates (short named values, bare high-entropy strings, user names, client ids) are reported only if a
complementary part is linked: a secret needs an identifier or an endpoint, an identifier needs a secret. Endpoints
are complements and never reported by themselves.

Parts don't overlap: at each place the first pattern of the list wins, the longest match of it; values of any length
are taken to their end, quoted ones to the closing quote. Null and empty texts have no parts. An empty table gives no
rows. Repeated rows are scanned each. Two complements at the same distance: the one before. Reports carry a digest of
the value, never the value. Other columns aren't read, whatever their names; the stage rewrites `text` (and `n_chars`,
if there) and leaves the others as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship, spread, table

MIN_ENTROPY, MIN_LENGTH = 2.8, 12
_NAME = r"(?<![^\W_])(?:pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?access)?(?:[_-]?key)?|api[_-]?key|access[_-]?token|auth[_-]?token|token|private[_-]?key)"
_SPACE = r"[ \t]*+(?:\r?\n[ \t]*+){0,2}"
#: Between a name and its value.
_IS = rf"[\"']?{_SPACE}(?:=>|[:=]{{1,2}}){_SPACE}"
#: A value in quotes, escapes included, or up to the next space or separator; a key block has its own pattern.
_VALUE = r"(?:\"(?!-----BEGIN )(?P<v>(?:\\.|[^\"\\\n]){4,}+)(?=\")|'(?!-----BEGIN )(?P<w>(?:\\.|[^'\\\n]){4,}+)(?=')|[\"']?(?!-----BEGIN )(?P<x>[^\s\"',;]{4,}+))"
#: What follows a BEGIN line without its END: headers, then runs of base64, the last of any length.
_GAP = r"(?:\s|\\[nr])*+"
_BODY = rf"(?:{_GAP}[A-Z][\w-]*:[^\n]*)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_GAP}[A-Za-z0-9+/]++={{0,2}}(?=[ \t\r]*(?:\n|\Z)))?"
#: (kind, role, strength, pattern); the group "v", "w" or "x", if there, is the value. "named" is strong if its value has enough entropy.
PATTERNS = [
    ("private_key", "secret", "strong", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|" + _BODY + ")"),
    ("aws_key_id", "identifier", "strong", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", "secret", "strong", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", "secret", "strong", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", "secret", "strong", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("google_key", "secret", "strong", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("jwt", "secret", "strong", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_password", "secret", "strong", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:(?P<v>[^\s:/@]{3,}+)@[^\s/]+"),
    ("named", "secret", "weak", rf"(?i:{_NAME}){_IS}{_VALUE}"),
    ("client_id", "identifier", "weak", rf"(?i:\b(?:client|account|tenant|app|access[_-]key)[_-]?id){_IS}[\"']?(?P<v>[\w.@-]{{4,}}+)"),
    ("user_name", "identifier", "weak", rf"(?i:\b(?:user(?:[_-]?name)?|login)){_IS}[\"']?(?P<v>[\w.@-]{{2,}}+)"),
    ("email", "identifier", "weak", r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++"),
    ("url", "endpoint", "weak", r"\b(?:https?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>]{3,}+"),
    ("host", "endpoint", "weak", rf"(?i:\b(?:host(?:name)?|endpoint|server)){_IS}[\"']?(?P<v>[\w.:-]{{3,}}+)"),
    ("ip", "endpoint", "weak", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"),
    ("bare", "secret", "weak", r"(?<![\w/+=-])(?=[A-Za-z_/+-]*+\d)[A-Za-z0-9_/+-]{32,}+={0,2}(?![\w/+=-])"),
]
_ALL = re.compile("|".join(f"(?P<p{i}>{re.sub(r'[?]P<([vwx])>', rf'?P<\g<1>{i}>', p)})" for i, (_, _, _, p) in enumerate(PATTERNS)))
_VALUES = [[f"{g}{i}" for g in "vwx" if f"?P<{g}>" in p] for i, (_, _, _, p) in enumerate(PATTERNS)]
#: What any secret or strong identifier holds; only texts with it are searched for parts.
TRIGGER = r"-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k_(live|test)_|AIza|eyJ|://[^\s:/@]+:[^\s:/@]+@|(?i:pass|pwd|secret|api[_-]?key|token|private[_-]?key)|[A-Za-z0-9_/+-]{32}"
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ()}
FINDING = "scope int, kind string, role string, strength string, start int, stop int, digest string, links long, nearest_kind string, nearest_start int"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def parts(text: str) -> list[tuple]:
    """(scope, kind, role, strong, start, stop, digest) in order of position."""
    out, blank = [], [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    scope = 0
    for m in _ALL.finditer(text):
        i = int(m.lastgroup[1:]) if m.lastgroup[0] == "p" else next(i for i in range(len(PATTERNS)) if m.group(f"p{i}") is not None)
        kind, role, strength, _ = PATTERNS[i]
        value = next((m.group(g) for g in _VALUES[i] if m.group(g) is not None), m.group())
        strong = strength == "strong" or kind == "named" and len(value) >= MIN_LENGTH and entropy(value) >= MIN_ENTROPY and not re.search(r"\s", value)
        if kind == "bare" and entropy(value) < 3.2:
            continue
        while scope < len(blank) and blank[scope] < m.start():
            scope += 1
        out.append((scope, kind, role, strong, m.start(), m.end(), hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]))
    return out


def linked(found: list[tuple]) -> list[tuple]:
    """The reported parts with the number of their complements in the scope and the nearest of them."""
    count = Counter((p[0], p[2]) for p in found)
    near: list[dict[str, tuple]] = [{}, {}]  # of each part: the closest complement before it, and after it
    for side, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        last: dict[tuple, int] = {}
        for i in order:
            scope, _, role, *_ = found[i]
            at = [last[scope, r] for r in COMPLEMENTS[role] if (scope, r) in last]
            near[side][i] = (min if side else max)(at, default=None)
            last[scope, role] = i
    out = []
    for i, (scope, kind, role, strong, start, stop, digest) in enumerate(found):
        links = sum(count[scope, r] for r in COMPLEMENTS[role])
        if role == "endpoint" or not strong and not links:
            continue
        before, after = near[0][i], near[1][i]
        gap = [math.inf if before is None else start - found[before][5], math.inf if after is None else found[after][4] - stop]
        best = None if not links else before if gap[0] <= gap[1] else after
        out.append((scope, kind, role, "strong" if strong else "weak", start, stop, digest, links, *((None, None) if best is None else (found[best][1], found[best][4]))))
    return out


def _suspects(text: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(text, TRIGGER), False)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FINDING.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in FINDING.split(", ")]
    for batch in batches:
        batch = batch.filter(_suspects(batch.column("text")))
        rows, found = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            new = linked(parts(text))
            rows += [i] * len(new)
            found += new
        columns = [pa.array(c, type=k) for c, k in zip(zip(*found) if found else [[]] * len(names), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, type=pa.int64())), *columns], ["doc_id", *names])


def findings(docs: DataFrame) -> DataFrame:
    """The reported parts: doc_id, scope, kind, role, strength, start, stop, digest, links, nearest_kind, nearest_start."""
    ship(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(extract, f"doc_id long, {FINDING}")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential part that is reported, with the parts it is linked with."""
    return findings(table(spark, sf_dir, "documents"))


def masked(text: str) -> str:
    """The text with each reported part replaced by its kind in brackets."""
    out, at = [], 0
    for _, kind, _, _, start, stop, *_ in linked(parts(text)):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = stop
    return "".join(out) + text[at:] if out else text


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each reported part replaced by its kind in brackets."""
    ship(spark)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, hit = list(batch.columns), _suspects(batch.column(at))
            if pc.any(hit).as_py():
                old = columns[at].filter(hit)
                new = pa.array([masked(t) for t in old.to_pylist()], type=old.type)
                changed = pc.replace_with_mask(hit, hit, pc.not_equal(old, new))
                new = new.filter(pc.not_equal(old, new))
                columns[at] = pc.replace_with_mask(columns[at], changed, new)
                if size is not None:
                    columns[size] = pc.replace_with_mask(columns[size], changed, pc.utf8_length(new).cast(columns[size].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return spread(docs).mapInArrow(run, docs.schema)
