"""URL rules as a bit-parallel automaton: all glob rules over each canonical URL at once.

Every rule is a glob (`*` any run, `?` one character, `[a-z]` and `[!a-z]` one of a class or none of it). The positions of all rules are packed into a row of 64-bit
words; a rule may straddle words. A step shifts the state by one bit with carries between words (Shift-And), masks
it with the positions that accept the character, and keeps the positions that carry a `*` loop. The state of many
URLs is one matrix, so a step costs a few vector operations for all rules and all URLs of a piece.

Canonical form: trimmed, scheme and host in lower case, no user, no default port, no fragment, path at least `/`.
A null or blank URL matches no rule and is kept. Repeated rows are treated alike. No cap on length: the automaton
runs to the end of the longest URL. An allow rule (first character `@`) that matches overrides all others; of several
rules that match all are listed. An empty table gives no rows. Columns beside `page_id` and `url` aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import strings
from .runtime import ship, table

#: Ad hosts, trackers, session and shopping-cart pages, binary files, paginated listings; `@`: allowed after all.
RULES = [
    "*://ads.*", "*://ad.*", "*://*.ads.*/*", "*/ads/*", "*/adserver/*", "*/banner*", "*://*.doubleclick.net/*", "*://*.adnxs.com/*",
    "*://track*.*/*", "*/pixel?gif*", "*utm_source=*", "*utm_medium=*", "*utm_campaign=*", "*[?&]gclid=*", "*fbclid=*", "*sessionid=*", "*phpsessid=*", "*jsessionid=*", "*[?&]sid=*",
    "*/login*", "*/signin*", "*/signup*", "*/register*", "*/logout*", "*/cart*", "*/checkout*", "*/basket*", "*/wp-admin/*", "*/wp-login*", "*/cgi-bin/*", "*/admin/*",
    "*.exe", "*.zip", "*.gz", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.css", "*.js", "*.mp4", "*.pdf?*",
    "*[?&]page=???*", "*/page/???*", "*/tag/*/*", "*/search?*", "*[?&]sort=*", "*[?&]replytocom=*", "*/print/*", "*/feed/", "*/trackback/",
    "*://*.xxx/*", "*casino*", "*viagra*", "*porn*", "*://*.onion/*", "*://localhost/*", "*://127.*", "*://192.168.*",
    "@*://*.example.org/robots.txt", "@*://*/sitemap.xml",
]


_CONTINUES = frozenset(range(0x80, 0xC0))
#: What a position accepts: bytes, and whether further bytes of the same character follow (then they are passed over).
_ANY = frozenset(range(256)) - _CONTINUES, True


def members(rule: str, at: int, stop: int) -> tuple[bool, list[str]]:
    """Whether a class (between its brackets) is negated, and its characters, ranges spelled out."""
    text = rule[at:stop]
    negated = len(text) > 1 and text[0] in "!^"
    text, out, i = text[negated:], [], 0
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            out += map(chr, range(ord(text[i]), ord(text[i + 2]) + 1))
            i += 3
        else:
            out.append(text[i])
            i += 1
    return negated, sorted(set(out))


def tokens(rule: str) -> list[tuple]:
    """("*",), ("?",), ("c", character) or ("[", negated, characters)."""
    out, i = [], 0
    while i < len(rule):
        c = rule[i]
        if c == "[" and "]" in rule[i + 2 :]:
            j = rule.index("]", i + 2)
            out.append(("[", *members(rule, i + 1, j)))
            i = j
        else:
            out.append((c,) if c in "*?" else ("c", c))
        i += 1
    return out


def parse(rule: str) -> list[tuple[list[tuple[frozenset[int], bool]], list[bool]]]:
    """The forms of a rule: what each position accepts, and which positions have a loop before the next one.

    A class with characters of several bytes gives a form for each of these and one for the others.
    """
    choices: list[list] = []
    for kind, *rest in tokens(rule):
        if kind == "[":
            negated, chars = rest
            single, wide = {ord(c) for c in chars if ord(c) < 128}, [c for c in chars if ord(c) >= 128]
            if negated and wide:
                raise ValueError(f"a negated class of characters beyond ASCII in {rule!r}")
            choices.append([(_ANY[0] - single, True)] if negated else [(frozenset(single), False)] * bool(single) + wide)
        else:
            choices.append(["*" if kind == "*" else _ANY if kind == "?" else rest[0]])
    forms = []
    for pick in product(*choices):
        accepts, loops = [], [False]
        for x in pick:
            if x == "*":
                loops[-1] = True
                continue
            for one in [x] if isinstance(x, tuple) else [(frozenset([b]), False) for b in x.encode()]:
                accepts.append(one)
                loops.append(False)
        forms.append((accepts, loops))
    return forms


class Automaton:
    """Bit 0 of a form is its start; bit k is set after k of its positions were consumed."""

    def __init__(self, rules: list[str]):
        forms = [parse(r.removeprefix("@")) for r in rules]
        self.forms = np.cumsum([0, *map(len, forms)])
        parsed = [f for many in forms for f in many]
        first = np.cumsum([0, *(len(loops) for _, loops in parsed)])
        self.words = max(1, -(-int(first[-1]) // 64))
        size = 64 * self.words
        accept, keep, start, final = np.zeros((256, size), bool), np.zeros((256, size), bool), np.zeros(size, bool), []
        for at, (accepts, loops) in zip(first, parsed):
            start[at] = True
            keep[:, at : at + len(loops)] = loops
            final.append(int(at) + len(loops) - 1)
            for k, (found, wide) in enumerate(accepts):
                accept[list(found), at + k + 1] = True
                if wide:  # the rest of a character of several bytes
                    keep[0x80:0xC0, at + k + 1] = True
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8")
        self.accept, self.keep, self.start, self.final = pack(accept), pack(keep), pack(start), np.array(final, dtype=np.int64)

    def run(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Boolean matrix: URL, rule."""
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        state = np.tile(self.start, (len(length), 1))
        live = np.searchsorted(-length[order], -np.arange(1, length.max(initial=0) + 1), side="right")
        begin = off[:-1][order]
        for i, n in enumerate(live):
            d, byte = state[:n], raw[begin[:n] + i]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            moved &= self.accept[byte]
            d &= self.keep[byte]
            d |= moved
        hit = ((state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)
        out = np.zeros((len(length), len(self.forms) - 1), bool)
        some = np.flatnonzero(np.diff(self.forms))
        if len(some) and len(length):
            out[np.ix_(order, some)] = np.logical_or.reduceat(hit, self.forms[some], axis=1)
        return out


def canonical(url: Column) -> Column:
    u = F.trim(url)
    u = F.regexp_replace(u, "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    rest = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(u.isNull() | (u == ""), F.lit(None)).when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, rest))


def match(pages: DataFrame, rules: list[str] = RULES) -> DataFrame:
    """page_id, canonical_url, rules (indices of those that match, ascending), blocked."""
    spark = pages.sparkSession
    ship(spark)
    allow = np.array([r.startswith("@") for r in rules], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hit = automaton.run(*strings(part.column("canonical_url")))
                hit[np.asarray(part.column("canonical_url").is_null())] = False
                n = hit.sum(axis=1)
                blocked = (hit & ~allow).any(axis=1) & ~(hit & allow).any(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.nonzero(hit)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("canonical_url"), lists, pa.array(blocked)], ["page_id", "canonical_url", "rules", "blocked"])

    return pages.select("page_id", canonical(F.col("url")).alias("canonical_url")).mapInArrow(run, "page_id long, canonical_url string, rules array<int>, blocked boolean")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "canonical_url", F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"), "blocked")


def _regex(rule: str) -> str:
    out = ""
    for kind, *rest in tokens(rule.removeprefix("@")):
        if kind == "[":
            out += "[" + "^" * rest[0] + "".join("\\" + c if c in "\\]^-[" else c for c in rest[1]) + "]"
        else:
            c = rest[0] if rest else kind
            out += r"[\s\S]*" if kind == "*" else r"[\s\S]" if kind == "?" else c if c.isalnum() or c in "/:_=-" else "\\" + c
    return out


SQL = """
with raw as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages),
parts as (select page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)) as host,
    regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) as rest from raw),
clean as (select page_id, case when u is null or u = '' then null when scheme = '' then u else scheme || '://' ||
    case when scheme = 'http' then regexp_replace(host, ':80$', '') when scheme = 'https' then regexp_replace(host, ':443$', '') else host end ||
    case when starts_with(rest, '/') then rest else '/' || rest end end as canonical_url from parts),
rules(id, allow, pattern) as (values %s),
hits as (select page_id, canonical_url, string_agg(id::varchar, ',' order by id) as ids, bool_or(not allow) as bad, bool_or(allow) as good
    from clean, rules where regexp_full_match(canonical_url, pattern) group by page_id, canonical_url)
select c.page_id, c.canonical_url, coalesce(ids, '') as rules, coalesce(bad and not good, false) as blocked
from clean c left join hits h on c.page_id = h.page_id and c.canonical_url = h.canonical_url
""" % ", ".join("(%d, %s, '%s')" % (i, str(r.startswith("@")).lower(), _regex(r)) for i, r in enumerate(RULES))  # fmt: skip
