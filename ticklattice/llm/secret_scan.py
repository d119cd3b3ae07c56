"""Secrets in texts, by a trigram inverted index.

A Boolean query over trigrams follows from each rule's regular expression: every text
it matches satisfies the query. Texts are cut into shards of a few MB; a shard's index
has, for each trigram that some query asks for, the numbers of its texts with that
trigram. Postings are intersected and united as the query says, and the rule's
expression runs over the texts that are left. A rule without a mandatory trigram runs
over all texts. A shard's index lives and dies in the task that reads its texts, so
there is no shuffle, memory is a shard's or one text's, and a lost task is run again.

Trigrams are of UTF-8 bytes with A-Z in lower case, so one index serves rules in either
case. Matches are leftmost and not overlapping for each rule; those whose group is
shorter than the rule asks for are dropped after matching. Positions are code points,
ends exclusive. Null text counts as empty and has no spans; rows stay one to one,
whatever their ids, and columns besides those asked for are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import slices

#: Bytes of text in a shard, and bytes of text that are turned into trigrams at once.
SHARD, STRETCH = 4_000_000, 1 << 20
#: Strings that stand for a part of an expression: beyond so many, or for larger classes of characters, it counts as unknown.
MOST_STRINGS, MOST_CHARACTERS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has `least` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# What is asked for, then well-known forms of tokens and keys.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs that [0-9a-f]+ finds, less the short ones
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def lowered(data: bytes) -> bytes:
    """A-Z in lower case, other bytes as they are."""
    return data.lower()


def trigrams(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)]


def _any(strings: set[bytes]):
    """The query of texts that hold one of the strings; True asks for nothing."""
    if any(len(s) < 3 for s in strings):
        return True
    asks = {s: frozenset(trigrams(s)) for s in sorted(strings)}
    return _either([_both(trigrams(s)) for s, own in asks.items() if not any(other < own for other in asks.values())])


def _both(queries: list):
    own = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not own else own[0] if len(own) == 1 else ("and", *own)


def _either(queries: list):
    return True if True in queries else queries[0] if len(set(queries)) == 1 else ("or", *dict.fromkeys(queries))


def _joined(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST_STRINGS else None


def _query(nodes, flags: int) -> tuple[set[bytes] | None, object]:
    """The strings that the nodes match, one after the other, if they are few (else None), and the query of what they match."""
    queries, run, whole = [], {b""}, True

    def cut():
        nonlocal run, whole
        queries.append(_any(run))
        run, whole = {b""}, False

    for op, arg in nodes:
        strings, query = _node(op, arg, flags)
        if strings is not None:
            if (longer := _joined(run, strings)) is None:
                cut()
                longer = strings
            run = longer
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:  # once at least: it begins with one of these
            once, _ = _query(arg[2], flags)
            if once is not None and (longer := _joined(run, once)) is not None:
                run = longer
        cut()
        queries.append(query)
    if whole:
        return run, _any(run)
    queries.append(_any(run))
    return None, _both(queries)


def _node(op, arg, flags: int) -> tuple[set[bytes] | None, object]:
    folds = flags & re.IGNORECASE and not flags & re.ASCII  # then k and s have forms outside ASCII
    if op is C.LITERAL:
        return (None, True) if folds else ({lowered(chr(arg).encode("utf-8", "surrogatepass"))}, True)
    if op is C.IN and not folds and all(x[0] in (C.LITERAL, C.RANGE) for x in arg):
        own = {c for kind, v in arg for c in ([v] if kind is C.LITERAL else range(v[0], min(v[1], v[0] + MOST_CHARACTERS) + 1))}
        return ({lowered(chr(c).encode("utf-8", "surrogatepass")) for c in own} if len(own) <= MOST_CHARACTERS else None), True
    if op is C.SUBPATTERN:
        _, on, off, inner = arg
        return _query(inner, (flags | on) & ~off)
    if op is C.BRANCH:
        found = [_query(x, flags) for x in arg[1]]
        strings = set().union(*(s for s, _ in found if s is not None))
        if all(s is not None for s, _ in found) and len(strings) <= MOST_STRINGS:
            return strings, _any(strings)
        return None, _either([q for _, q in found])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _query(inner, flags)
        if strings is not None and high == 1 and not low:
            return strings | {b""}, True
        return None, query if low else True
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}, True
    return None, True  # unknown: asks for nothing


def required(pattern: str):
    """The trigram query of a regular expression: True, a trigram, or ("and" | "or", queries)."""
    tree = _parser.parse(pattern)
    return _query(tree, tree.state.flags)[1]


def asked(query) -> set[int]:
    """The trigrams of a query."""
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(asked, query[1:]))


class Postings:
    """For each wanted trigram the ascending numbers of the texts that hold it."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray, table: np.ndarray):
        self.n, self.of = len(texts), {}
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data = lowered(b"".join(texts))
        pairs = [np.zeros(0, np.int64)]
        for at in range(0, max(0, len(data) - 2), STRETCH):
            b = np.frombuffer(data, np.uint8, min(STRETCH + 2, len(data) - at), at).astype(np.int32)
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            hit = np.flatnonzero(table[code])
            text = np.searchsorted(ends, hit + at, "right")
            inside = hit + at + 2 < ends[text]  # not across two texts
            pairs.append(np.unique(code[hit[inside]].astype(np.int64) * self.n + text[inside]))
        found = np.unique(np.concatenate(pairs))
        codes, starts = np.unique(found // max(1, self.n), return_index=True)
        for c, own in zip(codes.tolist(), np.split(found % max(1, self.n), starts[1:]), strict=False):
            self.of[c] = own

    def texts(self, query) -> np.ndarray:
        """The numbers of the texts that satisfy the query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.of.get(query, np.zeros(0, np.int64))
        sets = sorted(map(self.texts, query[1:]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(sets))
        out = sets[0]
        for s in sets[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, s, assume_unique=True)
        return out


class Scanner:
    """spans(texts): for each text the (rule's number, start, end) found. checked counts the texts each rule ran over."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.queries = rules, [required(r.pattern) for r in rules]
        self.own = [re.compile(r.pattern) for r in rules]
        self.wanted = np.array(sorted(set().union(set(), *map(asked, self.queries))), np.int64)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.wanted] = True
        self.checked: Counter[str] = Counter()

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = Postings([t.encode("utf-8", "surrogatepass") for t in texts], self.wanted, self.table)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, own) in enumerate(zip(self.rules, self.queries, self.own, strict=True)):
            some = index.texts(query).tolist()
            self.checked[rule.name] += len(some)
            for i in some:
                for m in own.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((k, m.start(), m.end()))
        return [sorted(x, key=lambda s: (s[1], s[0])) for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *keep: str) -> DataFrame:
    """The columns in `keep` (doc_id, if none) and found: an array of (kind, start, end) by start, then order of the rules."""
    keep = keep or ("doc_id",)
    kinds = dict(docs.dtypes)
    names = [r.name for r in rules]
    own = docs.select(*keep, F.coalesce(docs["text"], F.lit("")).alias("_scanned"))

    def run(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for b in slices(whole, "_scanned", SHARD):
                found = scanner.spans(b.column("_scanned").to_pylist())
                rows = pa.array([[{"kind": names[k], "start": s, "end": e} for k, s, e in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], rows], names=[*keep, "found"])

    return own.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "found array<struct<kind: string, start: long, end: long>>"]))


def op_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.name for r in BASE]
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return scan(docs).select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(text(of(*base)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same rows in DuckDB's SQL over a view named documents: each expression over all texts."""
    either = lambda p: re.sub(r"\(\?ai:(.*?)\)\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", p)
    parts = []
    for k, r in enumerate(BASE + MORE):
        p = either(r.pattern).replace("'", "''")
        parts.append(f"""select r, {k} as k, '{r.name}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) as x
          from (select r, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as g, string_split_regex(t, '{p}') as p from d) where len(m) > 0""")
        parts[-1] = f"select r, k, kind, cast(x.s as bigint) as s, cast(x.s + x.n as bigint) as e from ({parts[-1]}) where x.g >= {r.least}"
    base = ", ".join(f"'{r.name}'" for r in BASE)
    return f"""with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    f as materialized ({" union all ".join(parts)}),
    s as (select r, {", ".join(f"count(*) filter (kind = '{r.name}') as n_{r.name}" for r in BASE)},
            string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (kind in ({base})) as b, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from f group by r)
    select d.doc_id, {", ".join(f"coalesce(s.n_{r.name}, 0) as n_{r.name}" for r in BASE)}, sha256(coalesce(s.b, '')) as base_sha256, coalesce(s.spans, '') as spans
    from d left join s on s.r = d.r"""


SQL = _sql()
