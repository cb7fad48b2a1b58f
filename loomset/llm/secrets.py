"""Secret scan over a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, listed, no_spans, only, ordered, spans


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of at least ``least`` characters, if given, decides whether a match counts."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The first three are the base rules; the length bounds of access and hex are part of the pattern, which gives the same
# spans as filtering maximal runs.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"ghp_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")


def _runs(nodes, heads: list[list[str]]) -> list[list[str]]:
    """Every way to read ``nodes`` as literal runs; a run ends where the pattern leaves the characters open."""
    for op, arg in nodes:
        if op is C.LITERAL:
            heads = [[*h[:-1], h[-1] + chr(arg)] for h in heads]
        elif op is C.SUBPATTERN:
            heads = _runs(arg[3], heads)
        elif op is C.BRANCH:
            heads = [h for way in arg[1] for h in _runs(way, heads)]
        elif op is C.MAX_REPEAT and (arg[0], arg[1]) == (0, 1) and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
            heads = heads + _runs(arg[2], heads)
        elif op is C.MAX_REPEAT and arg[0] > 0:
            heads = [[*h, ""] for h in _runs(arg[2], heads)]
        else:
            heads = [[*h, ""] for h in heads]
    return heads


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean query of a pattern: one of these sets must be present in full. None: no mandatory trigrams, scan."""
    ways = [frozenset(r[i:i + 3].lower() for r in runs for i in range(len(r) - 2))
            for runs in _runs(_parser.parse(pattern), [[""]])]
    return None if not all(ways) else list(dict.fromkeys(ways))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, h) of the trigrams that occur in any query; h is a hash of the text.

    (doc_id, h) only proposes rows for verification, so equal keys of different rows cost a needless check at most.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.explode(held).alias("trigram"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _matches(rule: Rule, text: Column) -> Column:
    keep = None
    if rule.least:
        keep = lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least
    return spans(text, rule.kind, rule.pattern, keep)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and ``found``, the spans (start, rank, end, kind) sorted by start, then rule.

    Each rule's pattern gives a Boolean trigram query. Postings of the whole table are written once as the index;
    their intersection per text proposes (text, rules) candidates, and only those are verified with the pattern. Before
    the candidates meet the texts, texts without the rarest trigram of any alternative are set aside, so that only
    texts that could be candidates are shuffled. Rules without mandatory trigrams scan every text in place.

    A null text counts as empty. Null or repeated ids and repeated rows keep their own results. Other columns of the
    input are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    base = only(docs, doc_id="bigint", text="string")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind]]
    full = [r for r in rules if not queries[r.kind]]
    kinds = [r.kind for r in rules]
    trigrams = sorted({t for r in indexed for way in queries[r.kind] for t in way})
    text = F.coalesce("text", F.lit(""))

    def scanned(which: list[Rule], guard) -> Column:
        parts = [F.when(guard(r), _matches(r, text)).otherwise(no_spans()) for r in which]
        return F.concat(no_spans(), *parts)

    by_scan = scanned(full, lambda r: F.regexp_like(text, F.lit(r.pattern)))
    if not indexed:
        return base.select("doc_id", ordered(by_scan, kinds).alias("found"))
    index = scratch.cut(build_index(base, trigrams))
    sizes = {r["trigram"]: r["count"] for r in index.groupBy("trigram").count().collect()}  # at most len(trigrams) rows
    holds = lambda t: F.array_contains("held", t)
    passes = [F.when(_any([reduce(lambda a, b: a & b, [holds(t) for t in sorted(way)]) for way in queries[r.kind]]),
                     F.lit(r.kind)) for r in indexed]
    candidates = index.groupBy("doc_id", "h").agg(F.collect_set("trigram").alias("held")).select(
        "doc_id", "h", F.array_compact(F.array(*passes)).alias("rules")).where(F.size("rules") > 0)
    anchors = sorted({min(way, key=lambda t: (sizes.get(t, 0), t)) for r in indexed for way in queries[r.kind]})
    low = F.lower(text)
    possible = _any([F.contains(low, F.lit(t)) for t in anchors])
    apart = base.where(~possible).select("doc_id", ordered(by_scan, kinds).alias("found"))
    left = base.where(possible).withColumn("h", F.xxhash64("text")).alias("d")
    joined = left.join(candidates.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.h = c.h"), "left").select(
        "d.doc_id", "d.text", "c.rules")
    by_index = scanned(indexed, lambda r: F.coalesce(F.array_contains("rules", r.kind), F.lit(False)))
    verified = joined.select("doc_id", ordered(F.concat(by_index, by_scan), kinds).alias("found"))
    return apart.unionByName(verified)


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find_secrets(docs, rules)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by plain scanning of one text, for tests."""
    out = []
    for rank, r in enumerate(rules):
        out += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(r.pattern, text or "")
                if len(m.group(r.group)) >= r.least]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]
