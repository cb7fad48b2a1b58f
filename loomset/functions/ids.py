"""Identifier expressions: canonical edges, stable set ids, alias keys, confidence tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXPERIMENTAL_SOURCES, TIER_RANK


def low_end(a: Column, b: Column) -> Column:
    return F.least(a, b)


def high_end(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def stable_id(prefix: str, members: Column) -> Column:
    """``prefix`` + 10 hex digits of the SHA-1 of the sorted ``source:name`` list (array of structs)."""
    text = F.array_join(F.transform(F.array_sort(members), lambda m: F.concat_ws(":", m["source"], m["name"])), "|")
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(text), 1, 10)))


def alias_key(ident: Column) -> Column:
    """Normal form of an identifier before lookup: case, Ensembl version and database prefixes."""
    key = F.upper(F.regexp_replace(ident, r"(?U)^\s+|\s+$", ""))
    key = F.when(key.startswith("ENS") & F.contains(key, F.lit(".")), F.split(key, r"\.")[0]).otherwise(key)
    key = F.when(key.startswith("UNIPROTKB:"), F.substring(key, 11, 1 << 30)).otherwise(key)
    linked = key.startswith("ENTREZ GENE/LOCUSLINK:") | key.startswith("ENTREZGENE/LOCUSLINK:")
    return F.when(linked, F.regexp_replace(key, r"^[^:]*:", "")).otherwise(key)


def evidence_tier(sources: Column, n_pmids: Column, score: Column,
                  experimental: tuple[str, ...] = EXPERIMENTAL_SOURCES) -> Column:
    n_exp = F.size(F.array_intersect(sources, F.array(*[F.lit(s) for s in experimental])))
    return (F.when((n_exp >= 2) | (n_pmids >= 2) | (score >= 900), "high")
            .when((n_exp >= 1) | (score >= 700), "medium").otherwise("low"))


def tier_rank(tier: Column) -> Column:
    out = F.lit(TIER_RANK["low"])
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out
