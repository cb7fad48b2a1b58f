"""Identifier resolution through prioritised alias layers.

Alias rows are (key, symbol, kind, prio, pos). ``kind`` is exact, previous or alias. Among exact rows the
smallest (prio, pos) wins, so "first wins" layers count pos upwards and "last wins" layers downwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import alias_key


def lookup_table(alias_rows: DataFrame) -> DataFrame:
    """One row per key with its exact symbol and the range of previous and alias symbols.

    A key is unambiguous in a layer when the smallest and the largest symbol agree, so no symbol list is
    collected even for a key that a third of all symbols share.
    """
    is_kind = lambda k: F.when(F.col("kind") == k, F.col("symbol"))
    best = F.min(F.when(F.col("kind") == "exact", F.struct("prio", "pos", "symbol")))
    return alias_rows.groupBy("key").agg(
        best["symbol"].alias("exact"),
        F.min(is_kind("previous")).alias("prev_lo"), F.max(is_kind("previous")).alias("prev_hi"),
        F.min(is_kind("alias")).alias("alias_lo"), F.max(is_kind("alias")).alias("alias_hi"))


def resolve(idents: DataFrame, lookup: DataFrame) -> DataFrame:
    """(ident, symbol, how) for every distinct identifier.

    An isoform suffix is dropped only if the whole key is unknown and its stem is exact. A previous symbol
    that is ambiguous ends the search: the alias layer is not asked.
    """
    ids = idents.select("ident").distinct().withColumn("whole", alias_key(F.col("ident"))) \
        .withColumn("stem", F.when(F.contains("whole", F.lit("-")), F.split("whole", "-")[0]))
    asked = ids.select("ident", F.inline(F.array(F.struct(F.lit(0).alias("rank"), F.col("whole").alias("key")),
                                                 F.struct(F.lit(1).alias("rank"), F.col("stem").alias("key"))))) \
        .where("rank = 0 OR key IS NOT NULL")
    layers = ["exact", "prev_lo", "prev_hi", "alias_lo", "alias_hi"]
    found = asked.join(lookup.select("key", F.struct(*layers).alias("l")), "key", "left").groupBy("ident").agg(
        F.max(F.when(F.col("rank") == 0, F.col("l"))).alias("w"), F.max(F.when(F.col("rank") == 1, F.col("l"))).alias("s"))
    best = F.when(F.col("w.exact").isNull() & F.col("s.exact").isNotNull(), F.col("s")).otherwise(F.col("w"))
    hit = found.select("ident", best.alias("l")).select("ident", "l.*")
    prev_one, alias_one = F.col("prev_lo") == F.col("prev_hi"), F.col("alias_lo") == F.col("alias_hi")
    how = (F.when(F.col("exact").isNotNull(), "exact")
           .when(prev_one, "previous").when(F.col("prev_lo").isNotNull(), "ambiguous_previous")
           .when(alias_one, "alias").when(F.col("alias_lo").isNotNull(), "ambiguous_alias").otherwise("unmapped"))
    return hit.withColumn("how", how).select(
        "ident", F.when(F.col("how") == "exact", F.col("exact")).when(F.col("how") == "previous", F.col("prev_lo"))
        .when(F.col("how") == "alias", F.col("alias_lo")).alias("symbol"), "how")


def map_column(df: DataFrame, column: str, lookup: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out`` = symbol of ``column`` (NULL when unresolved); each distinct value is resolved once."""
    table = resolve(df.select(F.col(column).alias("ident")), lookup).select(
        F.col("ident").alias(column), F.col("symbol").alias(out))
    return df.join(table, column, "left")


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def alias_table(lookup: DataFrame, genes: DataFrame) -> DataFrame:
    """(alias, symbol) of release genes: unambiguous keys only, the strongest layer that hits a release gene."""
    one = lambda lo, hi: F.when(F.col(lo) == F.col(hi), F.col(lo))
    options = F.array(F.struct(F.lit(0).alias("rank"), F.col("exact").alias("symbol")),
                      F.struct(F.lit(1).alias("rank"), one("prev_lo", "prev_hi").alias("symbol")),
                      F.struct(F.lit(2).alias("rank"), one("alias_lo", "alias_hi").alias("symbol")))
    rows = lookup.select("key", F.explode(options).alias("o")).select("key", "o.rank", "o.symbol").where("symbol IS NOT NULL")
    return rows.join(genes.select(F.col("gene").alias("symbol")).distinct(), "symbol", "left_semi") \
        .groupBy(F.col("key").alias("alias")).agg(F.min_by("symbol", "rank").alias("symbol"))


def resolve_query(idents: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found symbols (symbol, pos: place of its first mention) and missing identifiers (ident, pos)."""
    at = idents.withColumn("alias", F.upper(F.trim(F.col("ident").cast("string")))).join(aliases, "alias", "left")
    found = at.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min("pos").alias("pos"))
    return found, at.where("symbol IS NULL").select("ident", "pos")
