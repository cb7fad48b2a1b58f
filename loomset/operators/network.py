"""Interaction evidence: merging feeds, confidence tiers, overlay on curated pairs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import evidence_tier, tier_rank
from ..schema import EXPERIMENTAL_SOURCES, TIER_RANK
from .enrich import canonical_pairs
from ..session import cut
from .identifiers import resolve
from .vocabulary import known_codes, united


def map_feed(rows: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """Feed rows (feed, id_a, id_b, source, pmid, method, score) with gene_a and gene_b resolved."""
    if lookup is None:
        return rows.withColumn("gene_a", F.col("id_a")).withColumn("gene_b", F.col("id_b"))
    ids = rows.select(F.explode(F.array("id_a", "id_b")).alias("ident"))
    known = cut(resolve(ids, lookup).where("symbol IS NOT NULL").select("ident", "symbol"))
    return rows.join(known.toDF("id_a", "gene_a"), "id_a", "left").join(known.toDF("id_b", "gene_b"), "id_b", "left")


def _real():
    """Both ends resolved, non-empty and different."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return F.coalesce(filled("gene_a") & filled("gene_b") & (F.col("gene_a") != F.col("gene_b")), F.lit(False))


def integrate(mapped: DataFrame, experimental: tuple[str, ...] = EXPERIMENTAL_SOURCES, feed: DataFrame | None = None) -> DataFrame:
    """One row per undirected edge with its united evidence and confidence tier.

    Sources and methods are small vocabularies (united as bit masks where ``feed``, the rows before they were mapped, is
    given to learn them from) and stay as arrays; publications may be many and are only
    counted (the distinct count is split by publication before it is shuffled by edge).
    """
    rows = mapped.where(_real()).select(F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b"),
                                        "source", "pmid", "method", "score")
    method = F.when(F.col("method") != "", F.col("method"))
    codes = None if feed is None else {"sources": known_codes(feed, "source"), "methods": known_codes(feed, "method")}
    edges = united(rows, ["gene_a", "gene_b"], {"sources": F.col("source"), "methods": method}, [
        F.count_distinct(F.when(F.col("pmid") != "", F.col("pmid"))).alias("n_pmids"), F.max("score").alias("string_score")], codes)
    return edges.select(
        "gene_a", "gene_b", "sources", F.size("sources").cast("long").alias("n_sources"), "n_pmids", "methods",
        "string_score", evidence_tier(F.col("sources"), F.col("n_pmids"), F.col("string_score"), experimental).alias("tier"))


def feed_report(mapped: DataFrame) -> DataFrame:
    """Rows read, rows kept and identifiers left unmapped, per feed."""
    ends = F.array(*[F.struct(F.lit(i).alias("end"), F.col(f"id_{x}").alias("i"), F.col(f"gene_{x}").alias("g")) for i, x in enumerate("ab")])
    each = mapped.select("feed", _real().alias("real"), F.inline(ends))
    return each.groupBy("feed").agg(
        F.count_if(F.col("end") == 0).alias("rows"), F.count_if((F.col("end") == 0) & F.col("real")).alias("mapped_rows"),
        F.count_distinct(F.when(F.col("g").isNull(), F.col("i"))).alias("unmapped_ids"))


def overlay(edges: DataFrame, set_pair: DataFrame) -> DataFrame:
    """(gene_a, gene_b, set_id): network edges that are curated pairs of a set."""
    return canonical_pairs(set_pair).join(edges.select("gene_a", "gene_b"), ["gene_a", "gene_b"], "left_semi") \
        .select("gene_a", "gene_b", "set_id")


def with_overlay(edges: DataFrame, supported: DataFrame) -> DataFrame:
    """Edges with the number of sets in which the pair is curated (0 if none)."""
    n = supported.groupBy("gene_a", "gene_b").agg(F.count(F.lit(1)).alias("n_sets"))
    return edges.join(n, ["gene_a", "gene_b"], "left").fillna(0, ["n_sets"])


def up_to_tier(edges: DataFrame, tier: str) -> DataFrame:
    """Edges of a tier and all stronger ones."""
    return edges.where(tier_rank(F.col("tier")) <= TIER_RANK[tier])


def neighbours(edges: DataFrame) -> DataFrame:
    """(gene, partner) in both directions."""
    ways = F.array(F.struct(F.col("gene_a").alias("gene"), F.col("gene_b").alias("partner")),
                   F.struct(F.col("gene_b").alias("gene"), F.col("gene_a").alias("partner")))
    return edges.select(F.inline(ways))


def summary(edges: DataFrame) -> DataFrame:
    """(metric, key, n): edges, edges per tier, per source and per number of sources, genes, supported edges."""
    one = lambda metric, df: df.select(F.lit(metric).alias("metric"), "key", "n")
    count = F.count(F.lit(1)).alias("n")
    total = edges.agg(count).withColumn("key", F.lit(""))
    genes = neighbours(edges).select("gene").distinct().agg(count).withColumn("key", F.lit(""))
    out = one("edges", total).union(one("edges_by_tier", edges.groupBy(F.col("tier").alias("key")).agg(count))) \
        .union(one("edges_per_source", edges.select(F.explode("sources").alias("key")).groupBy("key").agg(count))) \
        .union(one("edges_by_n_sources", edges.groupBy(F.col("n_sources").cast("string").alias("key")).agg(count))) \
        .union(one("genes", genes))
    if "n_sets" in edges.columns:
        held = edges.where("n_sets > 0").agg(count).withColumn("key", F.lit(""))
        out = out.union(one("pathway_supported_edges", held))
    return out
