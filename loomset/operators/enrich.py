"""Over-representation of genes and of gene pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import hypergeom_sf
from ..session import cut
from .ordered import benjamini_hochberg


def in_collections(c: Column, collections: list[str] | tuple[str, ...] | None) -> Column:
    """A collection is selected by its exact name or as a prefix up to a colon; none selects all."""
    if not collections:
        return F.lit(True)
    out = F.lit(False)
    for name in collections:
        out = out | (c == name) | c.startswith(name + ":")
    return out


def _restrict(set_gene: DataFrame, gset: DataFrame, collections) -> DataFrame:
    if not collections:
        return set_gene
    return set_gene.join(gset.where(in_collections(F.col("collection"), collections)).select("set_id"),
                         "set_id", "left_semi")


def ora(query: DataFrame, gset: DataFrame, set_gene: DataFrame, *, background: DataFrame | None = None,
        collections=None, min_size: int = 5, max_size: int = 2000, min_overlap: int = 2,
        consensus_for: str = "pathway") -> DataFrame:
    """Hypergeometric over-representation per set.

    ``query``/``background``: column gene. ``set_gene``: set_id, gene, sources (distinct memberships).
    The universe is every gene of the selected sets (within the background), and the query is cut to it
    before it is counted. The false discovery rate covers only the sets that reach ``min_overlap``.
    Memberships are reduced per set in one partial-aggregated pass; no set is ever collected.
    """
    member = _restrict(set_gene, gset, collections)
    if background is not None:
        member = member.join(background.select("gene").distinct(), "gene", "left_semi")
    wanted = query.select("gene").distinct().withColumn("_hit", F.lit(1))
    hit = F.col("_hit").isNotNull()
    universe = member.select("gene").distinct().join(wanted, "gene", "left").agg(
        F.struct(F.count(F.lit(1)).alias("pop"), F.count_if(hit).alias("draws")).alias("u")).scalar()
    sizes = member.join(wanted, "gene", "left").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("set_size"),
        F.count_if(hit).alias("overlap"),
        F.count_if(hit & (F.size("sources") >= 2)).alias("_supported"))
    tested = sizes.where(F.col("set_size").between(min_size, max_size) & (F.col("overlap") >= min_overlap))
    scored = tested.withColumn("_u", universe).withColumn("pop", F.col("_u.pop")).withColumn("draws", F.col("_u.draws"))
    k, n_all, succ, n = (F.col(c) for c in ("overlap", "pop", "set_size", "draws"))
    scored = scored.select(
        "set_id", "set_size", "overlap", "pop", "draws",
        (n * succ / n_all).alias("expected"),
        ((k / n) / (succ / n_all)).alias("fold"),
        hypergeom_sf("overlap", "pop", "set_size", "draws").alias("p"),
        (F.col("_supported") / k).alias("_consensus"))
    # the set-level scores are written once: the memberships behind them are not scanned again for the ranks
    named = benjamini_hochberg(cut(scored)).join(gset, "set_id")
    return named.withColumn("consensus", F.when(F.col("collection") == consensus_for, F.col("_consensus"))) \
        .drop("_consensus")


def ora_hits(result: DataFrame, query: DataFrame, set_gene: DataFrame,
             background: DataFrame | None = None) -> DataFrame:
    """(set_id, gene, sources) of the query genes found in each reported set."""
    hits = set_gene.join(query.select("gene").distinct(), "gene", "left_semi")
    if background is not None:
        hits = hits.join(background.select("gene").distinct(), "gene", "left_semi")
    return hits.join(result.select("set_id"), "set_id", "left_semi")


def with_genes(result: DataFrame, hits: DataFrame) -> DataFrame:
    """Reported sets with their sorted hit genes; a list is at most ``max_size`` long by construction."""
    lists = hits.groupBy("set_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return result.join(lists, "set_id", "left")


def ora_order(result: DataFrame) -> DataFrame:
    return result.orderBy("p", F.desc("overlap"), "set_id")


def canonical_pairs(set_pair: DataFrame) -> DataFrame:
    """Distinct unordered pairs per set, self pairs dropped."""
    return set_pair.where("gene_a <> gene_b").select(
        "set_id", F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b")).distinct()


# Sets that a row of a gene holds at most, about; a gene of more sets has several rows.
SETS = 1024


def sets_holding(pairs: DataFrame, member: DataFrame, width: int = SETS) -> DataFrame:
    """``pairs`` (gene_a, gene_b, more) with ``set_id``: a row for every set that holds both genes.

    ``member``: set_id, gene; as often as it names the rarer gene of a pair in a set the row comes. The sets of a gene stand in
    one row, or in several, cut by set, where a gene has more than ``width``. A pair takes along the sets of its rarer end,
    and they are intersected with those of the other end: a pair and set that is no result is never a row.
    """
    member = member.select("set_id", "gene").where("set_id IS NOT NULL AND gene IS NOT NULL")
    kind = member.schema["set_id"].dataType
    if isinstance(kind, T.LongType):  # most of what is shuffled are sets: four bytes where the numbers fit
        low, high = member.agg(F.min("set_id"), F.max("set_id")).first()
        if -1 << 31 <= (low or 0) and (high or 0) < 1 << 31:
            member = member.withColumn("set_id", F.col("set_id").cast("int"))
    degree = cut(member.groupBy("gene").agg(F.count(F.lit(1)).alias("_deg")))
    blocks = -(-(degree.agg(F.max("_deg")).first()[0] or 0) // width) or 1
    block = F.pmod(F.xxhash64("set_id"), F.lit(blocks)).cast("int").alias("_block")
    held = cut(member.groupBy("gene", block).agg(F.array_sort(F.collect_list("set_id")).alias("_sets")))
    sized = pairs.join(degree.toDF("gene_a", "_da"), "gene_a").join(degree.toDF("gene_b", "_db"), "gene_b")
    few = F.col("_da") <= F.col("_db")
    ends = sized.select(*pairs.columns, F.when(few, F.col("gene_a")).otherwise(F.col("gene_b")).alias("_start"),
                        F.when(few, F.col("gene_b")).otherwise(F.col("gene_a")).alias("_other"))
    opened = ends.join(held.toDF("_start", "_block", "_from"), "_start").join(held.toDF("_other", "_block", "_to"), ["_other", "_block"])
    shared = opened.select(*pairs.columns, "_from", F.explode(F.array_intersect("_to", "_from")).alias("_set"))
    return shared.select(*pairs.columns, F.explode(F.filter("_from", lambda s: s == F.col("_set"))).alias("set_id")) \
        .withColumn("set_id", F.col("set_id").cast(kind))


def edges_within_sets(edges: DataFrame, set_gene: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(set_id, gene_a, gene_b, *keep): network edges with both ends in a set."""
    keep = keep or []
    real = edges.where("gene_a <> gene_b").select("gene_a", "gene_b", *keep)
    return sets_holding(real, set_gene).select("set_id", "gene_a", "gene_b", *keep)


def tested_pairs(set_pair: DataFrame, gset: DataFrame, set_gene: DataFrame | None = None,
                 edges: DataFrame | None = None, collections=("pathway",), min_pairs: int = 5) -> DataFrame:
    """Pairs of every set that has at least ``min_pairs`` of them (curated, plus network edges if given)."""
    pairs = canonical_pairs(_restrict(set_pair, gset, collections))
    if edges is not None:
        inner = edges_within_sets(edges, _restrict(set_gene, gset, collections))
        pairs = pairs.union(canonical_pairs(inner)).distinct()
    enough = pairs.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_pairs")).where(F.col("set_pairs") >= min_pairs)
    return pairs.join(enough, "set_id")


def pair_ora(query: DataFrame, gset: DataFrame, set_pair: DataFrame, *, set_gene: DataFrame | None = None,
             edges: DataFrame | None = None, collections=("pathway",), min_pairs: int = 5,
             min_overlap: int = 1) -> DataFrame:
    """Over-representation of the relations among the query genes in each set's wiring."""
    # three readers follow: all pairs, the hit pairs and the counts per set
    pairs = cut(tested_pairs(set_pair, gset, set_gene, edges, collections, min_pairs))
    genes = query.select("gene").distinct()
    hits = pairs.join(genes.toDF("gene_a"), "gene_a", "left_semi").join(genes.toDF("gene_b"), "gene_b", "left_semi")
    pop = pairs.select("gene_a", "gene_b").distinct().agg(F.count(F.lit(1)).alias("n"))
    draws = hits.select("gene_a", "gene_b").distinct().agg(F.count(F.lit(1)).alias("n"))
    found = hits.groupBy("set_id").agg(F.count(F.lit(1)).alias("overlap_pairs"),
                                       F.first("set_pairs").alias("set_pairs"))
    scored = found.where(F.col("overlap_pairs") >= min_overlap) \
        .withColumn("pop", pop.scalar()).withColumn("draws", draws.scalar())
    n_all, succ, n = (F.col(c) for c in ("pop", "set_pairs", "draws"))
    scored = scored.select("set_id", "set_pairs", "overlap_pairs", "pop", "draws",
                           (n * succ / n_all).alias("expected"), hypergeom_sf("overlap_pairs", "pop", "set_pairs", "draws").alias("p"))
    return benjamini_hochberg(cut(scored)).join(gset, "set_id")


def pair_hits(result: DataFrame, query: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, gene_a, gene_b): the pairs of each reported set with both genes in the query.

    Kept as rows because a set may hold any number of pairs.
    """
    genes = query.select("gene").distinct()
    return pairs.select("set_id", "gene_a", "gene_b") \
        .join(genes.toDF("gene_a"), "gene_a", "left_semi").join(genes.toDF("gene_b"), "gene_b", "left_semi") \
        .join(result.select("set_id"), "set_id", "left_semi")


def significant(result: DataFrame, alpha: float = 0.05, key: str = "fdr") -> DataFrame:
    return result.where(F.coalesce(F.col(key), F.lit(1.0)) <= alpha)
