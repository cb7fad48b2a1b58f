"""Lookups over a release and descriptive statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import neighbours


def collections(gset: DataFrame) -> DataFrame:
    return gset.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def by_lower_name(gset: DataFrame) -> DataFrame:
    """(low, n, first_id): sets that share a name up to case; one counted row a name."""
    return gset.groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("first_id"))


GRAM = 3


def name_grams(gset: DataFrame, set_member: DataFrame) -> DataFrame:
    """(gram, set_id): the postings of every three characters of a set's own name and of its members' names."""
    names = gset.select("set_id", "name").union(set_member.select("set_id", "name")).select("set_id", F.lower("name").alias("low")).distinct()
    each = F.transform(F.sequence(F.lit(1), F.length("low") - (GRAM - 1)), lambda i: F.substring("low", i, F.lit(GRAM)))
    return names.where(F.length("low") >= GRAM).select(F.explode(F.array_distinct(each)).alias("gram"), "set_id").distinct()


def _grams_of(term: str) -> list[str]:
    """What a name that is like the term must hold; wildcards stand for anything."""
    pieces = re.split(r"[%_\\\\]", term.lower())
    return sorted({p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def search(gset: DataFrame, set_member: DataFrame, set_gene: DataFrame, aliases: DataFrame, term: str,
           limit: int | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Sets by name, id or member name (best first), then sets that hold the gene the term resolves to.

    A blank term finds nothing. All finds are returned unless the caller sets a limit. With ``grams`` (``name_grams``)
    only the postings of the term's grams and the names of sets that stand in all of them are read; a term without
    three characters in a row is compared with all names.
    """
    term = term.strip()
    like = f"%{term}%"
    wanted, every_gene_set = _grams_of(term), gset
    if grams is not None and wanted:
        held = grams.where(F.col("gram").isin(wanted)).groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("set_id")
        set_member = set_member.join(held, "set_id", "left_semi")
        gset = gset.join(held.union(gset.where(F.col("set_id").cast("string") == term).select("set_id")), "set_id", "left_semi")
    by_member = set_member.where(F.col("name").ilike(like)).select("set_id").distinct().withColumn("_m", F.lit(True))
    col = F.col("collection")
    order = [F.when(F.lower("name") == term.lower(), 0).otherwise(1).alias("o1"),
             F.when(col == "pathway", 0).when(col.startswith("GO:"), 1).when(col == "msigdb:H", 2).otherwise(3).alias("o2"),
             F.length("name").alias("o3")]
    cols = ["set_id", "name", "collection", "sources", "n_genes"]
    named = gset.join(by_member, "set_id", "left").where(
        F.col("name").ilike(like) | (F.col("set_id").cast("string") == term) | F.coalesce("_m", F.lit(False))) \
        .select(*cols, F.lit(0).alias("o0"), *order)
    gene = aliases.where(F.upper("alias") == term.upper()).select(F.col("symbol").alias("gene"))
    held = set_gene.join(gene, "gene", "left_semi").select("set_id").distinct()
    by_gene = every_gene_set.join(held, "set_id", "left_semi").join(named.select("set_id"), "set_id", "left_anti") \
        .select(*cols, F.lit(1).alias("o0"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3"))
    found = named.union(by_gene).where(F.lit(term != "")).orderBy("o0", "o1", "o2", "o3", "set_id")
    return (found if limit is None else found.limit(limit)).select(cols)


def set_detail(set_id, gset: DataFrame, set_member: DataFrame, set_gene: DataFrame, set_pair: DataFrame,
               set_link: DataFrame, equivalent: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of one set: head, members, genes, pairs, linked sets, equivalents."""
    one = lambda df: df.where(F.col("set_id") == set_id)
    out = {"head": one(gset), "members": one(set_member), "genes": one(set_gene).orderBy("gene"),
           "pairs": one(set_pair),
           "links": linked_sets(gset, set_link.where(F.col("set_a") == set_id))}
    if equivalent is not None:
        out["msigdb_equivalents"] = one(equivalent)
    return out


def linked_sets(gset: DataFrame, set_link: DataFrame) -> DataFrame:
    return set_link.join(gset.select(F.col("set_id").alias("set_b"), "name", "collection"), "set_b") \
        .select("set_a", "set_b", "name", "collection")


def sets_of_genes(gset: DataFrame, set_gene: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, set_id, name, collection, sources) for the given genes."""
    return set_gene.join(genes.select("gene").distinct(), "gene", "left_semi") \
        .join(gset.select("set_id", "name", "collection"), "set_id").select("gene", "set_id", "name", "collection", "sources")


def partners(edges: DataFrame, gene, limit: int | None = None) -> DataFrame:
    """Best-supported partners of one gene."""
    end = F.when(F.col("gene_a") == gene, F.col("gene_b")).otherwise(F.col("gene_a"))
    found = edges.where((F.col("gene_a") == gene) | (F.col("gene_b") == gene)).select(
        end.alias("gene"), "sources", "n_sources", "n_pmids", "string_score", "tier") \
        .orderBy(F.desc("n_sources"), F.desc("n_pmids"), "gene")
    return found if limit is None else found.limit(limit)


def string_partners(edges: DataFrame, gene, limit: int | None = None) -> DataFrame:
    """Partners of one gene in the functional network, best score first."""
    end = F.when(F.col("gene_a") == gene, F.col("gene_b")).otherwise(F.col("gene_a"))
    found = edges.where((F.col("gene_a") == gene) | (F.col("gene_b") == gene)).select(end.alias("gene"), "string_score") \
        .orderBy(F.desc("string_score"), "gene")
    return found if limit is None else found.limit(limit)


def gene_degree(edges: DataFrame) -> DataFrame:
    return neighbours(edges).groupBy("gene").agg(F.count(F.lit(1)).alias("degree"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, gene): genes of one list that the other lacks, ignoring case."""
    key = lambda df: df.select("gene").distinct().withColumn("_k", F.lower(F.col("gene").cast("string")))
    ka, kb = key(a), key(b)
    return ka.join(kb, "_k", "left_anti").select(F.lit("a").alias("side"), "gene").union(
        kb.join(ka, "_k", "left_anti").select(F.lit("b").alias("side"), "gene"))


def source_stats(pathway: DataFrame, gene: DataFrame, pair: DataFrame) -> DataFrame:
    """Per source: pathways, genes, ordered gene pairs and their means per pathway."""
    n = pathway.groupBy("source").agg(F.count_distinct("name").alias("pathways"))
    g = gene.select("source", "name", "gene").distinct().groupBy("source").agg(
        F.count_distinct("gene").alias("genes"), F.count(F.lit(1)).alias("_g"))
    p = pair.select("source", "name", "gene_a", "gene_b").distinct().groupBy("source").agg(
        F.count_distinct("gene_a", "gene_b").alias("gene_pairs"), F.count(F.lit(1)).alias("_p"))
    return n.join(g, "source", "left").join(p, "source", "left").fillna(0).select(
        "source", "pathways", "genes", "gene_pairs", (F.col("_g") / F.col("pathways")).alias("mean_genes_per_pathway"),
        (F.col("_p") / F.col("pathways")).alias("mean_pairs_per_pathway"))


def set_stats(gset: DataFrame, set_member: DataFrame, set_gene: DataFrame, set_pair: DataFrame) -> DataFrame:
    """(metric, value) over all sets; gene_pairs counts ordered pairs."""
    per = set_member.groupBy("set_id").agg(F.count(F.lit(1)).alias("m"))
    merged = F.col("m") > 1

    def stats(df: DataFrame, **values) -> DataFrame:
        """One pass over ``df`` for several metrics."""
        one = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values])))

    n_sets = gset.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    count = F.count(F.lit(1))
    return stats(gset, sets=count).union(stats(per, merged_sets=F.count_if(merged), members_in_merged_sets=F.coalesce(F.sum(F.when(merged, F.col("m"))), F.lit(0)))) \
        .union(stats(set_gene, genes=F.count_distinct("gene"), mean_genes_per_set=count / n_sets)) \
        .union(stats(set_pair, gene_pairs=F.count_distinct("gene_a", "gene_b"), mean_pairs_per_set=count / n_sets))


def support(set_gene: DataFrame) -> DataFrame:
    """Memberships with the number of sources behind them (at least one)."""
    return set_gene.withColumn("n_support", F.greatest(F.size("sources"), F.lit(1)))
