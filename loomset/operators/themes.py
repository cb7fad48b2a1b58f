"""Redundancy-aware grouping of significant results into themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .enrich import significant
from .ordered import global_position, numbered


def hit_order(result: DataFrame, order: list, alpha: float, key: str) -> DataFrame:
    """(set_id, name, ord) of the significant results; ``ord`` counts them from 0 in report order, after a sort over the cluster."""
    return numbered(significant(result, alpha, key).sort(*order).select("set_id", "name"), "ord")


# Pairs of hits that meet in a gene, for each task that counts them: about a tenth of a GB in its table.
PAIRS_A_TASK = 1 << 21
# Hits that a row of a gene holds at most, about; a gene of more hits has several rows.
HITS = 4096


def shared_genes(member: DataFrame, pairs_a_task: int = PAIRS_A_TASK, width: int = HITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(early, late, *carry, k): pairs of hits and how many genes they share. ``member``: gene, ord and columns ``carry`` of the hit,
    which come along for the early one.

    A hit takes along one row for a gene, with all later hits of the gene as an array: a pair is a number in it, not a row, until
    it is counted. Rows of genes are few where their pairs are many, so the number of tasks that count is told by the pairs,
    not by the size of the rows: a task's table of counts does not grow with the input.
    """
    known = member.where("gene IS NOT NULL")
    degree = known.groupBy("gene").agg(F.count(F.lit(1)).alias("_d"))
    met, most = degree.agg(F.sum(F.col("_d").cast("double") * (F.col("_d") - 1) / 2), F.max("_d")).first()
    tasks = max(int((met or 0) / pairs_a_task) + 1, member.sparkSession.sparkContext.defaultParallelism)
    block = F.lit(0)
    if (most or 0) > width:
        known = known.join(degree.where(F.col("_d") > width), "gene", "left")
        block = F.pmod(F.xxhash64("ord"), F.ceil(F.coalesce("_d", F.lit(1)) / width))
    held = known.groupBy("gene", block.alias("_block")).agg(F.collect_list(F.struct("ord", *carry)).alias("_held"))
    a, b = held.select("gene", F.col("_held").alias("_from")), held.select("gene", F.col("_held.ord").alias("_to"))
    met_by = a.join(b, "gene").select(F.explode("_from").alias("_e"), "_to").select(
        F.col("_e.ord").alias("early"), *[F.col("_e")[c].alias(c) for c in carry], F.filter("_to", lambda x: x > F.col("_e.ord")).alias("_late"))
    pairs = met_by.where(F.size("_late") > 0).repartition(tasks, "early").select("early", *carry, F.explode("_late").alias("late"))
    return pairs.groupBy("early", "late", *carry).agg(F.count(F.lit(1)).alias("k"))


def related_hits(hits: DataFrame, set_gene: DataFrame, set_link: DataFrame | None, min_jaccard: float) -> DataFrame:
    """(early, late): pairs of hits, by report order, that are linked or share enough genes."""
    few = hits.agg(F.max("ord")).first()[0] or 0
    ord_ = F.col("ord").cast("int" if few < 1 << 31 else "bigint").alias("ord")  # most of what is shuffled are these numbers
    member = cut(set_gene.select("set_id", "gene").join(hits.select("set_id", ord_), "set_id").select("gene", "ord"))
    size = cut(member.groupBy("ord").agg(F.count(F.lit(1)).cast("int").alias("na")))
    # a late hit has a gene at least: most pairs are ruled out before its size is known
    shared = shared_genes(member.join(size, "ord"), carry=("na",)).where(
        F.col("k") * (1 + min_jaccard) >= (F.col("na") + 1) * min_jaccard - 1e-9)
    size = size.toDF("late", "nb")
    near = shared.join(size, "late") \
        .where(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) >= min_jaccard) \
        .select(F.col("early").cast("long").alias("early"), F.col("late").cast("long").alias("late"))
    if set_link is None:
        return near
    ends = set_link.join(hits.select(F.col("set_id").alias("set_a"), F.col("ord").alias("oa")), "set_a") \
        .join(hits.select(F.col("set_id").alias("set_b"), F.col("ord").alias("ob")), "set_b").where("oa <> ob")
    return near.union(ends.select(F.least("oa", "ob"), F.greatest("oa", "ob"))).distinct()


def leaders(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord) of the hits that no earlier leader is related to.

    Rounds: an undecided hit related to an earlier leader follows it; one without an earlier related hit that is still
    undecided leads. The earliest undecided hit is always decided, chains of related hits set the number of rounds.
    """
    undecided, led = hits.select("ord"), None
    while True:
        if led is not None:
            following = pairs.join(led.withColumnRenamed("ord", "early"), "early").select(F.col("late").alias("ord")).distinct()
            undecided = undecided.join(following, "ord", "left_anti").join(led, "ord", "left_anti")
        undecided = cut(undecided)
        if undecided.isEmpty():
            return led if led is not None else undecided
        waiting = pairs.join(undecided.withColumnRenamed("ord", "early"), "early", "left_semi").select(F.col("late").alias("ord")).distinct()
        fresh = undecided.join(waiting, "ord", "left_anti")
        led = cut(fresh if led is None else led.union(fresh))


def themes(result: DataFrame, set_gene: DataFrame, set_link: DataFrame | None = None, *, order: list,
           alpha: float = 0.05, min_jaccard: float = 0.5, key: str = "fdr") -> DataFrame:
    """``result`` with theme and theme_leader, both NULL beyond alpha.

    A hit joins the first earlier leader it is linked to or overlaps with; it is compared with leaders only. Themes are
    numbered in the order of their leaders. All significant hits are grouped, by joins over the cluster.
    """
    hits = hit_order(result, order, alpha, key)
    pairs = cut(related_hits(hits, set_gene, set_link, min_jaccard))
    led = leaders(hits, pairs)
    number = global_position(led.withColumn("rank", -F.col("ord").cast("double")), "rank", "ord").select(
        F.col("ord").alias("lead"), (F.col("pos") + 1).cast("int").alias("theme"))
    joined = pairs.join(led.withColumnRenamed("ord", "early"), "early").groupBy(F.col("late").alias("ord")).agg(F.min("early").alias("lead"))
    member = joined.join(led, "ord", "left_anti").union(led.select("ord", F.col("ord").alias("lead")))
    named = member.join(number, "lead").join(hits.select(F.col("ord").alias("lead"), F.col("name").alias("theme_leader")), "lead") \
        .join(hits.select("set_id", "ord"), "ord")
    return result.join(named.select("set_id", "theme", "theme_leader"), "set_id", "left")
