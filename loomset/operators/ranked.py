"""Preranked enrichment: running-sum scores, size-matched permutation null, normalised scores and FDR."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .enrich import _restrict
from .ordered import benjamini_hochberg, global_position

_BLOCK = 32


def rank_genes(ranking: DataFrame, weight: float = 1.0) -> DataFrame:
    """(gene, score, pos, w): positions by score, ties by input order (numeric column ``input_pos``)."""
    return global_position(ranking, "score", "input_pos").select(
        "gene", "score", F.col("pos").cast("long").alias("pos"), F.pow(F.abs("score"), F.lit(weight)).alias("w"))


def ranked_hits(ranked: DataFrame, gset: DataFrame, set_gene: DataFrame, collections=None, min_size: int = 15,
                max_size: int = 500) -> DataFrame:
    """(set_id, gene, pos, w, k) of the sets whose number of ranked genes lies in the size window.

    Sizes are counted by partial aggregation first; only sets of at most ``max_size`` genes reach a window.
    """
    member = _restrict(set_gene, gset, collections).select("set_id", "gene").join(ranked, "gene")
    size = member.groupBy("set_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(min_size, max_size))
    return member.join(size, "set_id").select("set_id", "gene", "pos", "w", "k")


def running_sum(hits: DataFrame, n_genes) -> DataFrame:
    """Per hit the running sum right after it (``top``) and right before it (``bottom``)."""
    order = W.partitionBy("set_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("set_id")
    norm = F.sum("w").over(whole)
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    j = F.row_number().over(W.partitionBy("set_id").orderBy("pos")) - 1
    at = hits.withColumn("j", j).withColumn("share", F.sum("w").over(order) / norm).withColumn("own", F.col("w") / norm)
    miss = (F.col("pos") - F.col("j")) / F.greatest(n_genes - F.col("k"), F.lit(1))
    return at.withColumn("top", F.col("share") - miss).withColumn("bottom", F.col("share") - F.col("own") - miss)


def observed(sums: DataFrame) -> DataFrame:
    """(set_id, k, es, peak): the larger extremum by absolute value; the maximum wins a tie, the first hit too."""
    ends = sums.groupBy("set_id", "k").agg(
        F.max(F.struct("top", (-F.col("j")).alias("nj"))).alias("hi"),
        F.min(F.struct("bottom", "j")).alias("lo"))
    up = F.abs("hi.top") >= F.abs("lo.bottom")
    return ends.select("set_id", "k", F.when(up, F.col("hi.top")).otherwise(F.col("lo.bottom")).alias("es"),
                       F.when(up, -F.col("hi.nj")).otherwise(F.col("lo.j")).alias("peak"))


def leading_edge(sums: DataFrame, scores: DataFrame) -> DataFrame:
    """(set_id, gene, j): hits up to the peak of a positive score, from the peak of a negative one."""
    at = sums.join(scores.select("set_id", "es", "peak"), "set_id")
    return at.where(F.when(F.col("es") >= 0, F.col("j") <= F.col("peak")).otherwise(F.col("j") >= F.col("peak"))) \
        .select("set_id", "gene", "j")


# Draws (a gene in a permutation) that one task hashes.
DRAWS_A_TASK = 1 << 22


def _drawn(ranked: DataFrame, kmax: int, nperm: int, seed: int) -> DataFrame:
    """(perm, i, pos, w): per permutation the ``kmax`` genes that come first in the order of a hash of (seed, perm, gene).

    One scheme at every size, the same on every engine that has MD5. Hashes spread evenly, so the first ``kmax`` lie below a
    bound that few more genes reach: only those are sorted. Where a permutation has fewer genes below the bound, it is doubled.
    """
    n_genes = ranked.count()
    tasks = max(n_genes * nperm // DRAWS_A_TASK + 1, ranked.sparkSession.sparkContext.defaultParallelism)
    rows = ranked.select("gene", "pos", "w").repartition(tasks, "pos") \
        .select("gene", "pos", "w", F.explode(F.sequence(F.lit(0), F.lit(nperm - 1))).alias("perm"))
    keyed = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("gene").cast("string"))))
    share = (kmax + 10 * kmax ** 0.5 + 20) / max(n_genes, 1)
    while share < 1:
        first = cut(keyed.where(F.col("h") < f"{int(share * (1 << 64)):016x}"))
        if first.groupBy("perm").count().where(F.col("count") >= kmax).count() == nperm:
            keyed = first
            break
        share *= 2
    order = W.partitionBy("perm").orderBy("h", "gene")
    return keyed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= kmax).select(
        F.col("perm").cast("long").alias("perm"), (F.col("n") - 1).alias("i"), "pos", "w")


def null_scores(ranked: DataFrame, sizes: DataFrame, n_genes: int, nperm: int, seed: int) -> DataFrame:
    """(k, perm, es): null scores for every set size that occurs.

    Bounded by nperm * (max_size - min_size + 1) rows. Permutations are blocks of tasks; no task needs the whole ranking.
    """
    ks = sorted(r["k"] for r in sizes.select("k").distinct().collect())  # at most max_size - min_size + 1 values
    drawn = _drawn(ranked, ks[-1], nperm, seed)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["perm", "i"])
        perms = pdf["perm"].unique()
        pos = pdf["pos"].to_numpy().reshape(len(perms), -1)
        w = pdf["w"].to_numpy().reshape(len(perms), -1)
        out = []
        for k in ks:
            order = np.argsort(pos[:, :k], axis=1)
            p, x = np.take_along_axis(pos[:, :k], order, 1), np.take_along_axis(w[:, :k], order, 1)
            total = x.sum(axis=1, keepdims=True)
            x = x / np.where(total == 0, 1.0, total)
            miss = (p - np.arange(k)) / max(n_genes - k, 1)
            run = np.cumsum(x, axis=1)
            hi, lo = (run - miss).max(axis=1), (run - x - miss).min(axis=1)
            out.append(pd.DataFrame({"k": k, "perm": perms, "es": np.where(np.abs(hi) >= np.abs(lo), hi, lo)}))
        return pd.concat(out)

    # a block is at most 32 permutations of at most max_size draws
    return drawn.withColumn("block", F.floor(F.col("perm") / _BLOCK)).groupBy("block").applyInPandas(
        score, "k long, perm long, es double")


def _signed_rank_share(rows: DataFrame) -> DataFrame:
    """(nes, fdr) per distinct observed value from rows (v, null_n, obs_n); one pass per sign.

    Bounded: distinct null values are at most nperm times the number of sizes, observed ones are rounded.
    """
    table = rows.groupBy("v").agg(F.sum("null_n").alias("null_n"), F.sum("obs_n").alias("obs_n")) \
        .withColumn("sign", F.when(F.col("v") >= 0, 1).otherwise(-1))
    out = W.partitionBy("sign").orderBy(F.abs("v").desc()).rowsBetween(W.unboundedPreceding, 0)
    side = W.partitionBy("sign")
    null = F.sum("null_n").over(out) / F.greatest(F.sum("null_n").over(side), F.lit(1))
    obs = F.sum("obs_n").over(out) / F.greatest(F.sum("obs_n").over(side), F.lit(1))
    return table.withColumn("_null", null).withColumn("_obs", obs).where("obs_n > 0").select(
        F.col("v").alias("nes"), F.when(F.col("_obs") > 0, F.least(F.lit(1.0), F.col("_null") / F.col("_obs")))
        .otherwise(F.lit(1.0)).alias("fdr"))


def gsea(ranking: DataFrame, gset: DataFrame, set_gene: DataFrame, *, collections=None, min_size: int = 15,
         max_size: int = 500, nperm: int = 1000, weight: float = 1.0, seed: int = 0) -> DataFrame:
    """Preranked enrichment: set_id, set_size, es, nes, p, fdr (pooled null), padj (step-up), peak, name, collection."""
    ranked = cut(rank_genes(ranking, weight))
    n_genes = ranked.count()
    sums = running_sum(ranked_hits(ranked, gset, set_gene, collections, min_size, max_size), F.lit(n_genes))
    scores = cut(observed(sums))
    if scores.isEmpty():
        return scores.select("set_id", F.col("k").alias("set_size"), "es", F.lit(None).cast("double").alias("nes"),
                             *[F.lit(None).cast("double").alias(c) for c in ("p", "fdr", "padj")], "peak").join(gset, "set_id")
    null = cut(null_scores(ranked, scores, n_genes, nperm, seed))
    by_size = null.groupBy("k").agg(
        F.avg(F.when(F.col("es") >= 0, F.col("es"))).alias("up"), F.count_if(F.col("es") >= 0).alias("n_up"),
        F.abs(F.avg(F.when(F.col("es") < 0, F.col("es")))).alias("down"), F.count_if(F.col("es") < 0).alias("n_down"))
    # nominal p: scores and null values of one size in one order; equal (k, es) are counted once
    values = scores.groupBy("k", "es").agg(F.lit(0).cast("long").alias("c")).union(
        null.groupBy("k", "es").agg(F.count(F.lit(1)).alias("c"))).groupBy("k", "es").agg(F.sum("c").alias("c")) \
        .withColumn("neg", F.col("es") < 0)
    beyond = values.select("k", "es", F.sum("c").over(
        W.partitionBy("k", "neg").orderBy(F.abs("es").desc()).rowsBetween(W.unboundedPreceding, 0)).alias("beyond"))
    up = F.col("es") >= 0
    unit = lambda c: F.when(F.coalesce(c, F.lit(1.0)) == 0, F.lit(None)).otherwise(F.coalesce(c, F.lit(1.0)))
    p_table = scores.join(beyond, ["k", "es"]).join(by_size, "k").withColumn(
        "p", (F.col("beyond") + 1) / (F.when(up, F.col("n_up")).otherwise(F.col("n_down")) + 1)) \
        .withColumn("nes", F.round(F.coalesce(F.col("es") / F.when(up, unit(F.col("up"))).otherwise(unit(F.col("down"))),
                                              F.lit(0.0)), 4))
    used = scores.groupBy("k").agg(F.count(F.lit(1)).alias("sets"))
    pool = null.join(by_size, "k").join(used, "k").select(
        F.coalesce(F.col("es") / F.when(up, unit(F.col("up"))).otherwise(unit(F.col("down"))), F.lit(0.0)).alias("v"),
        F.col("sets").alias("null_n"), F.lit(0).cast("long").alias("obs_n"))
    seen = p_table.groupBy(F.col("nes").alias("v")).agg(F.lit(0).cast("long").alias("null_n"), F.count(F.lit(1)).alias("obs_n"))
    fdr = _signed_rank_share(pool.union(seen))
    out = p_table.join(fdr, "nes", "left").select("set_id", F.col("k").alias("set_size"), "es", "nes", "p", "fdr", "peak")
    return benjamini_hochberg(cut(out), "p", "padj").join(gset, "set_id")


def read_order(ranking: DataFrame, keep: str = "first") -> DataFrame:
    """One row per gene of a ranking with repeats (gene, score, input_pos): its first or its last mention."""
    pick = (F.min if keep == "first" else F.max)(F.struct("input_pos", "score"))
    return ranking.groupBy("gene").agg(pick.alias("m"), F.min("input_pos").alias("at")).select(
        "gene", "m.score", F.col("at").alias("input_pos"))
