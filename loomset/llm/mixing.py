"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, fresh, only

TEMPERATURE = 0.5
SEED = 17


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
                 epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): how often each text of a source should stand in the mix on average.

    The size of a source is its characters plus one a row. The mix has ``epochs`` times the size of the input; a source's
    share of it is its weight over the sum of weights of the sources present. Weights default to
    size ** temperature; a source that ``weights`` does not name has weight 0. Null is a source of its own. Rates are
    rounded to nine places, so that every engine draws from the same distribution.
    """
    size = F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("bigint")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(size.alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size")).first()
    all_weight, all_size = float(total["all_weight"] or 0), float(total["all_size"] or 0)
    rate = F.lit(epochs * all_size) * F.col("weight") / (F.lit(all_weight if all_weight > 0 else 1.0) * F.col("size"))
    return weighed.select("source", "size", F.round(rate, 9).alias("rate"))


def _cdf(rate):
    """Poisson distribution function at 0, 1, ... until it is 1 to the last bit of a draw."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.struct((-rate).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))

    def step(acc, k):
        total = acc["sum"] + F.exp(acc["log_p"])
        return F.struct((acc["log_p"] + F.log(rate) - F.log(k + 1)).alias("log_p"), total.alias("sum"),
                        F.array_append(acc["out"], total).alias("out"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(
        F.aggregate(F.sequence(F.lit(0), last), zero, step)["out"])


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
               epochs: float = 1.0, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """All columns of the input once per copy, plus copy number, rate and shuffle key (under free names, given beside).

    Each text draws its count by inverting the Poisson distribution of its source's rate at a uniform number made from
    a hash of (seed, doc_id); so a rerun, a lost executor or another partitioning gives the same mix. Rows of one doc_id
    draw alike, null counts as the empty id. A text may have no copy: that is the sampling this operator is for.

    Only the table of sources (one row each) is joined to the texts; Spark broadcasts it if its size allows, otherwise
    adaptive execution splits a source that holds much of the rows. Map-side sums make the sizes.
    """
    scratch = Scratch(docs.sparkSession)
    names = {n: fresh(docs, n) for n in ("copy", "rate", "shuffle_key", "mix_source", "mix_cdf", "mix_n")}
    rates = source_rates(docs, weights, temperature, epochs)
    rates = scratch.cut(rates.select(F.col("source").alias(names["mix_source"]), F.col("rate").alias(names["rate"]),
                                     _cdf(F.col("rate")).alias(names["mix_cdf"])))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    joined = docs.join(rates, docs["source"].cast("string").eqNullSafe(rates[names["mix_source"]]))
    counted = joined.withColumn(names["mix_n"], F.size(F.filter(names["mix_cdf"], lambda c: draw >= c)))
    each = counted.where(F.col(names["mix_n"]) > 0).select(
        *[docs[c] for c in docs.columns], names["rate"], F.explode(F.sequence(F.lit(1), F.col(names["mix_n"]))).alias(names["copy"]))
    order = F.md5(F.concat(F.lit(f"order:{seed}:"), key, F.lit(":"), F.col(names["copy"]).cast("string")))
    return each.withColumn(names["shuffle_key"], order), names


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix in shuffled order, with the input's columns: a global sort by the hash of each copy."""
    rows, names = replicated(docs, **options)
    return rows.sort(names["shuffle_key"]).select(*[f"`{c}`" for c in docs.columns])


def mix_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, copy, rate and shuffle_key of every row of the mix, in its order."""
    rows, names = replicated(only(docs, doc_id="bigint", text="string", source="string"), **options)
    return rows.select("doc_id", "source", names["copy"], names["rate"], names["shuffle_key"]).sort("shuffle_key")
