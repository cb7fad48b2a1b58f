"""Exact duplicates by deterministic block naming (main path: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BLANKS, Scratch, only

BLOCK = 1024


def normalised(text: Column) -> Column:
    """Null as empty; every run of blanks becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _blocks(text: Column, block: int) -> Column:
    """The text in fixed-size blocks of code points; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _sorted_names(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """Integer names of distinct (x, y): sort them over the cluster and number them in order.

    The numbers are taken from the sorted table once and written, so every later reader sees the same names.
    """
    return scratch.cut(keys.select("x", "y").distinct().sort("x", "y").withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK,
               fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, text_sha256, n_blocks, name): two rows have equal (n_blocks, name) exactly when their normalised
    texts are equal.

    Level 0 names every block by (fingerprint, rank among the different blocks of that fingerprint), so a fingerprint
    that two different blocks share costs a comparison of contents, never a wrong name. These pairs of integers are
    sorted into integer names; then adjacent names are paired and the pairs sorted into names again, until each
    document has one. The block count stands beside the name because documents finish at different levels.

    A block that a third of all documents hold is one row after the map-side part of each grouping; joins that bring
    names back meet one row a key, and adaptive execution splits their large side.
    """
    text = only(docs, doc_id="bigint", text="string").select("doc_id", normalised(F.col("text")).alias("text"))
    held = text.select(F.explode(_blocks(F.col("text"), block)).alias("block")).select(
        fingerprint(F.col("block")).alias("x"), "block")
    # Fingerprints of several blocks: as good as always none.
    shared = scratch.cut(held.distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    listed = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
                         _blocks(F.col("text"), block).alias("blocks"))
    if shared.isEmpty():
        rows = scratch.cut(listed.withColumn("blocks", F.transform("blocks", lambda b: fingerprint(b))))
        level = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "x"),
                            F.lit(0).cast("bigint").alias("y"))
    else:
        again = scratch.cut(held.join(shared, "x", "left_semi").distinct())
        lower = again.alias("a").join(again.alias("b"), F.expr("a.x = b.x AND b.block < a.block"), "left")
        ranks = scratch.cut(lower.groupBy("a.x", "a.block").agg(F.count("b.block").alias("y")))
        rows = scratch.cut(listed)
        level = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        level = level.withColumn("x", fingerprint(F.col("block"))).join(ranks, ["x", "block"], "left").select(
            "row", "n", "pos", "x", F.coalesce("y", F.lit(0).cast("bigint")).alias("y"))
    level = scratch.cut(level)
    finished = None
    while True:
        names = _sorted_names(scratch, level)
        named = level.join(names, ["x", "y"])
        ended = scratch.cut(named.where("n = 1").select("row", "name"))
        finished = ended if finished is None else finished.unionByName(ended)
        nxt = scratch.cut(named.where("n > 1").groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.expr("(max(n) + 1) div 2").cast("int").alias("n"),
            F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("x"),
            F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1).cast("bigint")).alias("y")))
        scratch.drop(level, names)
        level = nxt
        if level.isEmpty():
            break
    return rows.select("row", "doc_id", "text_sha256", F.size("blocks").alias("n_blocks")).join(finished, "row")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of blanks by one space. The row with the smallest doc_id
    of equal texts stays; among repeated rows of one doc_id the first read stays. A null text counts as empty; a null
    doc_id sorts after every number, so such a row stays only if its group has no other (keep_id is then null). Other
    columns of the input are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.cut(identities(docs, scratch, block, fingerprint))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("n_blocks", "name", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"),
                           "group_size")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
