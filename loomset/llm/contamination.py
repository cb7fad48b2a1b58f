"""Benchmark decontamination: prefix-filtered containment join of item windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, fresh, only, words

WINDOW = 10
SHINGLE = 3
# Windows are joined in blocks of about so many bytes of words; a block is broadcast.
BLOCK_BYTES = 4 << 20


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, n, win): every run of ``window`` words of an item; an item of fewer words is one window."""
    base = only(items, item_id="string", text="string")
    held = base.select(F.coalesce("item_id", F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return held.select("item", F.least(F.size("w"), F.lit(window)).alias("n"), "w",
                       F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window, F.lit(0)) + 1)).alias("i")).select(
        "item", "n", F.slice("w", F.col("i"), F.col("n")).alias("win")).distinct()


def _shingle(array: str, at, q: int):
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(q)])


def _positions(docs: DataFrame, q: int) -> DataFrame:
    """Every word position of every text with the hash of its q-word shingle; position -1 stands for the text itself."""
    base = only(docs, doc_id="bigint", text="string")
    held = base.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"), words(F.col("text")).alias("w"))
    each = held.select("doc_id", "h", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("p"))
    return each.withColumn("x", F.when(F.col("p") >= 0, _shingle("w", F.col("p"), q)))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, h (SHA-256 of the text), n_words, ``hits`` (start, n), ``items`` (ids as text, sorted).

    A window is a set of positioned three-word shingles (of fewer words, if it has fewer). It occurs only where all of
    them do, so the prefix that containment makes necessary is one shingle: the rarest over all texts. A window with a
    shingle that occurs nowhere is done with. Texts meet the rarest shingles; position (the start must not lie
    before the text) and length (the end must not lie behind it) bound the candidates, and each is verified word by
    word. Rarity is counted over every text.

    Texts are never shuffled or grouped: the join sides are blocks of windows of a set number of bytes, so a larger
    benchmark means more passes, not a larger broadcast. Equal (doc_id, text) rows share one result row, which is
    repeated for them. A null text has no words; a null item text has no windows; a null item_id counts as the
    empty id; items of one id are one item; other columns are ignored; an empty table on either side gives no hits.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(item_windows(items, window))
    size = found.agg(F.sum(F.length(F.array_join("win", " ")) + 40)).first()[0] or 0
    blocks = -(-size // block_bytes)
    parts = []
    for q in sorted(r[0] for r in found.select(F.least("n", F.lit(SHINGLE))).distinct().collect()):  # at most 3 rows
        sized = found.where(F.least("n", F.lit(SHINGLE)) == q)
        for b in range(blocks):
            mine = sized.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
            shingles = mine.select("win", F.explode(F.sequence(F.lit(0), F.col("n") - q)).alias("offset")).distinct()
            shingles = scratch.cut(shingles.withColumn("x", _shingle("win", F.col("offset"), q)))
            wanted = shingles.select("x").distinct()
            counts = _positions(docs, q).select("x").join(F.broadcast(wanted), "x").groupBy("x").count()
            rare = shingles.join(counts, "x", "left").groupBy("win").agg(
                F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "x", "offset")).alias("rare"))
            anchors = scratch.cut(mine.join(rare.where("rare.count > 0"), "win").select("rare.x", "rare.offset", "n", "win", "item"))
            met = _positions(docs, q).join(F.broadcast(anchors), "x", "left").withColumn("start", F.expr("p - offset"))
            sure = met.where("p = -1 OR (start >= 0 AND start + n <= size(w) AND slice(w, start + 1, n) = win)")
            first = not parts
            rows = sure if first else sure.where("p >= 0")
            parts.append(rows.select("doc_id", "h", "start", "n", "item", F.size("w").alias("n_words"),
                                     F.expr("cast(p = -1 AS bigint)").alias("copies")))
    if not parts:
        none = F.lit(None)
        parts = [_positions(docs, 1).where("p = -1").select("doc_id", "h", none.cast("int").alias("start"), none.cast("int").alias("n"),
                                                            none.cast("string").alias("item"), F.size("w").alias("n_words"),
                                                            F.lit(1).cast("bigint").alias("copies"))]
    met = parts[0]
    for more in parts[1:]:
        met = met.unionByName(more)
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "n"))
    whole = met.groupBy("doc_id", "h").agg(F.max("n_words").cast("bigint").alias("n_words"), F.sum("copies").alias("copies"),
                                           F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    return whole.select("doc_id", "h", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any window), n_items, items_sha256, contaminated."""
    def cover(acc, x):
        end = (x["start"] + x["n"]).cast("bigint")
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), end - F.greatest(acc["end"], x["start"].cast("bigint")))).alias("n"))

    zero = F.lit(0).cast("bigint")
    n_hit = F.aggregate("hits", F.struct(zero.alias("end"), zero.alias("n")), cover)["n"]
    return find_windows(docs, items, window, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def without_benchmarks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input rows without any benchmark window, with all their columns.

    Rows are matched by id and text, so null and repeated ids are judged by their own text.
    """
    id_, h = fresh(docs, "_bad_id"), fresh(docs, "_bad_text")
    bad = find_windows(docs, items, window).where(F.size("hits") > 0).select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    text = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad[id_]) & (text == bad[h]), "left_anti")
