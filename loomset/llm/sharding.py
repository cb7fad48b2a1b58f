"""Shards by a consistent-hash ring with virtual nodes and bounded loads (main path: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, fresh, only

SHARDS = 8
CELLS = 1 << 14
# Virtual nodes of each shard: the same for every number of shards, or a further shard would move the others' nodes.
REPLICAS = 128
MOST_SHARDS = 64


def _point(name: Column) -> Column:
    """Where a name falls on the ring: one of ``CELLS`` cells, from the first 14 bits of its MD5."""
    return F.shiftright(F.conv(F.substring(name, 1, 4), 16, 10).cast("int"), 2)


def ring(spark: SparkSession, shards: int = SHARDS, replicas: int = REPLICAS, seed: str = "ring") -> DataFrame:
    """(cell, walk): for each of the ``CELLS`` cells the shards in the order a clockwise walk from there meets them.

    Every shard stands on the ring at ``replicas`` virtual nodes, placed by MD5. The table has ``CELLS`` rows of
    ``shards`` numbers, whatever the data, so it may be broadcast.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards; for more, shard each shard again")
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.floor(F.col("id") / replicas).cast("string"), F.lit(":"),
                          (F.col("id") % replicas).cast("string")))
    nodes = spark.range(shards * replicas).select(F.struct(_point(name).alias("cell"), name.alias("name"),
                                                           F.floor(F.col("id") / replicas).cast("int").alias("shard")).alias("node"))
    circle = nodes.agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    arcs = circle.select("nodes", F.posexplode("nodes").alias("i", "node")).select(
        F.when(F.col("i") == 0, -1).otherwise(F.element_at("nodes", F.col("i"))["cell"]).alias("after"),
        F.col("node.cell").alias("last"), _walk("nodes", F.col("i")).alias("walk"))
    beyond = circle.select(F.element_at("nodes", -1)["cell"].alias("after"), F.lit(CELLS - 1).alias("last"),
                           _walk("nodes", F.lit(0)).alias("walk"))
    return arcs.unionByName(beyond).where("after < last").select(
        F.explode(F.sequence(F.col("after") + 1, F.col("last"))).alias("cell"), "walk")


def _walk(nodes: str, i: Column) -> Column:
    n = F.size(nodes)
    turned = F.concat(F.slice(nodes, i + 1, n), F.slice(nodes, F.lit(1), i))
    return F.array_distinct(F.transform(turned, lambda x: x["shard"]))


def _shard(walk: str, cuts: list[int | None], at: str) -> Column:
    """The first shard of the walk that still takes the key: it has no cut, or the key comes no later than its cut."""
    last = F.array(*[F.lit(c if c is not None else (1 << 63) - 1).cast("bigint") for c in cuts])
    return F.filter(walk, lambda s: F.col(at) <= F.get(last, s))[0]


def _overfull(keys: DataFrame, names: dict[str, str], cuts: list[int | None], caps: list[int]) -> dict[int, int]:
    """For every shard that was given more than its cap: the place of the key that fills it.

    Sums a (partition, shard) find the partition of that key; only those partitions' keys of that shard are then added
    up one by one, each within its own partition. At most one row a shard comes to the driver from either step.
    """
    at, weight = names["at"], names["weight"]
    part = F.shiftright(F.col(at), 33)
    given = keys.select(part.alias("part"), _shard(names["walk"], cuts, at).alias("shard"), F.col(weight).alias("weight"), F.col(at).alias("at"))
    cap = F.get(F.array(*[F.lit(c).cast("bigint") for c in caps]), F.col("shard"))
    sums = given.groupBy("shard", "part").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("shard").orderBy("part")
    sums = sums.withColumn("to", F.sum("w").over(order)).withColumn("all", F.sum("w").over(Window.partitionBy("shard")))
    hit = sums.where((F.col("all") > cap) & (F.col("to") >= cap) & (F.col("to") - F.col("w") < cap)).select(
        "shard", "part", (cap - (F.col("to") - F.col("w"))).alias("left")).collect()
    if not hit:
        return {}
    inside = F.lit(False)
    left = F.lit(None).cast("bigint")
    for r in hit:
        here = (F.col("shard") == r.shard) & (F.col("part") == r.part)
        inside, left = inside | here, F.when(here, F.lit(r.left)).otherwise(left)
    run = given.where(inside).withColumn("run", F.sum("weight").over(Window.partitionBy("shard", "part").orderBy("at")))
    return {r.shard: r["at"] for r in run.where(F.col("run") >= left).groupBy("shard").agg(F.min("at").alias("at")).collect()}


def _caps(total: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def ring_shards(rows: DataFrame, key: str = "doc_id", weight: Column | None = None, shards: int = SHARDS, slack: float = 0.0,
                replicas: int = REPLICAS) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``rows`` and ``shard``, ``slot`` (gapless from 0 in each shard) and ``home`` (the owner of the
    key's place on the ring, before loads count), under free names given beside.

    A key stands on the ring at the MD5 of ``key``. Keys arrive in the order of further bits of that hash; one goes to
    the first shard clockwise that is not full. A shard is full once its load reaches its cap: the total weight over
    the number of shards, (1 + ``slack``) times. Without slack the caps add up to the total, so with weight 1 (the
    default) counts are at most one apart; with other weights a load passes its cap by less than one row's weight.
    More slack moves fewer keys when a shard is added.

    Whoever fills a shard is its cut: who arrives later walks on. All cuts of a round are found together (keys that a
    shard turns away are offered to their next one in the next round), which gives the same shards as one key after the
    other, because all shards prefer the key that arrived first. A round is two sums over narrow columns; where a key
    goes follows from the cuts alone, so no row moves for it. Rounds are few (about 6), whatever the size.

    Rows of one key stand at one place on the ring and arrive together, in the order read; a key with a third of all
    rows spreads over as many shards as it fills. A null key counts as the empty one. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    names = {n: fresh(rows, n) for n in ("shard", "slot", "home", "at", "weight", "walk", "cell", "hash", "row", "part", "before")}
    hashed = F.md5(F.concat(F.lit("key:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(*kept, (F.lit(1) if weight is None else weight).cast("bigint").alias(names["weight"]), hashed.alias(names["hash"]),
                         F.monotonically_increasing_id().alias(names["row"]))
    walks = scratch.cut(ring(rows.sparkSession, shards, replicas).select(F.col("cell").alias(names["cell"]), F.col("walk").alias(names["walk"])))
    placed = placed.withColumn(names["cell"], _point(F.col(names["hash"]))).join(F.broadcast(walks), names["cell"])
    keys = scratch.cut(placed.sort(F.substring(names["hash"], 5, 28), names["row"]).select(
        *kept, names["weight"], names["walk"], F.monotonically_increasing_id().alias(names["at"])))
    total = keys.agg(F.sum(names["weight"])).first()[0] or 0
    caps, cuts = _caps(total, shards, slack), [None] * shards
    while True:
        found = _overfull(keys, names, cuts, caps)
        found = {s: at for s, at in found.items() if cuts[s] is None or at < cuts[s]}
        if not found:  # a shard that its last key brought above its cap has its cut already
            break
        for shard, at in found.items():
            cuts[shard] = at
    out = keys.select(*kept, names["at"], F.shiftright(names["at"], 33).alias(names["part"]), _shard(names["walk"], cuts, names["at"]).alias(names["shard"]),
                      F.col(names["walk"])[0].alias(names["home"]))
    here = [names["part"], names["shard"]]
    counts = out.groupBy(*here).agg(F.count(F.lit(1)).alias("n"))
    before = scratch.cut(counts.select(*here, (F.sum("n").over(Window.partitionBy(names["shard"]).orderBy(names["part"])) - F.col("n"))
                                       .alias(names["before"])))
    slot = F.row_number().over(Window.partitionBy(*here).orderBy(names["at"])) - 1 + F.col(names["before"])
    return out.join(before, here).select(*kept, F.col(names["shard"]), slot.cast("bigint").alias(names["slot"]), F.col(names["home"])), names


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null has none."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("bigint")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, by_bytes: bool = False, slack: float = 0.0) -> DataFrame:
    """Write every row with all its columns into ``folder``/shard=N, in slot order within a file, and return the
    manifest: shard, rows, bytes, crc32 of the slot-ordered digests. Loads are rows, or bytes of text.

    Files are written per (shard, range of slots), so a shard of any size is written by many tasks.
    """
    weight = text_size(F.col("text").cast("string")) if by_bytes else None
    placed, names = ring_shards(docs, weight=weight, shards=shards, slack=slack)
    if {names["shard"], names["slot"]} != {"shard", "slot"}:
        raise ValueError("the input has a column shard or slot")
    placed.drop(names["home"]).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    size = text_size(F.col("text").cast("string"))
    return docs.sparkSession.read.parquet(folder).groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"),
        F.sum(F.crc32(F.concat_ws(":", F.col("slot").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("checksum"))


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), home.

    Counts of two shards differ by at most one. A null text has size 1 and the crc32 of the empty text; columns besides
    doc_id and text are ignored; repeated rows each get a slot of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, doc_id="bigint", text="string").select("doc_id", text_size(F.col("text")).alias("size"),
                                                             F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, names = ring_shards(rows, shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(names["shard"]).alias("shard"),
                         F.col(names["slot"]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(names["home"]).alias("home"))
