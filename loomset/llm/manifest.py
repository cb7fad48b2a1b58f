"""Merkle manifest of a dataset: nodes labelled by the interval of leaf ranks they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, only

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of a tree that are built or searched together: 64 nodes of the lowest one meet in a row.
BAND = 6


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(*[part(v) for v in values])


def _shifted(way: str, value: Column, by: Column | int) -> Column:
    return F.call_function(f"shift{way}", value, by if isinstance(by, Column) else F.lit(by))


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree: how often n leaves are halved, rounding up, until one node is left."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def in_trees(leaves: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0 within ``tree``) and ``size`` (leaves of the tree) to rows with a ``tree`` that is not null.

    One sort over the cluster, then counts of each (partition, tree): a tree that holds most of the rows is spread over
    as many tasks as any other.
    """
    rows = scratch.cut(leaves.sort("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    counts = scratch.cut(counts.select("part", "tree", "first", F.sum("n").over(whole).alias("size"),
                                       (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before")))
    return rows.join(counts, ["part", "tree"]).withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop(
        "part", "at", "first", "before")


def _pairs(nodes: str) -> Column:
    """Digests one level up: of every two consecutive nodes, or of the last one alone."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda i: digest(
        F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))


def _placed(nodes: str, level: int, under: int) -> Column:
    """The nodes that a bucket has at a level (null: none there), with their positions in the whole level."""
    return F.transform(F.coalesce(nodes, F.array().cast("array<string>")), lambda x, i: F.struct(
        F.lit(level).alias("level"), (F.shiftleft("bucket", under) + i).alias("pos"), x.alias("digest")))


def build(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of all trees: tree, size, level, lo, hi, digest; a node covers the leaf ranks lo <= rank < hi.

    ``leaves`` has tree, size, rank, digest. Trees grow by bands of ``BAND`` levels: a row gathers the at most 64 nodes
    under one node of the band's top, so each band is one shuffle and 64 times smaller than the one below.
    """
    level, top = 0, leaves.agg(F.max(_height(F.col("size")))).first()[0] or 0
    below = leaves.select("tree", "size", F.lit(0).alias("level"), F.col("rank").alias("pos"), "digest")
    bands = [below]
    while level < top:
        steps = _height(F.col("size")) - level
        rows = below.where((F.col("level") == level) & (steps > 0)).groupBy("tree", "size", F.shiftright("pos", BAND).alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("nodes"))
        rows = rows.withColumn("l0", F.col("nodes.digest"))
        for s in range(1, BAND + 1):
            rows = rows.withColumn(f"l{s}", F.when(steps >= s, _pairs(f"l{s - 1}")))
        made = F.concat(*[_placed(f"l{s}", level + s, BAND - s) for s in range(1, BAND + 1)])
        below = scratch.cut(rows.select("tree", "size", F.inline(made)))
        bands.append(below)
        level += BAND
    nodes = bands[0]
    for band in bands[1:]:
        nodes = nodes.unionByName(band)
    lo = _shifted("left", F.col("pos"), F.col("level"))
    return nodes.select("tree", "size", "level", lo.alias("lo"), F.least(
        _shifted("left", F.col("pos") + 1, F.col("level")), F.col("size")).alias("hi"), "digest")


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, digest) of the node of each tree that covers all its leaves."""
    return nodes.where(F.col("level") == _height(F.col("size"))).select("tree", "digest")


STEP = "array<struct<level:int,left:boolean,digest:string>>"


def _band_path(level: int) -> tuple[Column, Column]:
    """Of the node [lo, hi) at ``level``: one step a level up to the band's top. The bucket's nodes lie under one node; those
    whose parent covers ``lo`` while they do not are what the parent's interval leaves beside the ancestor of that level.
    No such node: the ancestor is alone in its parent, and the step has a null digest."""
    beside = F.filter("nodes", lambda x: (x["from"] <= F.col("lo")) & (F.col("lo") < x["to"]) & ~((x["lo"] <= F.col("lo")) & (F.col("lo") < x["hi"])))
    last = F.least(_height(F.col("size")), F.lit(level + BAND)) - 1
    levels = F.when(last >= level, F.sequence(F.lit(level), last)).otherwise(F.array().cast("array<int>"))

    def step(at: Column) -> Column:
        found = F.get(F.filter("beside", lambda x: x["level"] == at), F.lit(0))
        return F.struct(at.alias("level"), (found["lo"] < F.col("lo")).alias("left"), found["digest"].alias("digest"))

    return beside, F.transform(levels, step)


def with_paths(leaves: DataFrame, nodes: DataFrame, above: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaves`` (tree, rank, size and any other columns) with ``path``, the steps from each leaf to the root and on
    through what ``above`` (tree, path, and columns to hand down) says of its tree.

    From the top band down, nodes are joined to the bucket of nodes that lies under their ancestor at the band's top and
    to the path of that ancestor; a bucket is one row of at most 126 nodes, found by (tree, interval of ranks). Upper
    bands have a 64th of the rows of the band below, so as good as all work is one join of the leaves.
    """
    down = [c for c in above.columns if c not in ("tree", "path")]
    nodes = scratch.cut(nodes.where(F.col("level") < F.greatest(_height(F.col("size")), F.lit(1))))
    sizes = scratch.cut(nodes.where("lo = 0 AND level = 0").select("tree", "size"))
    top = sizes.agg(F.max(_height(F.col("size")))).first()[0] or 0
    above = scratch.cut(above.join(sizes, "tree"))
    paths = None
    for level in range(max(top - 1, 0) // BAND * BAND, -1, -BAND):
        parent = F.col("level") + 1
        start = _shifted("left", _shifted("right", F.col("lo"), parent), parent)
        node = F.struct("level", "lo", "hi", start.alias("from"), (start + _shifted("left", F.lit(1).cast("bigint"), parent)).alias("to"), "digest")
        buckets = nodes.where((F.col("level") >= level) & (F.col("level") < level + BAND)).groupBy(
            "tree", F.shiftright("lo", level + BAND).alias("bucket")).agg(F.collect_list(node).alias("nodes"))
        over = above.where(_height(F.col("size")) <= level + BAND).select("tree", F.lit(0).cast("bigint").alias("bucket"), F.col("path").alias("up"), *down)
        if paths is not None:
            over = over.unionByName(paths)
        buckets = buckets.join(over, ["tree", "bucket"])
        if level:
            targets = nodes.where((F.col("level") == level) & (_height(F.col("size")) > level)).select("tree", "size", "lo", "hi")
        else:
            targets = leaves.withColumn("lo", F.col("rank"))
        beside, path = _band_path(level)
        joined = targets.withColumn("bucket", F.shiftright("lo", level + BAND)).join(buckets, ["tree", "bucket"]).withColumn(
            "beside", beside).drop("nodes").withColumn("path", F.concat(path, "up"))
        if not level:
            return joined.drop("beside", "up", "bucket", "lo")
        paths = scratch.cut(joined.select("tree", F.shiftright("lo", level).alias("bucket"), F.col("path").alias("up"), *down))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path give."""
    return F.aggregate(path, leaf, lambda acc, x: digest(
        F.when(x["left"], x["digest"]).otherwise(""), acc, F.when(~x["left"], x["digest"]).otherwise("")))


def siblings(path: Column) -> Column:
    """Digests of the siblings, level by level."""
    return F.transform(F.filter(path, lambda x: x["digest"].isNotNull()), lambda x: x["digest"])


def forest(leaves: DataFrame, scratch: Scratch, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree for each value of ``tree`` and one over their roots: the leaves (with rank and size), the nodes of the
    trees, and (tree, subroot, root, path), where path leads from a subroot to the root. ``leaves`` has ``digest``."""
    leaves = scratch.cut(in_trees(leaves, scratch, order))
    nodes = build(leaves, scratch)
    tops = scratch.cut(roots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    tops = scratch.cut(in_trees(tops, scratch, ["name"]))
    upper = build(tops, scratch)
    root = roots(upper).select("tree", F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    tops = with_paths(tops, upper, root, scratch)
    return leaves, nodes, scratch.cut(tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))


def write_manifest(docs: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS) -> None:
    """The manifest as tables in ``folder``: leaves (doc_id, tree, rank, digest), nodes (tree, size, level, lo, hi,
    digest; leaves too) and tops (tree, subroot, root, path). A tree is a lang; its name is '' for null, else '+' and the lang."""
    scratch = Scratch(docs.sparkSession)
    leaves, nodes, tops = forest(_leaves(docs, fields), scratch, ["doc_id", "digest"])
    leaves.select("doc_id", "tree", "rank", "size", "digest").write.parquet(f"{folder}/leaves")
    nodes.write.parquet(f"{folder}/nodes")
    tops.write.parquet(f"{folder}/tops")


def _tree(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), lang), F.lit(""))


def _leaves(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _tree(F.col("lang").cast("string")).alias("tree"),
                       leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest"))


def verified_rows(docs: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, root, folded_root, verified) of each row of ``docs`` whose doc_id the manifest knows in its lang: whether
    the row still is what was written, told from its own values and the siblings in the manifest, not from the other rows.
    Rows of a repeated doc_id are held against each of its leaves."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    read = spark.read.parquet
    claimed = _leaves(docs, fields).withColumnRenamed("digest", "claim")
    known = read(f"{folder}/leaves").drop("digest").join(claimed, ["doc_id", "tree"])
    found = with_paths(known, read(f"{folder}/nodes"), read(f"{folder}/tops").select("tree", "path", "root"), scratch)
    found = found.withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    return found.select("doc_id", "root", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf takes doc_id, source, lang, n_chars and text; leaves of one lang ascend by doc_id (null first, equal ones
    by digest, so that repeated rows and ties have a defined place). The claim that is folded adds 1 to n_chars where 7
    divides the crc32 of the doc_id; a null n_chars stays, and so does every row without doc_id. Other columns are
    ignored, an empty table gives no rows, and the length of a text costs no more than its hashing.
    """
    scratch = Scratch(docs.sparkSession)
    rows = only(docs, doc_id="bigint", source="string", lang="string", n_chars="bigint", text="string")
    off = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    claim = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = rows.select("doc_id", _tree(F.col("lang")).alias("tree"), leaf_digest(*[F.col(c) for c in FIELDS]).alias("digest"),
                       F.when(off, leaf_digest(*claim)).alias("claim"))
    leaves, nodes, tops = forest(rows, scratch, ["doc_id", "digest"])
    found = with_paths(leaves, nodes, tops, scratch)
    found = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(F.array_join(siblings(F.col("path")), "")).alias("proof_sha256"),
                         folded(F.coalesce("claim", "digest"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
