"""Graph operators: connected components, transitive closure, nearest ancestors and set distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _fingerprint(df: DataFrame, *cols: str) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Alternates the large-star and small-star rewrites until the edges form one star per component. Each
    rewrite is a partial-aggregated minimum per node plus a join, so a node holding a third of the edges is
    combined map-side and its join side is split by adaptive execution. Rounds are cut with checkpoints.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    star = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(star, "u", "v")
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = star.union(star.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _fingerprint(star, "u", "v")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(star.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def ancestors(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 40) -> DataFrame:
    """Transitive closure of (child, parent) edges as (*keys, child, ancestor, depth), self excluded.

    Depths are the shortest ones. After a round all pairs up to some depth L are known. A longer pair up to 2 L has an
    ancestor at depth exactly L on its way, so only pairs of depth L are joined to the closure, and only pairs that
    are new are added; known ones are never shuffled again as results. Rounds grow with the logarithm of the depth, and
    end, in cycles too, when no pair of depth L is left.
    """
    k = list(keys)
    closure = cut(edges.where("child <> parent").select(*k, "child", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)))
    for i in range(max_rounds):
        left = closure.where(F.col("depth") == (1 << i)).select(*k, "child", F.col("ancestor").alias("mid"))
        if left.isEmpty():  # a longer pair would have an ancestor at this depth
            return closure
        right = closure.select(*k, F.col("child").alias("mid"), "ancestor", (F.col("depth") + (1 << i)).alias("depth"))
        longer = left.join(right, [*k, "mid"]).where("child <> ancestor").groupBy(*k, "child", "ancestor").agg(F.min("depth").alias("depth"))
        closure = closure.unionByName(cut(longer.join(closure, [*k, "child", "ancestor"], "left_anti")))
    raise RuntimeError("closure did not settle")


def with_self(closure: DataFrame, nodes: DataFrame, node: str = "child") -> DataFrame:
    """Closure plus every node as its own ancestor at depth 0."""
    own = nodes.select(F.col(node).alias("child")).distinct()
    return closure.select("child", "ancestor", "depth").union(
        own.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth")))


def nearest_ancestor(closure_with_self: DataFrame, holders: DataFrame, holder: str = "node") -> DataFrame:
    """(child, ancestor): the closest ancestor-or-self that is one of ``holders`` (ties: smallest id)."""
    return closure_with_self.join(holders.select(F.col(holder).alias("ancestor")).distinct(), "ancestor", "left_semi") \
        .groupBy("child").agg(F.min(F.struct("depth", "ancestor")).alias("m")) \
        .select("child", F.col("m.ancestor").alias("ancestor"), F.col("m.depth").alias("depth"))


def nearest_holder(edges: DataFrame, holders: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, holder, depth): for each wanted node the closest of itself and its ancestors that is a holder (ties:
    smallest id). ``edges``: child, parent; ``holders``: node; ``wanted``: node.

    Holders hand themselves down edge by edge: the parents decided last decide their undecided children, and edges above a
    decided child are dropped, so a node has one row however many ancestors it has, and circles end.
    """
    held = cut(holders.select("node").distinct())
    fresh = found = held.select("node", F.col("node").alias("holder"), F.lit(0).alias("depth"))
    waiting = cut(edges.where("child <> parent").select("child", "parent").join(held.toDF("child"), "child", "left_anti"))
    depth = 0
    while True:
        depth += 1
        fresh = cut(waiting.join(fresh.select(F.col("node").alias("parent"), "holder"), "parent").groupBy(F.col("child").alias("node"))
                    .agg(F.min("holder").alias("holder")).withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return found.join(wanted.select("node"), "node", "left_semi")
        found = found.union(fresh)
        waiting = cut(waiting.join(fresh.select(F.col("node").alias("child")), "child", "left_anti"))


def reached(start: DataFrame, edges: DataFrame, keys: tuple[str, ...] = (), max_depth: int = 30) -> DataFrame:
    """(*keys, root, node, depth): what each root reaches along (*keys, node, to) edges in at most ``max_depth`` steps,
    itself at depth 0. ``start``: *keys, root. Only nodes new to a root are followed."""
    k = list(keys)
    step = cut(edges.select(*k, "node", "to").distinct())
    front = cut(start.select(*k, "root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, max_depth + 1):
        front = cut(front.join(step, [*k, "node"]).select(*k, "root", F.col("to").alias("node")).distinct()
                    .join(seen, [*k, "root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def set_distances(query: DataFrame, edges: DataFrame, set_gene: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(set_id, distance): fewest undirected steps from a query gene to a gene of the set; -1 if none can be reached.

    One breadth-first front for all query genes together, until it is empty; the pairwise distance matrix is never formed.
    With ``max_depth`` the search stops there and sets not reached by then get NULL: their distance is not known.
    """
    ends = F.array(F.struct(F.col("gene_a").alias("gene"), F.col("gene_b").alias("to")), F.struct(F.col("gene_b").alias("gene"), F.col("gene_a").alias("to")))
    both = cut(edges.where("gene_a <> gene_b").select(F.inline(ends)).distinct())
    seen = cut(query.select("gene").distinct().withColumn("distance", F.lit(0)))
    front = seen
    depth, open_end = 0, True
    while max_depth is None or depth < max_depth:
        depth += 1
        front = cut(front.join(both, "gene").select(F.col("to").alias("gene")).distinct()
                    .join(seen, "gene", "left_anti").withColumn("distance", F.lit(depth)))
        if front.isEmpty():
            open_end = False
            break
        seen = seen.union(front)
    return set_gene.join(seen, "gene", "left").groupBy("set_id").agg(
        F.coalesce(F.min("distance"), F.lit(None if open_end else -1).cast("int")).alias("distance"))


def least_reachable(edges: DataFrame, hi: str = "hi", lo: str = "lo", max_rounds: int = 60) -> DataFrame:
    """(node, leader): the smallest node reachable along edges that always lead to a smaller node.

    This is what "join the first earlier group with a related member" comes to when items are taken in
    order: a node's leader is the least leader among its earlier relatives. Labels also jump to the label
    of their label, so long chains settle in few rounds.
    """
    step = edges.select(F.col(hi).alias("node"), F.col(lo).alias("to")).distinct()
    label = cut(step.groupBy("node").agg(F.min("to").alias("leader")))
    before = _fingerprint(label, "node", "leader")
    for _ in range(max_rounds):
        via = label.withColumnRenamed("node", "to").withColumnRenamed("leader", "next")
        through = step.join(via, "to").select("node", F.col("next").alias("leader"))
        jump = label.join(via.withColumnRenamed("to", "leader"), "leader").select("node", F.col("next").alias("leader"))
        label = cut(label.union(through).union(jump).groupBy("node").agg(F.min("leader").alias("leader")))
        after = _fingerprint(label, "node", "leader")
        if after == before:
            return label
        before = after
    raise RuntimeError("leaders did not settle")
