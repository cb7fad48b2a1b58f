"""Best-hit name matching without comparing every name to every other name.

For each name the best hit in another source is the candidate with the highest alignment ratio (earliest
one on ties). It counts only when the ratio exceeds 0.91, or when the shorter name is wholly contained
(as a subsequence) and the ratio is at least 0.5. So these exact candidate sets are enough:

* equal names: an equi-join;
* ratio above 0.91: the lengths of two names bound the characters d that are deleted from either, so of d + 1 segments
  of the shorter one at least one stands whole in the longer one, at a place that d bounds too. Segments are keys of an
  equi-join; they are about five characters long, so their number grows with the names;
* contained names: characters are ordered from rare to common, and a tree of the short names' rarest ones is walked
  down by joins, keeping the long names that hold all characters of the path.

A contained best hit may still be beaten by a better but unacceptable name of the same source, so names whose best
acceptable hit in a source is a contained one are also compared with what that source has above that ratio (prefix
filter on characters within the source). All joins are equi-joins over distinct texts, so copies of one name are
compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..session import cut
from .ordered import next_in_group

_SEP = "\u0001"


def name_units(pathways: DataFrame, clean: bool = True) -> DataFrame:
    """Pathways with the text that is aligned: columns source, src_ord, name, pos, shown, norm, n.

    ``pathways``: source, name, pos (order inside the input). Sources are ordered by first appearance.
    """
    first = pathways.groupBy("source").agg(F.min("pos").alias("src_ord"))
    shown = X.clean_name(F.col("name")) if clean else F.col("name")
    return pathways.join(first, "source").withColumn("shown", shown).select(
        "source", "src_ord", "name", "pos", "shown",
        F.lower(X.strip(F.col("shown"))).alias("norm"), F.length(X.strip(F.col("shown"))).alias("n"))


def character_tokens(texts: DataFrame) -> DataFrame:
    """Each text with its (character, occurrence) tokens sorted from rare to common.

    Shared tokens bound the common subsequence from above. The frequency table is bounded by the alphabet.
    """
    chars = F.array_sort(F.split("norm", ""))
    numbered = F.transform(chars, lambda c, i: F.concat(c, (i + 2 - F.array_position(chars, c)).cast("string")))
    rows = texts.select("norm", "n", F.explode(numbered).alias("tok"))
    rarity = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(rarity, "tok").groupBy("norm", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda t: t["tok"]).alias("tokens"))


def _prefix(n: Column, ratio: Column) -> Column:
    """Tokens to index so that no pair with at least this ratio is lost."""
    return n - F.ceil(ratio * n / (2 - ratio) - 1e-9) + 1


def similar_texts(probe: DataFrame, index: DataFrame, index_ratio: float) -> DataFrame:
    """(a, b, na, nb, score, ratio) for probe texts and index texts of their group with ratio >= the probe's own bound.

    ``probe``: grp, norm, n, tokens, bound; ``index``: grp, norm, n, tokens.
    """
    left = probe.select("grp", F.col("norm").alias("a"), F.col("n").alias("na"), "bound", F.col("tokens").alias("ta"),
                        F.explode(F.slice("tokens", F.lit(1), _prefix(F.col("n"), F.col("bound")))).alias("tok"))
    right = index.select("grp", F.col("norm").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"),
                         F.explode(F.slice("tokens", F.lit(1), _prefix(F.col("n"), F.lit(index_ratio)))).alias("tok"))
    need = F.col("bound") * (F.col("na") + F.col("nb")) / 2 - 1e-9
    rare_first = F.array_intersect(F.slice("ta", F.lit(1), _prefix(F.col("na"), F.col("bound"))),
                                   F.slice("tb", F.lit(1), _prefix(F.col("nb"), F.lit(index_ratio))))[0]
    # within a group a pair is kept only at its rarest shared prefix token
    pairs = left.join(right, ["grp", "tok"]).where(
        (F.col("a") != F.col("b")) & (F.least("na", "nb") >= need) & (rare_first == F.col("tok"))
        & (F.size(F.array_intersect("ta", "tb")) >= need))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.min("bound").alias("bound"))
    scored = pairs.select("a", "b", "na", "nb", "bound", X.lcs(F.col("a"), F.col("b")).alias("score"))
    return scored.withColumn("ratio", 2.0 * F.col("score") / (F.col("na") + F.col("nb"))) \
        .where(F.col("ratio") >= F.col("bound") - 1e-12).drop("bound")


def _deletions(short: Column, long: Column, ratio: float) -> Column:
    """Most characters that two texts of these lengths can lose to reach their common subsequence at this ratio; it has
    the parity of the difference of the lengths, as every pair's number of deletions."""
    most = F.floor((1 - ratio) * (short + long) + 1e-9).cast("int")
    return most - F.pmod(most - (long - short), F.lit(2))


def _segment_key(n: Column, d: Column, i: Column, text: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(n, d, i, F.substring(text, start + 1, size))


def close_candidates(texts: DataFrame, ratio: float) -> DataFrame:
    """(a, b, na, nb, ta, tb): the shorter text a and a longer (or, of equal length, later) one b, for a superset of all pairs with at
    least this ratio. ``texts``: norm, n (its length), tokens.

    A segment is probed only as far from its own place as the deletions before and after it allow: of the whole
    segments one has at most as many deletions before it as segments, and so at most the rest behind it.
    """
    i, d, m = F.col("i"), F.col("d"), F.col("m")
    start, end = F.floor(i * m / (d + 1)).cast("int"), F.floor((i + 1) * m / (d + 1)).cast("int")
    longest = F.floor(F.col("n") * (2 - ratio) / ratio + 1e-9).cast("int")
    kinds = F.array_distinct(F.transform(F.sequence(F.col("n"), longest), lambda x: _deletions(F.col("n"), x, ratio)))
    index = texts.select(F.col("norm").alias("a"), F.col("n").alias("m"), F.explode(F.filter(kinds, lambda x: x >= 0)).alias("d"), F.col("tokens").alias("ta"))
    index = index.withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    index = index.select("a", F.col("m").alias("na"), "ta", _segment_key(m, d, i, F.col("a"), start, end - start).alias("key"))
    shortest = F.ceil(F.col("n") * ratio / (2 - ratio) - 1e-9).cast("int")
    probe = texts.select(F.col("norm").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.explode(F.sequence(shortest, F.col("n"))).alias("m"))
    gap = F.col("nb") - m
    probe = probe.withColumn("d", _deletions(m, F.col("nb"), ratio)).where(d >= gap).withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    low = F.greatest(F.lit(0), start - i, start + gap - (d - i))
    high = F.least(F.col("nb") - (end - start), start + i, start + gap + (d - i))
    places = F.when(high >= low, F.sequence(low, high))
    probe = probe.withColumn("p", F.explode(places)).select(
        "b", "nb", "tb", _segment_key(m, d, i, F.col("b"), F.col("p"), end - start).alias("key"))
    total = F.col("na") + F.col("nb")
    fits = ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))) \
        & (F.size(F.array_intersect("ta", "tb")) >= ratio * total / 2 - 1e-9)
    return index.join(probe, "key").where(fits).dropDuplicates(["a", "b", "na", "nb"]).drop("key")


def close_texts(texts: DataFrame, ratio: float) -> DataFrame:
    """(a, b, na, nb, score, ratio) both ways, for all pairs of different texts with at least this ratio."""
    scored = close_candidates(texts, ratio).select("a", "b", "na", "nb", X.lcs(F.col("a"), F.col("b")).alias("score"))
    found = scored.withColumn("ratio", 2.0 * F.col("score") / (F.col("na") + F.col("nb"))).where(F.col("ratio") >= ratio - 1e-12)
    return cut(found).transform(_both_ways)


def _both_ways(pairs: DataFrame) -> DataFrame:
    cols = ["a", "b", "na", "nb", "score", "ratio"]
    return pairs.select(cols).union(pairs.select(F.col("b"), F.col("a"), F.col("nb"), F.col("na"), "score", "ratio"))


# Levels of the tree of rarest characters; each costs a join and divides what is left.
LEVELS = 4


def contained_candidates(tokens: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(a, b, na, nb): b holds all characters of a, as often as a, and 0.5 <= ratio <= 0.91.

    A node of the tree is a sequence of rarest characters; a name with fewer ends in blanks that every name holds. Nodes
    know the lengths of the names below them, so a long name leaves a branch whose names are too short or too long.
    """
    path = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.coalesce(F.get("tokens", i), F.lit("")))
    short = tokens.select(F.col("norm").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), path.alias("path"))

    def node(k: int) -> Column:
        return F.xxhash64(F.slice("path", 1, k))

    low, high = X.RATIO_FLOOR, X.RATIO_ACCEPT
    fits = (F.col("longest") * (2 - low) >= F.col("nb") * low) & (F.col("shortest") * (2 - high) <= F.col("nb") * high + 1e-9)
    held = F.array_contains("tb", F.col("tok")) | (F.col("tok") == "")
    alive = None
    for k in range(1, levels + 1):
        edges = short.groupBy(node(k - 1).alias("up"), F.col("path")[k - 1].alias("tok"), node(k).alias("node")).agg(
            F.min("na").alias("shortest"), F.max("na").alias("longest"))
        if alive is None:
            first = tokens.select(F.col("norm").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.explode("tokens").alias("tok"))
            alive = first.join(edges, "tok").where(fits)
        else:
            alive = alive.join(edges, F.col("at") == F.col("up")).where(held & fits)
        alive = alive.select("b", "nb", "tb", F.col("node").alias("at"))
    ratio = 2.0 * F.col("na") / (F.col("na") + F.col("nb"))
    return alive.join(short.withColumn("node", node(levels)), F.col("at") == F.col("node")).where(
        (F.col("na") < F.col("nb")) & (ratio >= low) & (ratio <= high) & (F.size(F.array_except("ta", "tb")) == 0)).select("a", "b", "na", "nb")


def contained_texts(tokens: DataFrame) -> DataFrame:
    """(a, b, na, nb, score, ratio): a is a subsequence of b, 0.5 <= ratio <= 0.91."""
    # the place in b behind which the next character of a is looked for; -1 once one is missing
    place = F.aggregate(F.split("a", ""), F.lit(0), lambda at, c: F.when(at < 0, at).otherwise(
        F.coalesce(F.nullif(F.call_function("locate", c, F.col("b"), at + 1), F.lit(0)), F.lit(-1))))
    return contained_candidates(tokens).where(place > 0).select(
        "a", "b", "na", "nb", F.col("na").alias("score"), (2.0 * F.col("na") / (F.col("na") + F.col("nb"))).alias("ratio"))


def related_texts(units: DataFrame) -> DataFrame:
    """All directed text pairs a best-hit decision can depend on (see the module text)."""
    cols = ["a", "b", "na", "nb", "score", "ratio"]
    tokens = cut(character_tokens(units.select("norm", "n").where("n > 0").distinct()))
    even = tokens.where(F.length("norm") == F.col("n"))
    close = close_texts(even, X.RATIO_ACCEPT)
    odd = tokens.where(F.length("norm") != F.col("n")).withColumn("bound", F.lit(X.RATIO_ACCEPT)).withColumn("grp", F.lit(""))
    if not odd.isEmpty():  # lower case has another length: segments do not fit, so these few go by their characters
        found = similar_texts(odd, tokens.withColumn("grp", F.lit("")), X.RATIO_ACCEPT)
        close = close.union(_both_ways(found)).distinct()
    inside = _both_ways(cut(contained_texts(tokens)))

    # the best contained hit of a text in each source, where no closer hit decides already
    at = units.select("source", "src_ord", "norm").where("norm <> ''").distinct()
    there = at.select(F.col("source").alias("grp"), F.col("src_ord").alias("ord_b"), F.col("norm").alias("b"))
    here = at.groupBy(F.col("norm").alias("a")).agg(F.min("src_ord").alias("ord_a"), F.collect_set("source").alias("own"))
    # hits among the later names of the own source depend on positions: there every hit may be the one
    own = F.array_contains("own", F.col("grp"))
    inside_at = inside.join(there, "b").join(here, "a").where((F.col("ord_a") < F.col("ord_b")) | own)
    bound = inside_at.groupBy("a", "grp").agg(F.min(F.when(own, F.col("ratio"))).alias("least"), F.max("ratio").alias("best"))
    equal = at.select(F.col("norm").alias("a"), F.col("source").alias("grp"))
    decided = close.where(F.col("ratio") > X.RATIO_ACCEPT).join(there, "b").select("a", "grp").union(equal).distinct().withColumn("sure", F.lit(True))
    open_ = bound.join(decided, ["a", "grp"], "left").where("sure IS NULL OR least IS NOT NULL").select(
        F.col("a").alias("norm"), "grp", F.coalesce("least", "best").alias("bound"))
    probe = open_.join(tokens, "norm")
    index = at.select(F.col("source").alias("grp"), "norm").join(tokens, "norm")
    rivals = similar_texts(probe, index, X.RATIO_FLOOR).select(cols)
    return cut(close.select(cols).union(inside).union(rivals).distinct())


def best_hits(units: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Accepted best hits before curation: source_a, name_a, shown_a, source_b, name_b, shown_b, score, ratio.

    ``units`` should be materialised (it is read many times). Every earlier source is searched in every later one, and each name among the later names of its own
    source (``within``: the sources where that is wanted; default all). The result names the last input
    name that shows the same text.
    """
    last = units.groupBy("source", "shown").agg(F.max_by("name", "pos").alias("raw"))
    # one row per (source, text): copies of a name in one source do not multiply the comparisons
    text = units.groupBy("source", "src_ord", "norm", "n").agg(
        F.min(F.struct("pos", "shown")).alias("first"), F.max(F.struct("pos", "shown")).alias("last"))
    shown = units.select("source", "src_ord", "shown", "norm", "n").distinct()
    pairs = related_texts(units)

    right = text.select(F.col("source").alias("source_b"), F.col("src_ord").alias("ord_b"), F.col("norm").alias("b"),
                        F.col("n").alias("nb"), F.col("first.pos").alias("pos_b"), F.col("first.shown").alias("shown_b"))
    left = shown.select(F.col("source").alias("source_a"), F.col("src_ord").alias("ord_a"), F.col("norm").alias("a"),
                        F.col("n").alias("na"), F.col("shown").alias("shown_a"))
    cols = ["source_a", "shown_a", "source_b", "shown_b", "pos_b", "score", "ratio"]
    equal = left.where("na > 0").join(right.withColumnRenamed("b", "a"), "a").where("ord_a < ord_b").select(
        "source_a", "shown_a", "source_b", "shown_b", "pos_b", F.col("na").alias("score"),
        (2.0 * F.col("na") / (F.col("na") + F.col("nb"))).alias("ratio"))
    fuzzy = left.join(pairs.drop("na", "nb"), "a").join(right.drop("nb"), "b").where("ord_a < ord_b").select(cols)
    top = F.max_by(F.struct("shown_b", "score", "ratio"), F.struct("ratio", -F.col("pos_b")))
    between = equal.union(fuzzy).groupBy("source_a", "shown_a", "source_b").agg(top.alias("m")) \
        .select("source_a", "shown_a", "source_b", "m.shown_b", "m.score", "m.ratio")

    inner, inner_text = units, text
    if within is not None:
        inner = units.join(within.select("source"), "source", "left_semi")
        inner_text = text.join(within.select("source"), "source", "left_semi")
    copies = next_in_group(inner.where("n > 0").select("source", "norm", "n", "pos", "shown"), ["source", "norm"], "pos", ["shown"]) \
        .where("next_pos IS NOT NULL AND shown <> next_shown").select(
        F.col("source").alias("source_a"), F.col("shown").alias("shown_a"), F.col("source").alias("source_b"),
        F.col("next_shown").alias("shown_b"), F.col("n").alias("score"), F.lit(1.0).alias("ratio")).distinct()
    tail = inner_text.select("source", F.col("norm").alias("a"), F.col("last.pos").alias("pos_a"),
                             F.col("last.shown").alias("shown_a"))
    cand = inner_text.select("source", F.col("norm").alias("b"), "first", "last")
    later = tail.join(pairs.drop("na", "nb"), "a").join(cand, ["source", "b"]).where("last.pos > pos_a")
    # a text seen on both sides of the name needs its first position after it
    spread = later.where("first.pos < pos_a").select("source", "shown_a", "pos_a", "b", "score", "ratio")
    after = spread.join(inner.select("source", F.col("norm").alias("b"), "pos", "shown"), ["source", "b"]) \
        .where("pos > pos_a").groupBy("source", "shown_a", "b", "score", "ratio").agg(
        F.min(F.struct("pos", "shown")).alias("hit"))
    ahead = later.where("first.pos > pos_a").select("source", "shown_a", "b", "score", "ratio", F.col("first").alias("hit"))
    own_top = F.max_by(F.struct("hit.shown", "score", "ratio"), F.struct("ratio", -F.col("hit.pos")))
    own = ahead.unionByName(after).groupBy("source", "shown_a").agg(own_top.alias("m")).select(
        F.col("source").alias("source_a"), "shown_a", F.col("source").alias("source_b"),
        F.col("m.shown").alias("shown_b"), "m.score", "m.ratio")

    hits = between.union(copies).union(own).where(
        X.is_related(F.col("shown_a"), F.col("shown_b"), F.col("score"), F.col("ratio")))
    raw_a = last.select(F.col("source").alias("source_a"), F.col("shown").alias("shown_a"), F.col("raw").alias("name_a"))
    raw_b = last.select(F.col("source").alias("source_b"), F.col("shown").alias("shown_b"), F.col("raw").alias("name_b"))
    return hits.join(raw_a, ["source_a", "shown_a"]).join(raw_b, ["source_b", "shown_b"]).select(
        "source_a", "name_a", "shown_a", "source_b", "name_b", "shown_b", "score", "ratio")


def curated(matches: DataFrame, rules: list[tuple[str, str]], entity_guard: bool) -> DataFrame:
    """Drop matches that a look-alike rule or the entity guard separates."""
    keep = ~X.is_mismatch(F.col("shown_a"), F.col("shown_b"), rules)
    if entity_guard:
        keep = keep & ~X.entity_mismatch(F.col("shown_a"), F.col("shown_b"))
    return matches.where(keep)


# Genes of a block; a pathway's genes of one block are one row of an overlap.
BLOCK = 4096


def gene_blocks(gene: DataFrame, width: int = BLOCK) -> DataFrame:
    """(source, name, block, genes, n): the distinct genes of each pathway as numbers, cut by gene into blocks of about
    ``width`` genes, so no row grows with a pathway. A missing gene is counted (block -1) and has no number."""
    known = gene.where("gene IS NOT NULL").select("gene").distinct()
    blocks = -(-known.count() // width) or 1
    number = F.row_number().over(W.partitionBy("block").orderBy("gene"))
    numbered = known.withColumn("block", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")).withColumn("number", number)
    held = gene.select("source", "name", "gene").join(numbered, "gene", "left")
    rows = held.groupBy("source", "name", F.coalesce("block", F.lit(-1)).alias("block")).agg(F.array_sort(F.collect_set("number")).alias("genes"))
    return rows.withColumn("n", F.when(F.col("block") < 0, 1).otherwise(F.size("genes")))


def match_overlap(matches: DataFrame, src_gene: DataFrame) -> DataFrame:
    """Adds ``overlap``: Jaccard index of the two pathways' genes. A match has one row a block of genes, in which the
    numbers of both pathways are intersected; its genes are never rows."""
    gene = cut(gene_blocks(src_gene))
    size = gene.groupBy("source", "name").agg(F.sum("n").alias("n"))
    side = lambda df, s, *c: df.select(F.col("source").alias(f"source_{s}"), F.col("name").alias(f"name_{s}"), *c)
    key = ["source_a", "name_a", "source_b", "name_b"]
    pairs = matches.select(*key).distinct()
    real = gene.where("block >= 0")
    shared = pairs.join(side(real, "a", "block", F.col("genes").alias("genes_a")), ["source_a", "name_a"]) \
        .join(side(real, "b", "block", F.col("genes").alias("genes_b")), ["source_b", "name_b", "block"]) \
        .groupBy(*key).agg(F.sum(F.size(F.array_intersect("genes_a", "genes_b"))).alias("shared"))
    na, nb, k = (F.coalesce(F.col(c), F.lit(0)) for c in ("na", "nb", "shared"))
    return matches.join(shared, key, "left") \
        .join(side(size, "a", F.col("n").alias("na")), ["source_a", "name_a"], "left") \
        .join(side(size, "b", F.col("n").alias("nb")), ["source_b", "name_b"], "left") \
        .withColumn("overlap", F.when(na + nb - k > 0, k / (na + nb - k)).otherwise(F.lit(0.0))) \
        .select(*matches.columns, "overlap")


def _pair_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(F.lower(a), F.lower(b))), _SEP)


def _curation_keys(curation: DataFrame) -> DataFrame:
    """One row per unordered pair of names: of rows that name it twice, in either order, the last one counts.

    The order is the column ``pos`` where the table has one, else the order in which it is read.
    """
    at = F.col("pos") if "pos" in curation.columns else F.monotonically_increasing_id()
    keyed = _curation_rows(curation.withColumn("_at", at))
    return keyed.groupBy("pair").agg(F.max_by(F.struct("low_a", "low_b", "d", "r"), "_at").alias("m")).select("pair", "m.*")


def _curation_rows(curation: DataFrame) -> DataFrame:
    return curation.select("_at", _pair_key(X.strip(F.col("name_a")), X.strip(F.col("name_b"))).alias("pair"),
                           F.lower(X.strip(F.col("name_a"))).alias("low_a"), F.lower(X.strip(F.col("name_b"))).alias("low_b"),
                           F.col("decision").alias("d"), F.coalesce("reason", F.lit("")).alias("r"))


def review(matches: DataFrame, curation: DataFrame) -> DataFrame:
    """Decision and reason per match: equal names and reviewed merges are accepted, reviewed separations
    rejected, everything else is pending and never merged."""
    same = F.lower("shown_a") == F.lower("shown_b")
    known = _curation_keys(curation).select("pair", "d", "r")
    return matches.withColumn("pair", _pair_key(F.col("shown_a"), F.col("shown_b"))).join(known, "pair", "left") \
        .withColumn("decision", F.when(same | (F.col("d") == "merge"), "accept")
                    .when(F.col("d").isNull(), "pending").otherwise("reject")) \
        .withColumn("reason", F.when(same, "identical names").when(F.col("d").isNull(), "not yet reviewed")
                    .otherwise(F.concat(F.lit("reviewed: "), "r"))).drop("pair", "d", "r")


def reviewed_synonyms(units: DataFrame, matches: DataFrame, curation: DataFrame) -> DataFrame:
    """Accepted matches for reviewed merges that the alignment did not propose."""
    low = units.select("source", "name", "shown", F.lower("shown").alias("low"))
    side = lambda s: low.select(F.col("source").alias(f"source_{s}"), F.col("name").alias(f"name_{s}"),
                                F.col("shown").alias(f"shown_{s}"), F.col("low").alias(f"low_{s}"))
    ends = F.array_sort(F.array(F.concat_ws(_SEP, "source_a", "name_a"), F.concat_ws(_SEP, "source_b", "name_b")))
    found = _curation_keys(curation).where("d = 'merge' AND low_a <> low_b").join(side("a"), "low_a") \
        .join(side("b"), "low_b").withColumn("ends", ends)
    columns = [c for c in found.columns if c != "ends"]
    one = F.min_by(F.struct(*columns), F.struct("source_a", "name_a", "source_b", "name_b")).alias("m")
    found = found.groupBy("ends").agg(one).select("ends", "m.*")
    seen = matches.select(ends.alias("ends")).distinct()
    return found.join(seen, "ends", "left_anti").select(
        "source_a", "name_a", "shown_a", "source_b", "name_b", "shown_b", F.lit(0).alias("score"),
        F.lit(0.0).alias("ratio"), F.lit("accept").alias("decision"),
        F.concat(F.lit("name review: "), "r").alias("reason"))


def review_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("decision") == "accept").alias("accepted"),
        F.count_if(F.col("decision") == "reject").alias("rejected"),
        F.count_if(F.col("decision") == "pending").alias("pending_review"),
        F.count_if(F.col("reason") == "identical names").alias("accepted_identical_names"),
        F.count_if(F.col("reason").startswith("name review")).alias("accepted_by_name_review_only"))
