"""Lossless unification of related pathways into integrated sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import stable_id
from ..functions.rules import rules_for
from ..schema import HIERARCHICAL_SOURCES
from ..session import cut
from .graph import ancestors, connected_components
from .vocabulary import united
from .matching import best_hits, curated, match_overlap, name_units, review, reviewed_synonyms

_SEP = "\u0001"


@dataclass
class Pathways:
    """Extracted pathways of all sources: source, name, source_id, pos / genes / pairs / parent links."""

    pathway: DataFrame
    gene: DataFrame
    pair: DataFrame | None = None
    parent: DataFrame | None = None


@dataclass
class Integrated:
    """Integrated sets and their provenance."""

    gset: DataFrame
    set_member: DataFrame
    set_gene: DataFrame
    set_pair: DataFrame | None
    set_link: DataFrame | None
    matches: DataFrame


def same_key_union(p: Pathways) -> Pathways:
    """A name that occurs twice in one source is one pathway; the first row's id and place are kept."""
    one = p.pathway.groupBy("source", "name").agg(F.min(F.struct("pos", "source_id")).alias("m")) \
        .select("source", "name", "m.source_id", "m.pos")
    return Pathways(one, p.gene, p.pair, p.parent)


def set_ids(members: DataFrame, prefix: str, group: str = "group") -> DataFrame:
    """(group, set_id) from each group's (source, member_id) rows: a hash of the sorted member list, one formula at every
    size. The members of a group are the source pathways united in it, not their genes."""
    item = F.struct(F.col("source"), F.col("member_id").alias("name"))
    return members.groupBy(group).agg(stable_id(prefix, F.collect_list(item)).alias("set_id"))


def group_matches(accepted: DataFrame) -> DataFrame:
    """(source, name, group): connected components of accepted matches."""
    node = lambda s: F.concat_ws(_SEP, f"source_{s}", f"name_{s}")
    comp = connected_components(accepted.select(node("a").alias("a"), node("b").alias("b")))
    return comp.select(F.split("node", _SEP)[0].alias("source"), F.split("node", _SEP)[1].alias("name"),
                       F.col("component").alias("group"))


def split_hierarchy(members: DataFrame, parent: DataFrame) -> DataFrame:
    """Adds ``detached``: members whose ancestor of the same source sits in the same group."""
    closure = ancestors(parent.select("source", F.col("child_id").alias("child"), F.col("parent_id").alias("parent")),
                        ("source",)).select("source", F.col("child").alias("source_id"), F.col("ancestor").alias("up"))
    ids = members.where("source_id <> ''").select("group", "source", "source_id")
    inside = ids.join(closure, ["source", "source_id"]) \
        .join(ids.select("group", "source", F.col("source_id").alias("up")), ["group", "source", "up"], "left_semi") \
        .select("group", "source", "source_id").distinct().withColumn("_d", F.lit(True))
    return members.join(inside, ["group", "source", "source_id"], "left") \
        .withColumn("detached", F.coalesce("_d", F.lit(False))).drop("_d")


def merge_pathways(p: Pathways, *, mode: str = "guarded", organism: str | None = None, min_jaccard: float = 0.1,
                   curation: DataFrame | None = None, extra_mismatches: tuple = (),
                   no_within: tuple[str, ...] = HIERARCHICAL_SOURCES) -> Integrated:
    """Match, group and unify pathways.

    ``guarded``: cleaned names, entity and gene-overlap guards, no merging inside hierarchical sources, and
    members are detached from a group that holds their ancestor. ``reviewed``: cleaned names, every match
    decided by the curation table. ``legacy``: raw names and the 2012 rules of ``organism``.
    """
    p = same_key_union(p)
    p.pathway = cut(p.pathway)
    legacy, guarded = mode == "legacy", mode == "guarded"
    rules = rules_for(organism, legacy)
    units = cut(name_units(p.pathway, clean=not legacy))
    within = units.select("source").distinct().where(~F.col("source").isin(*no_within)) if guarded else None
    matches = cut(curated(best_hits(units, within), list(rules.mismatches) + list(extra_mismatches), guarded))
    matches = matches.withColumn("decision", F.lit("accept")).withColumn("reason", F.lit(""))
    if guarded:
        same = F.lower(X.strip(F.col("shown_a"))) == F.lower(X.strip(F.col("shown_b")))
        matches = match_overlap(matches, p.gene).where((F.col("overlap") >= min_jaccard) | same)
    elif mode == "reviewed":
        if curation is None:
            raise ValueError("reviewed merging needs a curation table")
        found = review(matches.drop("decision", "reason"), curation)
        matches = found.unionByName(reviewed_synonyms(units, found, curation))
    if "overlap" not in matches.columns:
        matches = matches.withColumn("overlap", F.lit(None).cast("double"))
    matches = cut(matches)
    accepted = matches.where("decision = 'accept'")

    member = group_matches(accepted).join(p.pathway, ["source", "name"]).join(
        units.select("source", "name", "shown"), ["source", "name"])
    short = F.min_by("shown", F.struct(F.length("shown"), "source", "name"))
    if legacy:
        title = X.integrated_name_legacy(F.col("short"), list(rules.drop), rules.fold_case, rules.replace)
    else:
        title = X.integrated_name(F.col("short"))
    names = member.groupBy("group").agg(short.alias("short")).select("group", title.alias("title"))
    if legacy and organism == "musculus":  # components that end up with one name are one set
        names = names.join(names.groupBy("title").agg(F.min("group").alias("merged")), "title")
        member = member.join(names, "group").drop("group").withColumnRenamed("merged", "group")
    else:
        member = member.join(names, "group")
    member = member.withColumn("group", F.concat(F.lit("g"), F.lit(_SEP), "group")).withColumn("detached", F.lit(False))
    if guarded and p.parent is not None:
        member = split_hierarchy(member.drop("detached"), p.parent)
    own = F.concat(F.lit("s"), F.lit(_SEP), F.concat_ws(_SEP, "source", "name"))
    left = member.where(~F.col("detached")).groupBy("group").agg(F.count(F.lit(1)).alias("kept"))
    member = member.join(left, "group", "left").withColumn(
        "title", F.when(F.col("detached") | (F.coalesce("kept", F.lit(0)) < 2), F.col("shown")).otherwise(F.col("title")))
    member = member.withColumn("group", F.when(F.col("detached"), own).otherwise(F.col("group")))
    rest = p.pathway.join(units.select("source", "name", "shown"), ["source", "name"]) \
        .join(member.select("source", "name"), ["source", "name"], "left_anti") \
        .withColumn("group", own).withColumn("title", F.col("shown"))
    cols = ["source", "name", "source_id", "shown", "group", "title"]
    every = member.select(cols).union(rest.select(cols)).withColumn(
        "member_id", F.when(F.coalesce("source_id", F.lit("")) != "", F.col("source_id")).otherwise(F.col("name")))
    every = cut(every.join(set_ids(every, "IP"), "group"))
    return _unified(every, p, matches, links=not legacy)


def _unified(every: DataFrame, p: Pathways, matches: DataFrame, links: bool) -> Integrated:
    owner = every.select("source", "name", "set_id")
    set_gene = united(owner.join(p.gene, ["source", "name"]), ["set_id", "gene"], {"sources": F.col("source")})
    set_pair = None
    if p.pair is not None:
        set_pair = united(owner.join(p.pair, ["source", "name"]), ["set_id", "gene_a", "gene_b"],
                          {"relations": F.col("relation"), "sources": F.col("source")})
    head = every.groupBy("set_id").agg(F.first("title").alias("name"), F.array_sort(F.collect_set("source")).alias("sources"))
    gset = head.select("set_id", X.strip(F.col("name")).alias("name"), F.lit("pathway").alias("collection"), "sources")
    gset = gset.join(set_gene.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_genes")), "set_id", "left")
    if set_pair is not None:
        gset = gset.join(set_pair.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_pairs")), "set_id", "left")
    else:
        gset = gset.withColumn("n_pairs", F.lit(0).cast("long"))
    gset = gset.fillna(0, ["n_genes", "n_pairs"])
    set_member = every.select("set_id", "source", F.col("member_id").alias("source_set_id"),
                              X.clean_name(F.col("name")).alias("name"), F.lit("").alias("description"))
    set_link = link_hierarchy(set_member, p.parent) if links and p.parent is not None else None
    return Integrated(gset, set_member, set_gene, set_pair, set_link, matches)


def link_hierarchy(set_member: DataFrame, parent: DataFrame) -> DataFrame:
    """Links between sets whose members are parent and child in a source, both ways, no self links."""
    where = set_member.select("source", "source_set_id", "set_id")
    up = parent.join(where.toDF("source", "child_id", "set_a"), ["source", "child_id"]) \
        .join(where.toDF("source", "parent_id", "set_b"), ["source", "parent_id"]) \
        .where("set_a <> set_b").select("set_a", "set_b")
    return up.union(up.select("set_b", "set_a")).distinct()
