"""Release build: landed source files of one organism to release tables.

Downloading is not part of the engine; the build reads files that were landed in a shared folder.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, matching, network, ontology, unify
from ..operators.graph import ancestors, nearest_holder
from ..operators.identifiers import alias_table, lookup_table
from ..schema import RESTRICTED_SOURCES, SRC_PAIR
from ..session import cut
from ..sources import delimited as D
from ..sources import drawings, layouts, markup, organisms, release
from ..sources import pathways as S


@dataclass
class Landed:
    """Paths of the landed files of one organism; anything missing is left out of the build."""

    gene_info: str | None = None
    kegg_genes: str | None = None
    hgnc: str | None = None
    uniprot_idmapping: str | None = None
    uniprot_rest: str | None = None
    kegg: str | None = None
    reactome: str | None = None
    wikipathways_gmt: str | None = None
    wikipathways_gpml: str | None = None
    biocyc_columns: str | None = None
    biocyc_archive: tuple[str, str | None] | None = None
    obo: str | None = None
    gaf: str | None = None
    msigdb: dict[str, str] = field(default_factory=dict)
    string: tuple[str, str] | None = None
    feeds: tuple[tuple[str, str, str], ...] = ()
    curation: str | None = None
    reactome_text: str | None = None
    kegg_maps: str | None = None
    reactome_layouts: str | None = None
    gene_info_split: str | None = None


def alias_layers(spark: SparkSession, org: Row, f: Landed) -> tuple[DataFrame, DataFrame]:
    """(lookup, symbol -> gene_id): base gene list, HGNC for human, UniProt accessions."""
    if f.gene_info_split:
        rows, ids = D.gene_info(spark, f.gene_info_split, org.taxid, split=True)
    elif f.gene_info:
        rows, ids = D.gene_info(spark, f.gene_info, org.taxid if org.shared else None)
    else:
        rows, ids = D.kegg_gene_list(spark, f.kegg_genes)
    if org.hgnc and f.hgnc:
        more, hgnc_ids = D.hgnc(spark, f.hgnc)
        rows = rows.union(more)
        ids = hgnc_ids.union(ids.join(hgnc_ids, "symbol", "left_anti"))
    if f.uniprot_idmapping:
        rows = rows.union(D.uniprot_idmapping(spark, f.uniprot_idmapping, ids))
    if f.uniprot_rest:
        rows = rows.union(D.uniprot_rest(spark, f.uniprot_rest, ids, lookup_table(rows)))
    return cut(lookup_table(rows)), ids


def extract(spark: SparkSession, org: Row, f: Landed, lookup: DataFrame, public: bool, topology: bool) -> unify.Pathways:
    """All pathway sources that have landed; restricted ones only in a full build."""
    allowed = lambda s: not (public and s in RESTRICTED_SOURCES)
    parts = []
    if f.kegg and allowed("KEGG"):
        parts.append(S.kegg(spark, f.kegg, lookup, topology=topology))
    if f.reactome and org.reactome:
        parts.append(S.reactome(spark, f.reactome, org.reactome, lookup, topology=topology, complexes=org.key == "sapiens"))
    if f.wikipathways_gmt:
        parts.append(S.wikipathways(spark, f.wikipathways_gmt, lookup, f.wikipathways_gpml if topology else None))
    if f.biocyc_columns and allowed("BioCyc"):
        parts.append(S.biocyc(spark, f.biocyc_columns, lookup))
    elif f.biocyc_archive and allowed("BioCyc"):
        parts.append(S.archived(spark, *f.biocyc_archive, "BioCyc", lookup))
    return S.union_pathways(parts)


def _feed_rows(spark: SparkSession, org: Row, label: str, kind: str, path: str) -> DataFrame:
    if kind == "biogrid":
        return D.biogrid(spark, path, org.taxid, org.name, feed=label)
    if kind == "mitab_split":  # a folder of split_by_taxon
        return D.mitab(D.of_taxa(spark, path, "taxid", org.taxid), org.taxid, feed=label)
    if kind == "mitab":
        text = D.zip_lines(spark, path) if path.endswith(".zip") else D.lines(spark, path)
        return D.mitab(text, org.taxid, feed=label)
    return D.pair_table(spark, path, label)


def build(spark: SparkSession, org: Row, f: Landed, *, mode: str = "guarded", public: bool = False,
          topology: bool = True, string_min_score: int = 700) -> dict[str, DataFrame]:
    """Release tables (names as in schema.RELEASE) of one organism; ``stats`` has sets, matches, collections and networks."""
    lookup, gene_ids = alias_layers(spark, org, f)
    src = extract(spark, org, f, lookup, public, topology)
    # every later stage reads these tables, so the files are parsed and resolved once
    src = unify.Pathways(*[None if x is None else cut(x) for x in (src.pathway, src.gene, src.pair, src.parent)])
    curation = D.curation(spark, f.curation) if f.curation else None
    merged = unify.merge_pathways(src, mode=mode, organism=org.key, curation=curation)
    set_gene, set_member = cut(merged.set_gene), cut(merged.set_member)
    gset, links = cut(merged.gset), merged.set_link
    path_set, path_member, path_gene = gset, set_member, set_gene
    described = [S.describe_reactome(spark, f.reactome_text)] if f.reactome_text else []
    if f.wikipathways_gpml:
        described.append(S.describe_wikipathways(markup.shred(markup.gpml_files(spark, f.wikipathways_gpml), markup.GPML)))
    if f.kegg_maps:
        described.append(S.describe_kegg(spark, f.kegg_maps, set_member))
    if described:
        set_member = S.with_descriptions(set_member, functools.reduce(DataFrame.unionByName, described))
    set_pair = merged.set_pair if merged.set_pair is not None else spark.createDataFrame([], release.RELEASE["set_pair"])
    set_pair = cut(set_pair)
    pathway_pair = set_pair

    if f.obo and f.gaf:
        term, edge, alt = D.obo(spark, f.obo)
        term = cut(term)
        closure = ancestors(edge)
        ann = D.annotations(D.gaf(spark, f.gaf), term, alt, lookup)
        full = cut(ontology.propagate(ann, closure))
        go_set, go_member, go_gene = ontology.term_sets(full, term, ontology.merge_identical(full, term, closure))
        go_gene, go_set = cut(go_gene), cut(go_set)
        go_member = S.with_descriptions(go_member, term.where("definition <> ''").select(
            F.lit("GO").alias("source"), F.col("term").alias("source_set_id"), F.col("definition").alias("description")))
        crossed = ontology.both_ways(cut(ontology.link_sets(go_set, go_gene, gset, set_gene)))
        links = crossed if links is None else links.unionByName(crossed)
        gset, set_member, set_gene = gset.unionByName(go_set), set_member.unionByName(go_member), set_gene.unionByName(go_gene)

    tables: dict[str, DataFrame] = {}
    tiers = {stem: (role, tier) for stem, role, tier in S.MSIGDB_HUMAN + S.MSIGDB_MOUSE}
    base_member, base_gene = set_member, set_gene
    for stem, path in f.msigdb.items():
        role, tier = tiers[stem]
        if public and tier != "open":
            continue
        got = S.msigdb_sets(D.msigdb(spark, path), lookup, role, base_member, base_gene)
        if role == "link":
            tables["msigdb_equivalent"] = got[0] if "msigdb_equivalent" not in tables else tables["msigdb_equivalent"].unionByName(got[0])
        else:
            got = [cut(x) for x in got]
            gset, set_member, set_gene = gset.unionByName(got[0]), set_member.unionByName(got[1]), set_gene.unionByName(got[2])

    genes = set_gene.select("gene")
    reports: dict[str, DataFrame] = {}
    for name, rows in _networks(spark, org, f, string_min_score).items():
        mapped = cut(network.map_feed(rows, lookup))
        edges = cut(network.integrate(mapped))
        fed = network.feed_report(mapped)
        counts = [F.struct(F.lit(c).alias("metric"), F.col("feed").alias("key"), F.col(c).alias("n")) for c in ("rows", "mapped_rows", "unmapped_ids")]
        reports[name] = network.summary(edges).union(fed.select(F.inline(F.array(*counts))))
        sets = network.overlay(edges, pathway_pair).groupBy("gene_a", "gene_b").agg(
            F.array_sort(F.collect_set("set_id")).alias("pathway_sets"))
        tables[name] = edges.join(sets, ["gene_a", "gene_b"], "left")
        genes = genes.union(network.neighbours(edges).select("gene"))
    genes = cut(genes.distinct())
    reviewed = matching.review_summary(merged.matches)
    stats = catalogue.set_stats(path_set, path_member, path_gene, pathway_pair).select("metric", F.lit("").alias("key"), "value") \
        .union(reviewed.select(F.inline(F.array(*[F.struct(F.lit("matches").alias("metric"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                                  for c in reviewed.columns])))) \
        .union(gset.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).select(F.lit("sets_by_collection"), "collection", F.col("n").cast("double"))) \
        .union(catalogue.source_stats(src.pathway, src.gene, src.pair if src.pair is not None else spark.createDataFrame([], SRC_PAIR)).select(
            F.lit("pathways_by_source"), "source", F.col("pathways").cast("double")))
    for name, report in reports.items():
        stats = stats.union(report.select(F.concat(F.lit(f"{name}."), "metric"), "key", F.col("n").cast("double")))
    tables.update({
        "meta": spark.createDataFrame([("organism_key", org.key), ("organism", org.name), ("taxid", org.taxid),
                                       ("tier", "open" if public else "full"), ("merge_method", mode)], ["key", "value"]),
        "gene": genes.select(F.col("gene").alias("symbol")).join(gene_ids, "symbol", "left"),
        "alias": alias_table(lookup, genes), "gset": gset, "set_member": set_member, "set_gene": set_gene,
        "set_pair": set_pair, "match_log": merged.matches, "stats": stats, "name_gram": catalogue.name_grams(gset, set_member)})
    if links is not None:
        tables["set_link"] = links
    if topology:
        tables.update(drawn(spark, f, lookup, set_member))
    return tables


def _networks(spark: SparkSession, org: Row, f: Landed, min_score: int) -> dict[str, DataFrame]:
    """Feed rows of the physical network and, apart from it, of STRING."""
    out: dict[str, DataFrame] = {}
    for label, kind, path in f.feeds:
        rows = _feed_rows(spark, org, label, kind, path)
        out["ppi"] = rows if "ppi" not in out else out["ppi"].unionByName(rows)
    if f.string:
        out["string_ppi"] = D.string_links(spark, *f.string, min_score=min_score)
    return out


def drawn(spark: SparkSession, f: Landed, lookup: DataFrame, member: DataFrame) -> dict[str, DataFrame]:
    """Drawings of the release's member pathways: ``diagram``, and ``diagram_of`` for those of Reactome, which are shown in
    their own layout or in that of the nearest ancestor that has one. Layouts that draw no member are not read further."""
    ids = lambda source: member.where(F.col("source") == source).select("source_set_id").distinct()
    made: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    for source, path, read, form, draw in (("KEGG", f.kegg and f"{f.kegg}/kgml", markup.xml_files, markup.KGML, drawings.kgml_drawing),
                                           ("WikiPathways", f.wikipathways_gpml, markup.gpml_files, markup.GPML, drawings.gpml_drawing)):
        if path:
            docs = read(spark, path).join(ids(source).withColumnRenamed("source_set_id", "doc"), "doc", "left_semi")
            made.append(drawings.drawing_table(draw(markup.shred(docs, form), lookup), source))
    if f.reactome and f.reactome_layouts:
        docs = cut(layouts.layout_files(spark, f.reactome_layouts))
        edges = D.fields(D.lines(spark, f"{f.reactome}/ReactomePathwaysRelation.txt"), "parent", "child")
        near = cut(nearest_holder(edges, docs.select(F.col("doc").alias("node")), ids("Reactome").withColumnRenamed("source_set_id", "node")))
        used = docs.join(near.select(F.col("holder").alias("doc")), "doc", "left_semi")
        made.append(drawings.drawing_table(layouts.layout_drawing(used, lookup), "Reactome"))
        tables["diagram_of"] = near.select(F.lit("Reactome").alias("source"), F.col("node").alias("source_set_id"), F.col("holder").alias("diagram_id"))
    for rows in made:
        tables["diagram"] = rows if "diagram" not in tables else tables["diagram"].unionByName(rows)
    return tables


def rebuild_archive(spark: SparkSession, sources: list[tuple[str, str, str | None]], organism: str = "sapiens") -> unify.Integrated:
    """The 2012 merge on archived normalised files: (code, gene file, pair file or None) in comparison order."""
    return unify.merge_pathways(S.union_pathways([S.archived(spark, gen, gpr, code) for code, gen, gpr in sources]),
                                mode="legacy", organism=organism)


def build_many(spark: SparkSession, plans: dict[str, Landed], folder: str, species: DataFrame | None = None, **options) -> dict[str, str]:
    """Build and write several organisms, given by any of their names in ``species`` (default: the curated ones); one that
    is unknown or fails is reported and does not stop the others.

    Each build is a set of cluster-wide jobs and writes its own partition of the release tables.
    """
    wanted = spark.createDataFrame([(name,) for name in plans], "wanted string")
    known = {r.wanted: r for r in organisms.found(organisms.curated(spark) if species is None else species, wanted).collect()}
    status = {name: "failed: unknown organism" for name in plans if name not in known}
    for name, org in known.items():
        landed = plans[name]
        try:
            tables = build(spark, org, landed, **options)
            tables["stats"] = cut(tables["stats"])
            release.write(tables, folder, org.key)
            head = tables["stats"].where("key = ''")
            status[org.key] = "ok " + json.dumps({r["metric"]: r["value"] for r in head.collect()})
        except Exception as exc:  # an organism without usable data must not stop the run
            status[org.key] = f"failed: {type(exc).__name__}: {exc}"[:300]
    return status
