"""Gene graphs of sets and their exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import xml_id
from ..schema import UNDIRECTED_RELATIONS
from .enrich import edges_within_sets
from .network import up_to_tier


# Genes of sets for each task that a set's rows are dealt to: what a task sorts does not grow with the input.
GENES_A_TASK = 1 << 18


def _by_set(rows: DataFrame, member: DataFrame) -> DataFrame:
    tasks = max(member.count() // GENES_A_TASK + 1, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "set_id")


def _inside(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``rows`` (set_id, source, target, more) with both ends in ``member`` (set_id, gene), dealt by set.

    Rows and members meet in one shuffle by set; there each gene of a set tells whether it is a member.
    """
    genes = member.where("set_id IS NOT NULL AND gene IS NOT NULL").select("set_id", F.col("gene").alias("source"), F.lit(True).alias("_member"))
    both = _by_set(rows.where("set_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL").withColumn("_member", F.lit(False))
                   .unionByName(genes, allowMissingColumns=True), member)
    held = lambda end: F.max("_member").over(W.partitionBy("set_id", end))
    from_inside = both.withColumn("_in", held("source")).where("_in").withColumn("_end", F.when(F.col("_member"), F.col("source")).otherwise(F.col("target")))
    return from_inside.withColumn("_in", held("_end")).where("_in AND NOT _member").select(*rows.columns)


def set_edges(set_gene: DataFrame, set_pair: DataFrame, edges: DataFrame | None = None,
              tier: str | None = None) -> DataFrame:
    """(set_id, source, target, relations, sources, kind): curated pairs plus, with ``tier``, network edges.

    Both ends must be in the set; a network edge that is already a curated pair (either way) is left out. Both kinds and the
    genes are shuffled once, by set.
    """
    member = set_gene.select("set_id", "gene")
    curated = set_pair.where("gene_a <> gene_b").select(
        "set_id", F.col("gene_a").alias("source"), F.col("gene_b").alias("target"), "relations", "sources", F.lit("curated").alias("kind"))
    if edges is None or tier is None:
        return _inside(curated, member)
    extra = edges_within_sets(up_to_tier(edges, tier), member, ["sources"])
    wired = _inside(curated.union(extra.select("set_id", "gene_a", "gene_b", F.array(F.lit("PPI")), "sources", F.lit("ppi"))), member)
    known = F.max(F.col("kind") == "curated").over(W.partitionBy("set_id", F.least("source", "target"), F.greatest("source", "target")))
    # an edge stands with its ends in order; only such a one can be a curated pair
    ordered = F.col("source") <= F.col("target")
    return wired.withColumn("_known", known).where(~((F.col("kind") == "ppi") & F.col("_known") & ordered)).drop("_known")


def set_graphs(set_gene: DataFrame, set_edge: DataFrame, highlight: DataFrame | None = None,
               max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every set's map: all genes, or with ``max_nodes`` the best-connected ones of each set.

    Genes and ends are shuffled once, by set, where the genes are counted and ranked; the edges shown once more with the genes kept.
    """
    ends = set_edge.select("set_id", F.explode(F.array("source", "target")).alias("gene")).where("set_id IS NOT NULL AND gene IS NOT NULL") \
        .withColumn("_n", F.lit(1).cast("long"))
    both = _by_set(set_gene.withColumn("_n", F.lit(0).cast("long")).withColumn("_own", F.lit(True)).unionByName(ends, allowMissingColumns=True), set_gene)
    nodes = both.withColumn("degree", F.sum("_n").over(W.partitionBy("set_id", "gene"))).where("_own").drop("_n", "_own") \
        .withColumn("rank", F.row_number().over(W.partitionBy("set_id").orderBy(F.desc("degree"), "gene"))) \
        .where(F.lit(True) if max_nodes is None else F.col("rank") <= max_nodes)
    if highlight is not None:
        hit = highlight.select("gene").distinct().withColumn("hit", F.lit(True))
        nodes = nodes.join(hit, "gene", "left").fillna(False, ["hit"])
    else:
        nodes = nodes.withColumn("hit", F.lit(False))
    kept = set_gene if max_nodes is None else nodes
    first = F.coalesce(F.try_element_at("relations", F.lit(1)), F.lit("PPrel"))
    directed = (F.col("kind") == "curated") & ~first.isin(*UNDIRECTED_RELATIONS)
    return nodes.select("set_id", "gene", "sources", "degree", "rank", "hit"), \
        _inside(set_edge, kept.select("set_id", "gene")).withColumn("directed", directed)


def _numbered(edges: DataFrame) -> DataFrame:
    """Edges with ``nth``, from 1 in each set: ids made of it cannot collide, unlike ids made of symbols."""
    order = W.partitionBy("set_id").orderBy("source", "target", "kind", F.array_join("relations", ","))
    return edges.withColumn("nth", F.row_number().over(order))


def to_cytoscape(gset: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, json): one Cytoscape document per map; ``truncated`` if it shows fewer genes than the set has."""
    node = F.struct(F.struct(
        F.col("gene").alias("id"), F.col("gene").alias("label"), "sources", F.size("sources").alias("n_sources"),
        "degree", "hit").alias("data"))
    relation = F.coalesce(F.try_element_at("relations", F.lit(1)), F.lit("PPrel"))
    edge = F.struct(F.struct(F.concat(F.lit("e"), F.col("nth")).alias("id"), "source", "target", relation.alias("relation"), "relations", "sources", "kind",
                             "directed").alias("data"))
    n = nodes.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", node.alias("d")))),
                                                lambda x: F.to_json(x["d"])).alias("n"))
    e = _numbered(edges).groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.to_json(edge).alias("d")))),
                                                           lambda x: x["d"]).alias("e"))
    body = F.array_join(F.concat("n", F.coalesce("e", F.array().cast("array<string>"))), ",")
    head = F.to_json(F.struct(F.col("set_id").alias("id"), "name", "collection"))
    return gset.join(n, "set_id").join(e, "set_id", "left").select("set_id", F.concat(
        F.lit('{"data":'), head, F.lit(',"elements":['), body, F.lit('],"n_genes":'), F.col("n_genes").cast("string"),
        F.lit(',"truncated":'), (F.col("n_genes") > F.size("n")).cast("string"), F.lit("}")).alias("json"))


_QUAL = "http://www.sbml.org/sbml/level3/version1/qual/version1"


def to_sbml(gset: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, xml): SBML Level 3 with the qualitative models package; directed curated edges are transitions."""
    q = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    species = F.format_string('<qual:qualitativeSpecies qual:id="%s" qual:name="%s" qual:compartment="cell" '
                              'qual:constant="false" qual:maxLevel="1"/>', xml_id(F.col("gene")), q(F.col("gene")))
    relation = F.coalesce(F.try_element_at("relations", F.lit(1)), F.lit("PPrel"))
    tag = F.concat(F.lit("t"), F.col("nth"))
    move = F.concat(
        F.format_string('<qual:transition qual:id="%s" qual:name="%s"><qual:listOfInputs>', tag,
                        q(F.concat(relation, F.lit(": "), "source", F.lit(" -> "), "target"))),
        F.format_string('<qual:input qual:id="%s_in" qual:qualitativeSpecies="%s" qual:transitionEffect="none" '
                        'qual:sign="unknown"/></qual:listOfInputs><qual:listOfOutputs>', tag, xml_id(F.col("source"))),
        F.format_string('<qual:output qual:id="%s_out" qual:qualitativeSpecies="%s" '
                        'qual:transitionEffect="assignmentLevel"/></qual:listOfOutputs>', tag, xml_id(F.col("target"))),
        F.format_string('<qual:listOfFunctionTerms><qual:defaultTerm qual:resultLevel="0"/><qual:functionTerm '
                        'qual:resultLevel="1"><math xmlns="http://www.w3.org/1998/Math/MathML"><apply><geq/><ci>%s</ci>'
                        '<cn type="integer">1</cn></apply></math></qual:functionTerm></qual:listOfFunctionTerms>'
                        '</qual:transition>', xml_id(F.col("source"))))
    n = nodes.groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_list(species)), "\n").alias("n"))
    e = _numbered(edges.where("directed")).groupBy("set_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("nth", move.alias("d")))), lambda x: x["d"]), "\n").alias("e"))
    head = (f'<?xml version="1.0" encoding="UTF-8"?>\n<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" '
            f'level="3" version="1" xmlns:qual="{_QUAL}" qual:required="true">')
    moves = F.when(F.col("e").isNotNull(), F.concat(F.lit("<qual:listOfTransitions>\n"), "e", F.lit("\n</qual:listOfTransitions>"))) \
        .otherwise(F.lit(""))
    return gset.join(n, "set_id").join(e, "set_id", "left").select("set_id", F.concat(
        F.lit(head), F.format_string('<model id="%s" name="%s">', xml_id(F.col("set_id")), q(F.col("name"))),
        F.lit('<listOfCompartments><compartment id="cell" constant="true"/></listOfCompartments>\n'
              '<qual:listOfQualitativeSpecies>\n'), "n", F.lit("\n</qual:listOfQualitativeSpecies>\n"), moves,
        F.lit("</model></sbml>\n")).alias("xml"))


def to_sbgn(gset: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, xml): SBGN-ML activity flow, genes on a square grid in rank order."""
    q = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    size = nodes.groupBy("set_id").agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1))))).alias("cols"))
    placed = nodes.join(size, "set_id").withColumn("x", ((F.col("rank") - 1) % F.col("cols")) * 140.0) \
        .withColumn("y", F.floor((F.col("rank") - 1) / F.col("cols")) * 70.0)
    glyph = F.format_string('<glyph id="%s" class="biological activity"><label text="%s"/>'
                            '<bbox x="%.1f" y="%.1f" w="100" h="40"/></glyph>', xml_id(F.col("gene")), q(F.col("gene")), "x", "y")
    at = lambda end: placed.select("set_id", F.col("gene").alias(end), F.col("x").alias(f"x_{end}"),
                                   F.col("y").cast("double").alias(f"y_{end}"))
    wired = _numbered(edges.where("directed")).join(at("source"), ["set_id", "source"]).join(at("target"), ["set_id", "target"])
    arc = F.format_string(
        '<arc id="%s" class="unknown influence" source="%s" target="%s"><start x="%.1f" y="%.1f"/><end x="%.1f" y="%.1f"/></arc>',
        F.concat(F.lit("a"), F.col("nth")), xml_id(F.col("source")),
        xml_id(F.col("target")), F.col("x_source") + 50, F.col("y_source") + 20, F.col("x_target") + 50, F.col("y_target") + 20)
    n = placed.withColumn("y", F.col("y").cast("double")).groupBy("set_id").agg(
        F.array_join(F.array_sort(F.collect_list(glyph)), "\n").alias("n"))
    e = wired.groupBy("set_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("nth", arc.alias("d")))), lambda x: x["d"]), "\n").alias("e"))
    return gset.join(n, "set_id").join(e, "set_id", "left").select("set_id", F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<sbgn xmlns="http://sbgn.org/libsbgn/0.3">'),
        F.format_string('<map id="%s" language="activity flow">\n', xml_id(F.col("set_id"))), "n", F.lit("\n"),
        F.coalesce("e", F.lit("")), F.lit("\n</map></sbgn>\n")).alias("xml"))
