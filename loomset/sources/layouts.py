"""Pathway drawings from layout documents: JSON with placed nodes and reactions, and JSON with what the nodes are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import reached
from ..operators.identifiers import map_column
from ..session import cut

BOX = "struct<x:double,y:double,width:double,height:double>"
LAYOUT = f"""stableId string, displayName string, maxX double, maxY double,
  compartments array<struct<id:bigint,displayName:string,prop:{BOX}>>,
  edges array<struct<id:bigint,reactomeId:bigint,position:struct<x:double,y:double>>>,
  nodes array<struct<id:bigint,reactomeId:bigint,stId:string,displayName:string,renderableClass:string,prop:{BOX},
    connectors:array<struct<edgeId:bigint,type:string>>>>"""
PARTS = """nodes array<struct<dbId:bigint,geneNames:array<string>,children:array<bigint>>>,
  subpathways array<struct<stId:string,events:array<bigint>>>"""

# Classes of drawn entities with kind, shape and fill, and connector types with the end the arrow stands at
# and its form; others are a gene in a grey rectangle, and an input without arrow.
STYLE = """
Protein gene round-rectangle #a8e4b0
ProteinDrug gene round-rectangle #a8e4b0
Gene gene rectangle #c9e9c9
RNA gene rhomboid #c9e9c9
Complex gene cut-rectangle #a9cfe8
ComplexDrug gene cut-rectangle #a9cfe8
EntitySet gene round-rectangle #a9cfe8
EntitySetDrug gene round-rectangle #a9cfe8
Chemical chemical ellipse #c7dbe9
ChemicalDrug chemical ellipse #c7dbe9
Entity gene rectangle #dddddd
ProcessNode map round-rectangle #e6f4d7
EncapsulatedNode map round-rectangle #e6f4d7
"""
CONNECTOR = """
INPUT in none
OUTPUT out triangle
CATALYST in circle
ACTIVATOR in triangle
INHIBITOR in tee
"""
MOST_STEPS = 30


def _chosen(table: str, column: int, key: Column, default: str) -> Column:
    rows = [line.split() for line in table.strip().splitlines()]
    pairs = F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[column])])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), F.lit(default))


def layout_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, layout, parts): the JSON texts of ``folder``/ID.json and ID.graph.json; one without the other is left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.graph)?\.json$", 1).alias("doc"), F.col("_metadata.file_name").endswith(".graph.json").alias("is_parts"))
    return files.groupBy("doc").agg(F.max(F.when(~F.col("is_parts"), F.col("value"))).alias("layout"),
                                    F.max(F.when(F.col("is_parts"), F.col("value"))).alias("parts")).where("layout IS NOT NULL AND parts IS NOT NULL")


def genes_of_entities(docs: DataFrame, drawn: DataFrame, lookup: DataFrame) -> DataFrame:
    """(doc, root, genes): sorted genes of each drawn entity (doc, root): of itself and of all its parts, down to
    ``MOST_STEPS`` levels, the first of its gene names that resolves."""
    part = docs.select("doc", F.inline("p.nodes"))
    edges = part.select("doc", F.col("dbId").alias("node"), F.explode("children").alias("to"))
    names = part.select("doc", F.col("dbId").alias("node"), F.posexplode("geneNames").alias("i", "ident"))
    gene = map_column(names, "ident", lookup, "gene").where("gene IS NOT NULL").groupBy("doc", "node").agg(F.min_by("gene", "i").alias("gene"))
    within = reached(drawn, edges, ("doc",), MOST_STEPS - 1)
    return within.join(gene, ["doc", "node"]).groupBy("doc", "root").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _node(id_: Column, kind: Column, label: Column, box: Column, shape: Column, **more: Column) -> Column:
    """A drawn node; ``box`` has its upper left corner and size."""
    rest = {"genes": F.array().cast("array<string>"), "parent": F.lit(None).cast("string"), "fill": F.lit(None).cast("string"), "z": F.lit(2),
            "reactome": F.lit(None).cast("bigint"), "stId": F.lit(None).cast("string")} | more
    return F.struct(id_.alias("id"), kind.alias("kind"), F.coalesce(label, F.lit("")).alias("label"), (box["x"] + box["width"] / 2).alias("x"),
                    (box["y"] + box["height"] / 2).alias("y"), box["width"].alias("w"), box["height"].alias("h"), shape.alias("shape"),
                    *[value.alias(name) for name, value in rest.items()])


def layout_drawing(docs: DataFrame, lookup: DataFrame) -> DataFrame:
    """(doc, name, width, height, nodes, edges, subpathways) of documents (doc, layout, parts).

    Compartments, then reactions (small boxes at their place), then entities are nodes; every connector of an entity to a
    reaction of the layout is an edge, numbered in document order. ``subpathways`` maps the id of a sub-pathway to the
    nodes of its reactions: what a request shows in focus. A document is one row; only gene names and parts are joined.
    """
    row = docs.select("doc", F.from_json("layout", LAYOUT).alias("l"), F.from_json("parts", PARTS).alias("p"))
    row = cut(row.where("l.nodes IS NOT NULL OR l.edges IS NOT NULL"))  # parsed once; its columns are read apart
    drawn = row.select("doc", F.inline("l.nodes")).where(_chosen(STYLE, 1, F.col("renderableClass"), "gene") == "gene").select("doc", F.col("reactomeId").alias("root"))
    genes = genes_of_entities(row, drawn.where("root IS NOT NULL"), lookup).groupBy("doc").agg(
        F.map_from_entries(F.collect_list(F.struct("root", "genes"))).alias("genes"))
    # of the parts only what is made of them goes on to their documents
    row = row.select("doc", "l", F.col("p.subpathways").alias("subpathways")).join(genes, "doc", "left")
    none = F.array()
    areas = F.transform(F.coalesce("l.compartments", none.cast(f"array<struct<id:bigint,displayName:string,prop:{BOX}>>")), lambda c: _node(
        _text("c", c["id"]), F.lit("shape"), c["displayName"], c["prop"], F.lit("round-rectangle"), z=F.lit(-1)))
    reactions = F.coalesce("l.edges", none.cast("array<struct<id:bigint,reactomeId:bigint,position:struct<x:double,y:double>>>"))
    spots = F.transform(reactions, lambda e: _node(
        _text("r", e["id"]), F.lit("reaction"), F.lit(""), F.struct((e["position"]["x"] - 4).alias("x"), (e["position"]["y"] - 4).alias("y"),
                                                                   F.lit(8.0).alias("width"), F.lit(8.0).alias("height")),
        F.lit("rectangle"), z=F.lit(3), reactome=e["reactomeId"]))

    def entity(n: Column) -> Column:
        kind = _chosen(STYLE, 1, n["renderableClass"], "gene")
        held = F.when(kind == "gene", F.try_element_at("genes", n["reactomeId"]))
        return _node(_text("n", n["id"]), kind, n["displayName"], n["prop"], _chosen(STYLE, 2, n["renderableClass"], "rectangle"),
                     genes=F.coalesce(held, F.array().cast("array<string>")), fill=_chosen(STYLE, 3, n["renderableClass"], "#dddddd"),
                     stId=F.when(kind == "map", n["stId"]))

    def wires(n: Column) -> Column:
        known = F.filter(F.coalesce(n["connectors"], F.array().cast("array<struct<edgeId:bigint,type:string>>")),
                         lambda c: F.exists(reactions, lambda e: e["id"] == c["edgeId"]))
        ends = F.transform(known, lambda c: F.struct(c.alias("c"), _text("n", n["id"]).alias("n"), _text("r", c["edgeId"]).alias("r"),
                                                     (_chosen(CONNECTOR, 1, c["type"], "in") == "in").alias("leads")))
        return F.transform(ends, lambda x: F.struct(
            F.when(x["leads"], x["n"]).otherwise(x["r"]).alias("source"), F.when(x["leads"], x["r"]).otherwise(x["n"]).alias("target"),
            _chosen(CONNECTOR, 2, x["c"]["type"], "none").alias("arrow"), F.lit("none").alias("tail"), F.lit("solid").alias("line"),
            F.lit("").alias("label"), F.lower(F.coalesce(x["c"]["type"], F.lit(""))).alias("kind")))

    row = row.withColumn("nodes", F.concat(areas, spots, F.when(F.size("l.nodes") > 0, F.transform("l.nodes", entity)).otherwise(F.slice(areas, 1, 0))))
    lines = F.when(F.size("l.nodes") > 0, F.flatten(F.transform("l.nodes", wires))).otherwise(
        F.array().cast("array<struct<source:string,target:string,arrow:string,tail:string,line:string,label:string,kind:string>>"))
    row = row.withColumn("lines", lines).withColumn("edges", F.transform("lines", lambda e, i: F.struct(
        _text("e", i).alias("id"), *[e[c].alias(c) for c in ("source", "target", "arrow", "tail", "line", "label", "kind")])))

    def focus(sub: Column) -> Column:
        # of reactions with one event id the last one stands for it
        own = F.array_compact(F.transform(F.coalesce(sub["events"], F.array().cast("array<bigint>")), lambda ev: F.try_element_at(
            F.filter(reactions, lambda e: e["reactomeId"] == ev), F.lit(-1))["id"]))
        own = F.transform(own, lambda i: _text("r", i))
        near = F.filter("lines", lambda e: F.array_contains(own, e["source"]) | F.array_contains(own, e["target"]))
        return F.struct(sub["stId"].alias("stId"), F.array_sort(F.array_distinct(F.concat(
            own, F.transform(near, lambda e: e["source"]), F.transform(near, lambda e: e["target"])))).alias("nodes"))

    subs = F.filter(F.transform("subpathways", focus), lambda s: F.size(s["nodes"]) > 0)
    return row.select("doc", F.coalesce("l.displayName", F.lit("")).alias("name"), F.coalesce("l.maxX", F.lit(0.0)).alias("width"),
                      F.coalesce("l.maxY", F.lit(0.0)).alias("height"), "nodes", "edges", F.map_from_entries(subs).alias("subpathways"))
