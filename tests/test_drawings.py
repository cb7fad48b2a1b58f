import json
import random

import pytest
from pyspark.sql import functions as F

from loomset.operators import graph
from loomset.operators.identifiers import lookup_table
from loomset.sources import drawings, layouts, markup


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(k, s, "exact", 0, i) for i, (k, s) in enumerate([("1", "TP53"), ("2", "MDM2"), ("TP53", "TP53"), ("MDM2", "MDM2")])]
    return lookup_table(spark.createDataFrame(rows, "key string, symbol string, kind string, prio int, pos long")).cache()


def test_kgml_drawing(spark, lookup):
    xml = """<pathway name="path:hsa1" title="T"><entry id="1" name="hsa:1 hsa:2" type="gene"><graphics name="TP53, P53..." x="10" y="20" bgcolor="#BFFFBF" type="rectangle"/></entry>
      <entry id="2" name="cpd:C1" type="compound"><graphics name="C1" x="50" y="20" width="8" height="8" type="circle"/></entry>
      <entry id="3" name="hsa:9" type="gene"><graphics name="X..." x="90" y="20" type="rectangle"/></entry>
      <entry id="4" name="path:m" type="map"><graphics name="TITLE:Map" x="5" y="5" type="roundrectangle"/></entry>
      <entry id="5" name="hsa:2" type="gene"><graphics type="line" coords="1"/></entry>
      <entry id="6" name="undefined" type="group"><component id="1"/></entry><entry id="7" name="undefined" type="group"><component id="5"/></entry>
      <relation entry1="1" entry2="3" type="PPrel"><subtype name="phosphorylation" value="+p"/><subtype name="inhibition" value="--|"/></relation>
      <relation entry1="1" entry2="3" type="ECrel"><subtype name="compound" value="2"/></relation>
      <relation entry1="1" entry2="4" type="maplink"/><relation entry1="1" entry2="5" type="PPrel"/>
      <reaction id="3" type="reversible"><substrate id="2"/><product id="1"/></reaction></pathway>"""
    docs = spark.createDataFrame([("hsa1", xml), ("lines", '<pathway><entry id="1" type="gene" name="x"><graphics type="line"/></entry></pathway>')], "doc string, xml string")
    out = drawings.kgml_drawing(markup.shred(docs, markup.KGML), lookup).collect()
    assert [r["doc"] for r in out] == ["hsa1"]
    node = {n["id"]: n for n in out[0]["nodes"]}
    assert set(node) == {"k1", "k2", "k3", "k4", "k6"}
    assert node["k1"]["genes"] == ["MDM2", "TP53"] and node["k1"]["parent"] == "k6" and node["k1"]["label"] == "TP53" and node["k1"]["w"] == 46
    assert node["k2"]["kind"] == "compound" and node["k2"]["shape"] == "ellipse" and node["k4"]["kind"] == "title" and node["k4"]["label"] == "Map"
    assert node["k3"]["label"] == "X" and node["k3"]["genes"] == []
    edges = [(e["id"], e["source"], e["target"], e["arrow"], e["tail"], e["line"], e["label"], e["kind"]) for e in out[0]["edges"]]
    assert edges == [("e0", "k1", "k3", "tee", "none", "solid", "+p", "relation"), ("e1", "k1", "k2", "none", "none", "solid", "", "relation"),
                     ("e2", "k2", "k3", "triangle", "none", "solid", "", "relation"), ("e3", "k1", "k4", "none", "none", "dashed", "", "maplink"),
                     ("e4", "k2", "k3", "none", "triangle", "solid", "", "reaction"), ("e5", "k3", "k1", "triangle", "none", "solid", "", "reaction")]
    table = drawings.drawing_table(drawings.kgml_drawing(markup.shred(docs, markup.KGML), lookup), "KEGG").first()
    assert json.loads(table["data"])["name"] == "T"


def test_gpml_drawing(spark, lookup):
    xml = """<Pathway xmlns="http://pathvisio.org/GPML/2013a" Name="P" Version="WP7_1"><Graphics BoardWidth="300" BoardHeight="200"/>
      <DataNode TextLabel="TP53" GraphId="a" Type="GeneProduct" GroupRef="g"><Graphics CenterX="10" CenterY="10" Width="40"/><Xref ID="1"/></DataNode>
      <DataNode TextLabel="ATP" GraphId="m" Type="Metabolite"><Graphics CenterX="90" CenterY="10"/></DataNode>
      <Shape GraphId="s" TextLabel="cell"><Graphics CenterX="5" CenterY="5" ShapeType="Oval" ZOrder="4" FillColor="ff0000"/></Shape>
      <Interaction><Graphics LineStyle="Broken"><Point X="10" Y="10" GraphRef="a" ArrowHead="mim-inhibition"/><Point X="90" Y="10" GraphRef="m"/>
        <Anchor GraphId="an" Position="0.25"/></Graphics></Interaction>
      <Interaction><Graphics><Point X="1" Y="2"/><Point X="30" Y="10" GraphRef="an" ArrowHead="Arrow"/></Graphics></Interaction>
      <Group GroupId="g" GraphId="gg"/><Group GroupId="h" GraphId="hh"/></Pathway>"""
    row = drawings.gpml_drawing(markup.shred(spark.createDataFrame([("WP7", xml)], "doc string, xml string"), markup.GPML), lookup).first()
    node = {n["id"]: n for n in row["nodes"]}
    assert row["width"] == 300 and "hh" not in node and node["gg"]["kind"] == "group"
    assert node["a"]["genes"] == ["TP53"] and node["a"]["parent"] == "gg" and node["m"]["kind"] == "compound"
    assert node["s"]["z"] == -1 and node["s"]["shape"] == "ellipse" and node["s"]["fill"] == "#ff0000"
    assert (node["an"]["kind"], node["an"]["x"]) == ("point", 30.0)
    edges = [(e["source"], e["target"], e["arrow"], e["tail"], e["line"]) for e in row["edges"]]
    assert edges[0] == ("m", "a", "tee", "none", "dashed") and edges[1][1:] == ("an", "triangle", "none", "solid")
    free = node[edges[1][0]]
    assert (free["x"], free["y"]) == (1.0, 2.0)


def test_drawings_of_sets(spark):
    member = spark.createDataFrame([("S", "KEGG", "hsa1"), ("S", "Reactome", "R-2"), ("S", "KEGG", "none")], "set_id string, source string, source_set_id string")
    diagram = spark.createDataFrame([("KEGG", "hsa1", "T"), ("Reactome", "R-1", "Top")], "source string, source_set_id string, name string")
    of = spark.createDataFrame([("Reactome", "R-2", "R-1")], "source string, source_set_id string, diagram_id string")
    got = drawings.drawings_of_sets(member, diagram, of)
    assert {tuple(r) for r in got.select("source", "id", "name", "focus").collect()} == {("KEGG", "hsa1", "T", ""), ("Reactome", "R-1", "Top", "R-2")}
    assert got.where(F.col("focus") == "").count() == 1


LAYOUT = {"stableId": "R-1", "displayName": "Top", "maxX": 500, "maxY": 300,
          "compartments": [{"id": 1, "displayName": "cytosol", "prop": {"x": 0, "y": 0, "width": 100, "height": 50}}],
          "edges": [{"id": 7, "reactomeId": 70, "position": {"x": 40, "y": 44}}, {"id": 8, "reactomeId": 80, "position": {"x": 60, "y": 44}},
                    {"id": 9, "reactomeId": 70, "position": {"x": 80, "y": 44}}],
          "nodes": [{"id": 2, "reactomeId": 20, "displayName": "complex", "renderableClass": "Complex", "prop": {"x": 10, "y": 20, "width": 30, "height": 10},
                     "connectors": [{"edgeId": 7, "type": "INPUT"}, {"edgeId": 99, "type": "INPUT"}, {"edgeId": 8, "type": "CATALYST"}]},
                    {"id": 3, "reactomeId": 30, "displayName": "ATP", "renderableClass": "Chemical", "prop": {"x": 0, "y": 0, "width": 2, "height": 2},
                     "connectors": [{"edgeId": 9, "type": "OUTPUT"}]},
                    {"id": 4, "reactomeId": 40, "stId": "R-4", "renderableClass": "ProcessNode", "prop": {"x": 0, "y": 0, "width": 2, "height": 2}},
                    {"id": 5, "reactomeId": 21, "renderableClass": "NewClass", "prop": {"x": 0, "y": 0, "width": 2, "height": 2}, "connectors": [{"edgeId": 8, "type": "odd"}]}]}
PARTS = {"nodes": [{"dbId": 20, "children": [21, 22, 20]}, {"dbId": 21, "geneNames": ["nope", "MDM2", "TP53"]}, {"dbId": 22, "children": [23]},
                   {"dbId": 23, "geneNames": ["TP53"], "children": [20]}, {"dbId": 30, "geneNames": ["TP53"]}],
         "subpathways": [{"stId": "R-8", "events": [80, 555]}, {"stId": "R-7", "events": [70]}, {"stId": "R-0", "events": [555]}]}


def test_layout_drawing(spark, lookup, tmp_path):
    for name, body in (("R-1.json", LAYOUT), ("R-1.graph.json", PARTS), ("R-2.json", {"displayName": "Bare", "edges": []}), ("R-2.graph.json", {}),
                       ("R-3.json", LAYOUT)):
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "R-5.json").write_text("{broken")
    (tmp_path / "R-5.graph.json").write_text("{}")
    drawn = layouts.layout_drawing(layouts.layout_files(spark, str(tmp_path)), lookup)
    rows = {r["doc"]: r for r in drawn.collect()}
    assert set(rows) == {"R-1", "R-2"} and rows["R-2"]["name"] == "Bare" and rows["R-2"]["nodes"] == rows["R-2"]["edges"] == []
    top = rows["R-1"]
    assert (top["name"], top["width"], top["height"]) == ("Top", 500, 300)
    assert [n["id"] for n in top["nodes"]] == ["c1", "r7", "r8", "r9", "n2", "n3", "n4", "n5"]
    node = {n["id"]: n for n in top["nodes"]}
    assert (node["c1"]["x"], node["c1"]["y"], node["c1"]["z"], node["c1"]["kind"]) == (50, 25, -1, "shape")
    assert (node["r7"]["x"], node["r7"]["y"], node["r7"]["w"], node["r7"]["reactome"]) == (40, 44, 8, 70)
    assert node["n2"]["genes"] == ["MDM2", "TP53"] and node["n2"]["shape"] == "cut-rectangle" and node["n3"]["genes"] == []
    assert node["n4"]["stId"] == "R-4" and node["n4"]["label"] == "" and node["n5"]["genes"] == ["MDM2"] and node["n5"]["fill"] == "#dddddd"
    assert [(e["id"], e["source"], e["target"], e["arrow"], e["kind"]) for e in top["edges"]] == [
        ("e0", "n2", "r7", "none", "input"), ("e1", "n2", "r8", "circle", "catalyst"), ("e2", "r9", "n3", "triangle", "output"), ("e3", "n5", "r8", "none", "odd")]
    assert top["subpathways"] == {"R-8": ["n2", "n5", "r8"], "R-7": ["n3", "r9"]}
    data = {r["source_set_id"]: json.loads(r["data"]) for r in drawings.drawing_table(drawn, "Reactome").collect()}
    assert data["R-1"]["subpathways"]["R-7"] == ["n3", "r9"]


def test_nearest_holder_stops_at_the_first(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a"), ("e", "d"), ("e", "b"), ("x", "y"), ("y", "x"), ("z", "z")], "child string, parent string")
    held = spark.createDataFrame([("a",), ("b",), ("d",)], "node string")
    wanted = spark.createDataFrame([(n,) for n in "abcdexyz"], "node string")
    got = {r["node"]: (r["holder"], r["depth"]) for r in graph.nearest_holder(edges, held, wanted).collect()}
    assert got == {"a": ("a", 0), "b": ("b", 0), "c": ("b", 1), "d": ("d", 0), "e": ("b", 1)}
    assert graph.nearest_holder(edges, held, wanted.where("false")).count() == 0


def test_closure_of_deep_and_crossed_graphs(spark):
    rng = random.Random(6)
    edges = {(f"n{i}", f"n{i + 1}") for i in range(40)} | {(f"n{rng.randrange(41)}", f"n{rng.randrange(41)}") for _ in range(6)} | {("q", "q")}
    want = {}
    for child in {c for c, _ in edges}:
        front, depth = {child}, 0
        while front:
            depth += 1
            front = {p for c, p in edges if c in front} - {child} - {a for c, a in want if c == child}
            want |= {(child, a): depth for a in front}
    got = graph.ancestors(spark.createDataFrame(sorted(edges), "child string, parent string")).collect()
    assert {(r["child"], r["ancestor"]): r["depth"] for r in got} == want and len(got) == len(want)


def test_markup_without_python(spark, tmp_path):
    kgml = ('<?xml version="1.0"?><!DOCTYPE pathway SYSTEM "k.dtd"><pathway name="p"><entry id="1"/><entry id="6"><component id="1"/><component id="2"/></entry>'
            '<relation entry1="1"><subtype name="s"/></relation></pathway>')
    docs = spark.createDataFrame([("a", kgml), ("b", "<pathway><entry>"), ("c", ""), ("d", None), ("e", "<pathway/>")], "doc string, xml string")
    rows = markup.elements(docs, markup.KGML)
    assert "Python" not in rows._jdf.queryExecution().toString() and "InPandas" not in rows._jdf.queryExecution().toString()
    got = rows.orderBy("doc", "nid").collect()
    assert [(r["doc"], r["tag"], r["attrs"]) for r in got] == [
        ("a", "pathway", {"name": "p"}), ("a", "entry", {"id": "1"}), ("a", "entry", {"id": "6"}), ("a", "component", {"id": "1"}),
        ("a", "component", {"id": "2"}), ("a", "relation", {"entry1": "1"}), ("a", "subtype", {"name": "s"}), ("e", "pathway", {})]
    number = {r["nid"]: r for r in got if r["doc"] == "a"}
    assert [r["parent"] in number or r["parent"] == -1 for r in got] == [True] * 8 and got[3]["parent"] == got[4]["parent"] == got[2]["nid"]
    (tmp_path / "Hs_x_WP9_1.gpml").write_text('<Pathway xmlns="http://pathvisio.org/GPML/2013a"><Comment Source="s"> t </Comment></Pathway>')
    files = markup.shred(markup.gpml_files(spark, str(tmp_path)), markup.GPML).orderBy("nid").collect()
    assert [(r["doc"], r["tag"], r["text"]) for r in files] == [("WP9", "Pathway", ""), ("WP9", "Comment", "t")]


def test_a_document_is_parsed_once(spark):
    whole = '<Pathway xmlns="http://pathvisio.org/GPML/2013a"><Label TextLabel="L%d"/></Pathway>'
    docs = spark.createDataFrame([(f"d{i}", whole % i) for i in range(3)] + [("broken", "<Pathway><Label>"), ("none", None)], "doc string, xml string")
    rows = markup.elements(docs, markup.GPML)
    got = {(x["doc"], x["tag"], x["attrs"].get("TextLabel")) for x in rows.collect()}
    assert got == {(f"d{i}", tag, label) for i in range(3) for tag, label in (("Pathway", None), ("Label", f"L{i}"))}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_layout_parts_do_not_go_along_to_the_genes(spark, lookup):
    import re

    docs = spark.createDataFrame([("d", '{"displayName": "x", "nodes": [], "edges": [{"id": 1, "reactomeId": 5, "position": {"x": 1, "y": 1}}]}',
                                   '{"nodes": [{"dbId": 5, "geneNames": ["A"], "children": []}], "subpathways": [{"stId": "S", "events": [5]}]}')], "doc string, layout string, parts string")
    drawn = layouts.layout_drawing(docs, lookup)
    row = drawn.first()
    assert row["name"] == "x" and row["subpathways"] == {"S": ["r1"]} and [n["id"] for n in row["nodes"]] == ["r1"]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"p#\d+\.subpathways AS subpathways", plan[plan.index("Join LeftOuter"):])
