"""Queries over the file readers: Spark writes lines made from the driver's tables in a source's format, the reader reads
them back, and SQL states the result from the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.catalogue import by_lower_name
from ..operators.identifiers import lookup_table
from ..session import checkpoint_folder
from ..sources import delimited as D
from ..sources import layouts, markup
from .projections import Tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        ORACLE[name] = sql
        return fn
    return add


def _path(t: Tables) -> str:
    return f"{checkpoint_folder(t.spark).rstrip('/')}/loomset-text-{uuid.uuid4().hex}"


def written(t: Tables, *parts: Column, rows: DataFrame, sep: str = "\t", end: str = "\n") -> str:
    """A folder of text files with one line (or record) a row: the parts joined by ``sep``."""
    path = _path(t)
    rows.select(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("value")).write.option("lineSep", end).text(path)
    return path


def table_of(t: Tables, rows: DataFrame) -> str:
    """A folder of tab-separated files with a header."""
    path = _path(t)
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
    return path


def c(name: str) -> Column:
    return F.col(name).cast("string")


def tag(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), c(name))


@query("read_gmt", """SELECT 'S' || l_suppkey AS set_id, 'list ' || l_linenumber AS description, 'G' || l_partkey AS gene, count(*) AS n
  FROM lineitem GROUP BY ALL""")
def read_gmt(t: Tables) -> DataFrame:
    path = written(t, tag("S", "l_suppkey"), tag("list ", "l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(tag("G", "l_partkey")),
                   F.when(F.col("l_linenumber") % 2 == 0, tag("G", "l_partkey")).otherwise(""), rows=t.lineitem)
    return D.gmt(t.spark, path).groupBy("set_id", "description", "gene").agg(F.count(F.lit(1)).alias("n"))


@query("read_gaf", """SELECT 'U' || l_partkey AS object_id, 'G' || l_partkey AS object_symbol,
    CASE WHEN l_linestatus = 'F' THEN 'NOT|enables' ELSE 'enables' END AS qualifier, 'GO:' || l_orderkey AS term, l_returnflag AS evidence, count(*) AS n
  FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY ALL""")
def read_gaf(t: Tables) -> DataFrame:
    blank = F.lit("")
    taxon = F.when(F.col("l_linenumber") % 3 == 0, "taxon:9606|taxon:1").otherwise("taxon:96061")
    path = written(t, F.lit("UniProtKB"), tag("U", "l_partkey"), tag("G", "l_partkey"), F.when(F.col("l_linestatus") == "F", "NOT|enables").otherwise("enables"),
                   tag("GO:", "l_orderkey"), blank, F.col("l_returnflag"), *[blank] * 5, taxon, blank, F.lit("x"), rows=t.lineitem)
    head = written(t, F.lit("!gaf-version: 2.2"), rows=t.region)
    both = D.gaf(t.spark, path, "9606").unionByName(D.gaf(t.spark, head))
    return both.groupBy("object_id", "object_symbol", "qualifier", "term", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("go_annotations", """SELECT DISTINCT CASE WHEN l_linenumber = 2 THEN 'GO:M' || l_orderkey % 50 WHEN l_orderkey % 50 = 7 THEN 'GO:M8' ELSE 'GO:M' || l_orderkey % 50 END AS term,
    'G' || l_partkey AS gene, l_returnflag AS evidence
  FROM lineitem WHERE l_linestatus <> 'F' AND l_returnflag <> 'R' AND NOT (l_orderkey % 50 = 9) AND NOT (l_linenumber = 2 AND l_orderkey % 50 IN (7, 9))
  UNION SELECT DISTINCT 'GO:M8', 'G' || l_partkey, l_returnflag FROM lineitem
  WHERE l_linestatus <> 'F' AND l_returnflag <> 'R' AND l_linenumber = 2 AND l_orderkey % 50 = 7""")
def go_annotations(t: Tables) -> DataFrame:
    """Alternative ids become main ones, a replaced term gives way, an obsolete one without a successor is dropped."""
    number = (F.col("l_orderkey") % 50).cast("string")
    raw = t.lineitem.select(tag("U", "l_partkey").alias("object_id"), tag("G", "l_partkey").alias("object_symbol"),
                            F.when(F.col("l_linestatus") == "F", "NOT|part_of").otherwise("").alias("qualifier"),
                            F.concat(F.when(F.col("l_linenumber") == 2, "GO:A").otherwise("GO:M"), number).alias("term"),
                            F.col("l_returnflag").alias("evidence"))
    numbers = t.orders.select((F.col("o_orderkey") % 50).cast("string").alias("k")).distinct()
    term = numbers.select(F.concat(F.lit("GO:M"), "k").alias("term"), F.col("k").isin("7", "9").alias("obsolete"),
                          F.when(F.col("k") == "7", "GO:M8").otherwise("").alias("replaced_by"))
    alt = numbers.select(F.concat(F.lit("GO:A"), "k").alias("alt_id"), F.concat(F.lit("GO:M"), "k").alias("term"))
    return D.annotations(raw, term, alt, exclude=("R",))


@query("read_obo", """SELECT 'GO:' || o_orderkey AS child, 'GO:C' || o_custkey AS parent FROM orders
  UNION SELECT 'GO:' || o_orderkey, 'GO:P' || substr(o_orderpriority, 1, 1) FROM orders""")
def read_obo(t: Tables) -> DataFrame:
    record = F.concat(F.lit("[Term]\nid: GO:"), c("o_orderkey"), F.lit("\nname: order "), c("o_orderkey"), F.lit("\nnamespace: biological_process\nis_a: GO:C"),
                      c("o_custkey"), F.lit(" ! customer\nrelationship: part_of GO:P"), F.substring("o_orderpriority", 1, 1), F.lit(" ! x\nrelationship: regulates GO:Q1"))
    return D.obo(t.spark, written(t, record, rows=t.orders, end="\n\n"))[1].distinct()


@query("read_mitab", """SELECT 'P' || l_partkey AS id_a, 'S' || l_suppkey AS id_b, CASE WHEN l_returnflag = 'R' THEN 'MINT' ELSE 'IntAct' END AS source,
    l_orderkey::VARCHAR AS pmid, 'pull down' AS method, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def read_mitab(t: Tables) -> DataFrame:
    dash = F.lit("-")
    rows = t.lineitem.withColumn("line", F.concat_ws(
        "\t", F.when(F.col("l_linenumber") == 1, tag("uniprotkb:P", "l_partkey")).otherwise("chebi:1"),
        tag("uniprotkb:S", "l_suppkey"), F.when(F.col("l_linenumber") == 1, dash).otherwise(tag("entrez gene/locuslink:P", "l_partkey")), *[dash] * 3,
        F.lit('psi-mi:"MI:0096"(pull down)'), dash, tag("doi:1|pubmed:", "l_orderkey"),
        F.lit("taxid:9606(human)"), F.when(F.col("l_linestatus") == "O", "taxid:9606(human)").otherwise("taxid:10090(mouse)"), dash,
        F.when(F.col("l_returnflag") == "R", 'psi-mi:"MI:0471"(MINT)').otherwise('psi-mi:"MI:0469"(IntAct)')))
    found = D.mitab(rows.select("line"))
    return found.groupBy("id_a", "id_b", "source", "pmid", "method").agg(F.count(F.lit(1)).alias("n"))


@query("read_string_links", """SELECT p_name AS id_a, s_name AS id_b, l_quantity::INT * 20 AS score, count(*) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity::INT * 20 >= 700 GROUP BY ALL""")
def read_string_links(t: Tables) -> DataFrame:
    links = _path(t)
    t.lineitem.select(tag("9606.P", "l_partkey").alias("protein1"), tag("9606.S", "l_suppkey").alias("protein2"),
                      (F.col("l_quantity").cast("int") * 20).alias("combined_score")).write.option("sep", " ").option("header", True).csv(links)
    names = t.part.select(tag("9606.P", "p_partkey").alias("k"), F.col("p_name").alias("v")).union(t.supplier.select(tag("9606.S", "s_suppkey"), "s_name"))
    info = written(t, F.col("k"), F.col("v"), F.lit("100"), rows=names)
    found = D.string_links(t.spark, links, info)
    return found.groupBy("id_a", "id_b", "score").agg(F.count(F.lit(1)).alias("n"))


@query("read_biogrid", """SELECT l_partkey::VARCHAR AS id_a, l_suppkey::VARCHAR AS id_b, 'PUBMED:' || l_orderkey AS pmid, 'Two-hybrid' AS method, count(*) AS n
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A' GROUP BY ALL""")
def read_biogrid(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.lit("9606").alias("Organism ID Interactor A"), F.when(F.col("l_linestatus") == "O", "9606").otherwise("10090").alias("Organism ID Interactor B"),
                             F.when(F.col("l_returnflag") == "A", "genetic").otherwise("physical").alias("Experimental System Type"),
                             c("l_partkey").alias("Entrez Gene Interactor A"), c("l_suppkey").alias("Entrez Gene Interactor B"),
                             tag("PUBMED:", "l_orderkey").alias("Publication Source"), F.lit("Two-hybrid").alias("Experimental System"))
    return D.biogrid(t.spark, table_of(t, rows)).groupBy("id_a", "id_b", "pmid", "method").agg(F.count(F.lit(1)).alias("n"))


@query("read_pair_table", """SELECT 'P' || l_partkey AS id_a, 'S' || l_suppkey AS id_b, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INT ELSE 0 END AS score, count(*) AS n
  FROM lineitem GROUP BY ALL""")
def read_pair_table(t: Tables) -> DataFrame:
    third = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise("n/a")
    path = written(t, tag("P", "l_partkey"), tag("S", "l_suppkey"), third, rows=t.lineitem)
    return D.pair_table(t.spark, path, "pairs").groupBy("id_a", "id_b", "score").agg(F.count(F.lit(1)).alias("n"))


@query("read_gene_info", """SELECT 'P' || p_partkey AS key, 'p' || p_partkey AS symbol, 'exact' AS kind, 1 AS prio FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'p' || p_partkey, 'exact', 2 FROM part
  UNION ALL SELECT 'LOC' || p_partkey, 'p' || p_partkey, 'exact', 2 FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT 'HGNC:HGNC:' || p_size, 'p' || p_partkey, 'exact', 2 FROM part
  UNION ALL SELECT 'HGNC:' || p_size, 'p' || p_partkey, 'exact', 2 FROM part
  UNION ALL SELECT 'ENSG' || p_partkey, 'p' || p_partkey, 'exact', 2 FROM part
  UNION ALL SELECT 'BR' || replace(upper(p_brand), '#', ''), 'p' || p_partkey, 'alias', 0 FROM part
  UNION ALL SELECT 'ALT' || p_partkey, 'p' || p_partkey, 'alias', 0 FROM part""")
def read_gene_info(t: Tables) -> DataFrame:
    rows = t.part.select(F.when(F.col("p_size") > 0, "9606").alias("#tax_id"), c("p_partkey").alias("GeneID"), tag("p", "p_partkey").alias("Symbol"),
                         F.when(F.col("p_size") % 2 == 0, tag("LOC", "p_partkey")).otherwise("-").alias("LocusTag"),
                         F.concat(F.lit("br"), F.regexp_replace("p_brand", "#", ""), F.lit("|alt"), c("p_partkey")).alias("Synonyms"),
                         F.concat(F.lit("HGNC:HGNC:"), c("p_size"), F.lit("|Ensembl:ENSG"), c("p_partkey")).alias("dbXrefs"))
    return D.gene_info(t.spark, table_of(t, rows), "9606")[0].select("key", "symbol", "kind", "prio")


@query("read_hgnc", """WITH g AS (SELECT * FROM part WHERE p_size <> 13)
  SELECT 'P' || p_partkey AS key, 'p' || p_partkey AS symbol, 'exact' AS kind FROM g UNION ALL SELECT 'HGNC:' || p_partkey, 'p' || p_partkey, 'exact' FROM g
  UNION ALL SELECT p_partkey::VARCHAR, 'p' || p_partkey, 'exact' FROM g UNION ALL SELECT 'OLD' || p_size, 'p' || p_partkey, 'previous' FROM g
  UNION ALL SELECT 'AL' || p_partkey, 'p' || p_partkey, 'alias' FROM g UNION ALL SELECT 'SZ' || p_size, 'p' || p_partkey, 'alias' FROM g""")
def read_hgnc(t: Tables) -> DataFrame:
    rows = t.part.select(tag("p", "p_partkey").alias("symbol"), F.when(F.col("p_size") == 13, "Withdrawn").otherwise("Approved").alias("status"),
                         tag("HGNC:", "p_partkey").alias("hgnc_id"), c("p_partkey").alias("entrez_id"), tag("old", "p_size").alias("prev_symbol"),
                         F.concat(F.lit("al"), c("p_partkey"), F.lit("|sz"), c("p_size")).alias("alias_symbol"))
    return D.hgnc(t.spark, table_of(t, rows))[0].select("key", "symbol", "kind")


@query("read_kegg_genes", """SELECT upper(CASE WHEN p_size % 3 = 0 THEN 'b' || p_partkey ELSE 'Gx' || p_partkey END) AS key,
    CASE WHEN p_size % 3 = 0 THEN 'b' || p_partkey ELSE 'Gx' || p_partkey END AS symbol, 'exact' AS kind FROM part
  UNION ALL SELECT 'B' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'b' || p_partkey ELSE 'Gx' || p_partkey END, 'exact' FROM part
  UNION ALL SELECT 'SZ' || p_size, 'Gx' || p_partkey, 'alias' FROM part WHERE p_size % 3 <> 0""")
def read_kegg_genes(t: Tables) -> DataFrame:
    desc = F.when(F.col("p_size") % 3 == 0, F.lit("hypothetical protein")).otherwise(F.concat(F.lit("Gx"), c("p_partkey"), F.lit(", sz"), c("p_size"), F.lit(", long name; enzyme")))
    path = written(t, tag("eco:b", "p_partkey"), F.lit("CDS"), F.lit("1..2"), desc, rows=t.part)
    return D.kegg_gene_list(t.spark, path)[0].select("key", "symbol", "kind")


@query("read_uniprot_ids", """SELECT 'A' || p_partkey AS key, p_name AS symbol, 3 AS prio FROM part WHERE p_size <> 7
  UNION ALL SELECT 'E' || p_partkey || '_HUMAN', p_name, 3 FROM part WHERE p_size <> 7""")
def read_uniprot_ids(t: Tables) -> DataFrame:
    ids = t.part.select(c("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"))
    path = written(t, tag("a", "p_partkey"), F.concat(F.lit("e"), c("p_partkey"), F.lit("_human")),
                   F.when(F.col("p_size") == 7, "").otherwise(F.concat(c("p_partkey"), F.lit("; 0"))), rows=t.part)
    return D.uniprot_idmapping(t.spark, path, ids).select("key", "symbol", "prio")


@query("read_legacy_source", """SELECT 'gene' AS kind, 'way ' || l_suppkey AS name, 'P' || l_partkey AS a, '' AS b FROM lineitem GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT DISTINCT unnest(['r' || l_linenumber, l_returnflag]) AS kind, 'way ' || l_suppkey AS name, 'P' || l_partkey AS a, 'O' || l_orderkey AS b FROM lineitem)""")
def read_legacy_source(t: Tables) -> DataFrame:
    gen = written(t, tag("way ", "l_suppkey"), tag("P", "l_partkey"), rows=t.lineitem)
    gpr = written(t, tag("P", "l_partkey"), tag("O", "l_orderkey"), F.concat(F.lit(" r"), c("l_linenumber"), F.lit("  "), F.col("l_returnflag")),
                  tag("way ", "l_suppkey"), rows=t.lineitem)
    _, gene, pair = D.legacy_source(t.spark, gen, gpr, "old")
    return gene.select(F.lit("gene").alias("kind"), "name", F.col("gene").alias("a"), F.lit("").alias("b")).union(
        pair.select("relation", "name", "gene_a", "gene_b"))


# A roman numeral from 1 to 39, in SQL and as a column.
_ROMAN_SQL = "repeat('X', ({0}) // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][({0}) % 10 + 1]"


def _roman(n: Column) -> Column:
    ones = F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    return F.concat(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), F.get(ones, (n % 10).cast("int")))


_SIZE = "(p_size % 39 + 1)"


@query("name_entities", f"""SELECT p_partkey, 'TYPE' || {_SIZE} || ',' || 'ABC' || p_size || ',' || 'TGF' AS found FROM part""")
def name_entities(t: Tables) -> DataFrame:
    """Numerals after a subtype word, numbers joined to the symbol before them, capitals; roman numerals are no genes."""
    n = F.col("p_size") % 39 + 1
    name = F.concat(F.lit("receptor type "), _roman(n), F.lit(" of ABC-"), c("p_size"), F.lit(" and TGF beta pathway II"))
    return t.part.select("p_partkey", F.array_join(X.entities(name), ",").alias("found"))


@query("name_entity_mismatch", f"""SELECT p_partkey, {_SIZE} <> 5 AS differs FROM part""")
def name_entity_mismatch(t: Tables) -> DataFrame:
    n = F.col("p_size") % 39 + 1
    return t.part.select("p_partkey", X.entity_mismatch(F.concat(F.lit("kinase class "), _roman(n)), F.lit("kinase class 5")).alias("differs"))


@query("integrated_names", f"""SELECT p_partkey, 'breakdown of ' || regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS name FROM part""")
def integrated_names(t: Tables) -> DataFrame:
    n = F.col("p_size") % 39 + 1
    return t.part.select("p_partkey", X.integrated_name(F.concat(F.lit("breakdown of  "), F.col("p_name"), F.lit(" "), _roman(n), F.lit(" "), _roman(n))).alias("name"))


@query("xml_ids", "SELECT p_partkey, 'g_' || regexp_replace(p_name || '-' || p_size, '[^A-Za-z0-9_]', '_', 'g') AS id FROM part")
def xml_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.xml_id(F.concat("p_name", F.lit("-"), c("p_size"))).alias("id"))


@query("group_by_lower_name", "SELECT lower(p_type) AS low, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1")
def group_by_lower_name(t: Tables) -> DataFrame:
    return by_lower_name(t.part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("set_id"))).select(
        "low", "n", F.col("first_id").alias("first_part"))


@query("layout_drawing", """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
  p AS (SELECT l_orderkey AS id, l_linenumber AS ln, CASE WHEN l_partkey % 3 = 0 THEN 'PART' || l_partkey WHEN l_suppkey % 2 = 0 THEN 'SUPP' || l_suppkey END AS gene FROM lineitem),
  g AS (SELECT id, list_sort(list(DISTINCT gene)) AS genes FROM p WHERE gene IS NOT NULL GROUP BY 1),
  e AS (SELECT doc, id, count(*) OVER (PARTITION BY doc ORDER BY id) - 1 AS n FROM o WHERE pr NOT LIKE '5%')
  SELECT 'D' || doc AS doc, 'n' || o.id AS node, CASE WHEN st = 'O' THEN 'map' ELSE 'gene' END AS kind, (o.id % 100 + 10)::DOUBLE AS x,
    CASE WHEN st = 'O' THEN '' ELSE coalesce(array_to_string(genes, ','), '') END AS genes,
    CASE WHEN e.n IS NOT NULL THEN 'e' || e.n END AS edge, CASE WHEN pr LIKE '1%' THEN 'tee' ELSE 'triangle' END AS arrow,
    st = 'F' AND e.n IS NOT NULL AS in_focus
  FROM o LEFT JOIN g USING (id) LEFT JOIN e USING (doc, id)""")
def layout_drawing(t: Tables) -> DataFrame:
    """Customers as documents: their orders are entities made of lines (later shipped ones below the first), each with a
    reaction; the lowest priority has none. Parts and suppliers are gene names, a third and a half of which resolve."""
    box = F.struct((F.col("id") % 100).alias("x"), F.lit(0).alias("y"), F.lit(20).alias("width"), F.lit(10).alias("height"))
    o = t.orders.select(tag("D", "o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    wire = F.struct(F.when(F.col("pr").startswith("5"), -1).otherwise(F.col("id")).alias("edgeId"), F.when(F.col("pr").startswith("1"), "INHIBITOR").otherwise("OUTPUT").alias("type"))
    entity = F.struct("id", F.col("id").alias("reactomeId"), F.when(F.col("st") == "O", "ProcessNode").otherwise("Complex").alias("renderableClass"), box.alias("prop"),
                      F.array(wire).alias("connectors"))
    reaction = F.struct("id", F.col("id").alias("reactomeId"), F.struct(F.lit(1).alias("x"), F.lit(1).alias("y")).alias("position"))
    names = F.array(tag("PART", "l_partkey"), tag("SUPP", "l_suppkey"))
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(names)).alias("names"))
    made = made.select("id", F.transform("names", lambda x, i: F.struct(((F.col("id") + (1 << 30)) * 1000 + i).alias("dbId"), x.alias("geneNames"))).alias("lines"))
    # the first line stands for the order's own part, the others are parts of that part
    first = F.struct(F.col("lines")[0]["dbId"].alias("dbId"), F.col("lines")[0]["geneNames"].alias("geneNames"),
                     F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x["dbId"]).alias("children"))
    rest = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.struct(x["dbId"].alias("dbId"), x["geneNames"].alias("geneNames"), F.array().cast("array<bigint>").alias("children")))
    own = F.struct(F.col("id").alias("dbId"), F.array().cast("array<string>").alias("geneNames"), F.array(F.col("lines")[0]["dbId"]).alias("children"))
    parts = o.select("doc", "id", "st").join(made, "id", "left").groupBy("doc").agg(
        F.flatten(F.collect_list(F.concat(F.array(own, first), rest))).alias("nodes"),
        F.array(F.struct(F.lit("focus").alias("stId"), F.collect_list(F.when(F.col("st") == "F", F.col("id"))).alias("events"))).alias("subpathways"))
    layout = o.groupBy("doc").agg(F.array_sort(F.collect_list(entity)).alias("nodes"), F.collect_list(F.when(~F.col("pr").startswith("5"), reaction)).alias("edges"))
    docs = layout.select("doc", F.to_json(F.struct("nodes", "edges")).alias("layout")).join(
        parts.select("doc", F.to_json(F.struct("nodes", "subpathways")).alias("parts")), "doc")
    drawn = layouts.layout_drawing(docs, _map_lookup(t))
    rows = drawn.select("doc", "edges", F.get(F.map_values("subpathways"), F.lit(0)).alias("focus"), F.explode("nodes").alias("n")).where("n.kind <> 'reaction'")
    edge = F.get(F.filter("edges", lambda e: (e["source"] == F.col("n.id")) | (e["target"] == F.col("n.id"))), F.lit(0))
    arrow = F.coalesce(edge["arrow"], F.lit("triangle"))
    return rows.select("doc", F.col("n.id").alias("node"), "n.kind", "n.x", F.array_join("n.genes", ",").alias("genes"), edge["id"].alias("edge"), arrow.alias("arrow"),
                       F.coalesce(F.array_contains("focus", F.col("n.id")), F.lit(False)).alias("in_focus"))


# Orders as pathway maps: lines are nodes, neighbours are related by return flag, the first two make a complex. Parts whose
# number 3 divides and suppliers with an even number are genes.
_MAPS = """WITH ln AS (SELECT l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
    l_returnflag AS flag, l_partkey AS pk, l_suppkey AS sk FROM lineitem),
  g AS (SELECT ok, rn, 'PART' || pk AS gene FROM ln WHERE pk % 3 = 0 UNION SELECT ok, rn, 'SUPP' || sk FROM ln WHERE sk % 2 = 0)"""


def _map_lines(t: Tables) -> DataFrame:
    """(ok, nodes): the lines of each order in order, as structs (rn, flag, part, supp)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(F.concat(F.lit("M"), F.col("l_orderkey").cast("string")).alias("doc"), F.transform("lines", lambda x, i: F.struct(
        (i + 1).cast("string").alias("rn"), x["l_returnflag"].alias("flag"), F.concat(F.lit("PART"), x["l_partkey"].cast("string")).alias("part"),
        F.concat(F.lit("SUPP"), x["l_suppkey"].cast("string")).alias("supp"))).alias("nodes"))


def _map_lookup(t: Tables) -> DataFrame:
    ids = t.part.where("p_partkey % 3 = 0").select(tag("PART", "p_partkey").alias("key")).union(t.supplier.where("s_suppkey % 2 = 0").select(tag("SUPP", "s_suppkey")))
    return lookup_table(ids.select("key", F.col("key").alias("symbol"), F.lit("exact").alias("kind"), F.lit(0).alias("prio"), F.lit(0).cast("bigint").alias("pos")))


def _xml(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(found: Column) -> Column:
    return F.array_join(found, "")


@query("kgml_pairs", f"""{_MAPS},
  rel AS (SELECT a.ok, a.gene AS gene_a, b.gene AS gene_b, CASE flag WHEN 'R' THEN 'PPrel' WHEN 'A' THEN 'ECrel' END AS relation
    FROM ln JOIN g a USING (ok, rn) JOIN g b ON b.ok = ln.ok AND b.rn = ln.rn + 1 WHERE flag <> 'N' AND a.gene <> b.gene),
  grp AS (SELECT DISTINCT ok, gene FROM g WHERE rn <= 2)
  SELECT 'M' || ok AS doc, gene_a, gene_b, relation FROM rel
  UNION SELECT 'M' || a.ok, a.gene, b.gene, 'GPrel' FROM grp a JOIN grp b ON a.ok = b.ok AND a.gene < b.gene""")
def kgml_pairs(t: Tables) -> DataFrame:
    entry = F.transform("nodes", lambda n: _xml('<entry id="', n["rn"], '" type="gene" name="x:', n["part"], " x:", n["supp"], '"/>'))
    group = F.transform(F.slice("nodes", 1, 2), lambda n: _xml('<component id="', n["rn"], '"/>'))
    wired = F.transform(F.slice("nodes", F.lit(1), F.size("nodes") - 1), lambda n: _xml(
        '<relation entry1="', n["rn"], '" entry2="', (n["rn"].cast("int") + 1).cast("string"), '" type="',
        F.when(n["flag"] == "R", "PCrel").when(n["flag"] == "A", "ECrel").otherwise("maplink"), '"/>'))
    docs = _map_lines(t).select("doc", _xml("<pathway>", _joined(entry), '<entry id="g" type="group" name="undefined">', _joined(group), "</entry>",
                                            _joined(wired), "</pathway>").alias("xml"))
    return markup.kgml_pairs(markup.shred(docs, markup.KGML), _map_lookup(t))


@query("gpml_pairs", f"""{_MAPS},
  n AS (SELECT ok, rn, flag, CASE WHEN pk % 3 = 0 THEN 'PART' || pk WHEN sk % 2 = 0 THEN 'SUPP' || sk END AS gene FROM ln),
  m AS (SELECT DISTINCT ok, gene FROM n WHERE rn <= 2 AND gene IS NOT NULL),
  rel AS (SELECT a.ok, a.gene AS gene_a, b.gene AS gene_b, CASE a.flag WHEN 'R' THEN 'ECrel' WHEN 'A' THEN 'GErel' ELSE 'PPrel' END AS relation
    FROM n a JOIN n b ON a.ok = b.ok AND b.rn = a.rn + 1 WHERE a.gene <> b.gene
    UNION SELECT a.ok, a.gene, m.gene, 'PPrel' FROM n a JOIN m USING (ok) WHERE a.rn = 3 AND a.gene <> m.gene)
  SELECT 'M' || ok AS doc, gene_a, gene_b, relation FROM rel
  UNION SELECT 'M' || a.ok, a.gene, b.gene, 'GPrel' FROM m a JOIN m b ON a.ok = b.ok AND a.gene < b.gene""")
def gpml_pairs(t: Tables) -> DataFrame:
    node = F.transform("nodes", lambda n: _xml('<DataNode Type="GeneProduct" GraphId="', n["rn"], '" TextLabel="', n["supp"], '"',
                                               F.when(n["rn"].isin("1", "2"), ' GroupRef="g"').otherwise(""), '><Xref ID="', n["part"], '"/></DataNode>'))
    line = lambda a, b, head: _xml('<Interaction><Graphics><Point GraphRef="', a, '"/><Point GraphRef="', b, '" ArrowHead="', head, '"/></Graphics></Interaction>')
    wired = F.transform(F.slice("nodes", F.lit(1), F.size("nodes") - 1), lambda n: line(
        n["rn"], (n["rn"].cast("int") + 1).cast("string"), F.when(n["flag"] == "R", "mim-conversion").when(n["flag"] == "A", "TranscriptionTranslation").otherwise("Arrow")))
    docs = _map_lines(t).select("doc", _xml('<Pathway xmlns="http://pathvisio.org/GPML/2013a">', _joined(node), _joined(wired), line("3", "gg", "Arrow"),
                                            '<Group GroupId="g" GraphId="gg"/></Pathway>').alias("xml"))
    return markup.gpml_pairs(markup.shred(docs, markup.GPML), _map_lookup(t))


@query("read_split_genes", """SELECT n_name AS organism, 'C' || c_custkey AS symbol, c_custkey::VARCHAR AS gene_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_regionkey = 1""")
def read_split_genes(t: Tables) -> DataFrame:
    """A shared gene file, split by taxon once; the genes of some organisms are read from their own folders."""
    rows = t.customer.select(tag("9", "c_nationkey").alias("#tax_id"), c("c_custkey").alias("GeneID"), tag("C", "c_custkey").alias("Symbol"))
    folder = _path(t)
    D.split_gene_info(t.spark, table_of(t, rows), folder)
    wanted = t.nation.where("n_regionkey = 1").select(tag("9", "n_nationkey").alias("tax_id"), F.col("n_name").alias("organism"))
    return D.of_taxa(t.spark, folder, "tax_id", wanted).select("organism", F.col("Symbol").alias("symbol"), F.col("GeneID").alias("gene_id"))
