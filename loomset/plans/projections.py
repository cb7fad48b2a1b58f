"""The driver's tables read as a gene-set domain.

Suppliers are gene sets of parts, customers are sets with wiring (part, supplier) pairs, order lines are
interaction evidence, order -> customer -> nation is the ontology, part names are pathway names of brands.
Every projection is row-wise or an aggregate: no rows of a group are paired with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.unify import Pathways
from ..operators.vocabulary import known_codes, united


class Tables:
    """Lazy reader of the parquet tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def supplier_gene(t: Tables) -> DataFrame:
    """set_gene: the parts a supplier ships; sources are the return flags of the lines."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("gene"), "l_returnflag")
    return united(rows, ["set_id", "gene"], {"sources": F.col("l_returnflag")})


def supplier_set(t: Tables) -> DataFrame:
    """gset: suppliers; Asian ones form the collection ``pathway``, others ``REGION:NATION``."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("set_id"), F.col("s_name").alias("name"),
        F.when(F.col("r_name") == "ASIA", "pathway").otherwise(F.concat_ws(":", "r_name", "n_name")).alias("collection"))


def big_parts(t: Tables) -> DataFrame:
    return t.part.where("p_size >= 45").select(F.col("p_partkey").alias("gene"))


def background_parts(t: Tables) -> DataFrame:
    return t.part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("gene"))


def revenue_ranking(t: Tables) -> DataFrame:
    """ranking: parts by revenue against the price list."""
    sold = t.lineitem.groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return sold.select(F.col("l_partkey").alias("gene"), (F.col("v") / 10000 - 60).alias("score"),
                       F.col("l_partkey").alias("input_pos"))


def part_gene(c: str):
    return F.concat(F.lit("P"), F.col(c).cast("string"))


def supp_gene(c: str):
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def customer_lines(t: Tables) -> DataFrame:
    """The order lines of customers: set_id, p, s, l_returnflag, l_linestatus. Genes go through the join as numbers."""
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("set_id"), part_gene("l_partkey").alias("p"), supp_gene("l_suppkey").alias("s"), "l_returnflag", "l_linestatus")


def customer_pair(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """set_pair: the (part, supplier) pairs of a customer's order lines."""
    relation = F.when(F.col("l_linestatus") == "F", "PPrel").otherwise("GPrel")
    rows = (customer_lines(t) if lines is None else lines).select(
        "set_id", F.col("p").alias("gene_a"), F.col("s").alias("gene_b"), relation.alias("relation"), "l_returnflag")
    return united(rows, ["set_id", "gene_a", "gene_b"], {"relations": F.col("relation"), "sources": F.col("l_returnflag")},
                  codes={"relations": ["GPrel", "PPrel"], "sources": known_codes(t.lineitem, "l_returnflag")})


def customer_gene(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    rows = (customer_lines(t) if lines is None else lines).select("set_id", "l_returnflag", F.explode(F.array("p", "s")).alias("gene"))
    return united(rows, ["set_id", "gene"], {"sources": F.col("l_returnflag")}, codes={"sources": known_codes(t.lineitem, "l_returnflag")})


def customer_set(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("set_id"), F.col("c_name").alias("name"),
                             F.lit("pathway").alias("collection"))


def pair_query(t: Tables) -> DataFrame:
    return t.part.where("p_size >= 30").select(part_gene("p_partkey").alias("gene")).union(
        t.supplier.where("s_acctbal > 0").select(supp_gene("s_suppkey")))


def line_feed(t: Tables) -> DataFrame:
    """Interaction rows: order lines tie a part to a supplier; the order is the publication."""
    return t.lineitem.select(
        F.lit("lines").alias("feed"), part_gene("l_partkey").alias("id_a"), supp_gene("l_suppkey").alias("id_b"),
        F.col("l_returnflag").alias("source"), F.col("l_orderkey").cast("string").alias("pmid"),
        F.col("l_linestatus").alias("method"), (F.col("l_quantity") * 20).cast("int").alias("score"))


def _order_status(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws(":", F.lit("OS"), "l_orderkey", "l_linestatus").alias("os"), "l_orderkey", "l_partkey", "l_returnflag")


def order_terms(t: Tables) -> DataFrame:
    """term rows of the ontology: order lines by status, orders, customers, nations."""
    term = lambda df, c, ns: df.select(c.alias("term")).distinct().select(
        "term", F.col("term").alias("name"), F.lit(ns).alias("namespace"))
    key = lambda p, c: F.concat_ws(":", F.lit(p), F.col(c).cast("string"))
    return term(_order_status(t), F.col("os"), "biological_process") \
        .union(term(t.orders, key("O", "o_orderkey"), "biological_process")) \
        .union(term(t.customer, key("C", "c_custkey"), "biological_process")) \
        .union(term(t.nation, key("N", "n_nationkey"), "molecular_function"))


def order_edges(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat_ws(":", F.lit(p), F.col(c).cast("string"))
    up = _order_status(t).select(F.col("os").alias("child"), key("O", "l_orderkey").alias("parent")).distinct()
    return up.union(t.orders.select(key("O", "o_orderkey"), key("C", "o_custkey"))) \
        .union(t.customer.select(key("C", "c_custkey"), key("N", "c_nationkey")))


def order_annotation(t: Tables) -> DataFrame:
    return _order_status(t).select(F.col("os").alias("term"), F.col("l_partkey").alias("gene"),
                                   F.col("l_returnflag").alias("evidence"))


def order_sets(t: Tables, by_status: bool, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(gset, set_gene) of orders, or of orders split by line status, with at least ``min_size`` parts."""
    status = [F.col("l_linestatus")] if by_status else []
    name = F.concat_ws(" ", F.lit("Order"), F.col("l_orderkey").cast("string"), *status)
    gene = t.lineitem.select(name.alias("set_id"), F.col("l_partkey").alias("gene")).distinct()
    keep = gene.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("set_id")
    return keep.withColumn("name", F.col("set_id")), gene.join(keep, "set_id")


def brand_pathways(t: Tables) -> Pathways:
    """Pathways: a brand's products by name and type; genes are their suppliers."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type"))
    part = t.part.select(F.col("p_brand").alias("source"), name.alias("name"), "p_partkey")
    pathway = part.groupBy("source", "name").agg(F.min("p_partkey").alias("pos")).select(
        "source", "name", F.lit("").alias("source_id"), "pos")
    lines = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    gene = lines.select("source", "name", supp_gene("l_suppkey").alias("gene")).distinct()
    pair = lines.select("source", "name", supp_gene("l_suppkey").alias("gene_a"), part_gene("l_partkey").alias("gene_b"),
                        F.when(F.col("l_linestatus") == "F", "PPrel").otherwise("GErel").alias("relation")).distinct()
    return Pathways(pathway, gene, pair, None)


def part_aliases(t: Tables) -> DataFrame:
    """alias rows: part code exact, brand + name previous, name alias (shared by many parts)."""
    row = lambda key, kind: t.part.select(
        F.upper(key).alias("key"), part_gene("p_partkey").alias("symbol"), F.lit(kind).alias("kind"),
        F.lit(0).alias("prio"), F.col("p_partkey").cast("long").alias("pos"))
    return row(part_gene("p_partkey"), "exact").union(row(F.concat_ws(" ", "p_brand", "p_name", "p_type"), "previous")) \
        .union(row(F.concat_ws(" ", "p_name", "p_type"), "alias"))


def alias_idents(t: Tables) -> DataFrame:
    """Identifiers to resolve, as they might be typed: codes, isoforms, prefixed ids, names and unknown ids."""
    part, line = t.part, t.lineitem
    return line.select(F.concat(F.lit(" p"), "l_partkey", F.lit(" ")).alias("ident")) \
        .union(line.select(F.concat(F.lit("P"), "l_partkey", F.lit("-"), "l_linenumber"))) \
        .union(line.select(F.concat(F.lit("UniProtKB:P"), "l_orderkey"))) \
        .union(part.select(F.concat_ws(" ", "p_brand", "p_name", "p_type"))) \
        .union(part.select(F.concat_ws(" ", "p_name", F.lower("p_type"))))


def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"))
