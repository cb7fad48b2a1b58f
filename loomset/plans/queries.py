"""Registered queries: every operator run on the driver's tables, with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import stable_id
from ..operators import catalogue, enrich, graph, identifiers, matching, network, ontology, ordered, ranked, subgraph, themes, unify
from ..session import cut
from ..sources import pathways, release
from . import projections as P
from . import source_queries
from .projections import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def joined(c: str):
    return F.array_join(c, ",")


# ---------------------------------------------------------------- SQL pieces shared by several oracles
SUPPLIER_GENE = """sg AS (SELECT l_suppkey AS set_id, l_partkey AS gene, count(DISTINCT l_returnflag) AS ns
  FROM lineitem GROUP BY 1, 2)"""
SUPPLIER_SET = """gs AS (SELECT s_suppkey AS set_id, s_name AS name,
  CASE WHEN r_name = 'ASIA' THEN 'pathway' ELSE r_name || ':' || n_name END AS collection
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tail_sql(k: str, pop: str, succ: str, draws: str) -> str:
    choose = lambda n, r: f"(lgamma(({n})+1)-lgamma(({r})+1)-lgamma(({n})-({r})+1))"
    term = f"exp({choose(succ, 'i')}+{choose(f'{pop}-{succ}', f'{draws}-i')}-{choose(pop, draws)})"
    return (f"CASE WHEN greatest({k},0,{draws}-({pop}-{succ}))=0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform("
            f"range(greatest({k},0,{draws}-({pop}-{succ})), least({succ},{draws})+1), lambda i: {term})), 0.0)) END")


def bh_sql(src: str) -> str:
    """CTEs that add fdr to relation ``src`` (column p)."""
    return f"""rk AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, set_id) AS raw FROM {src}),
  adj AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC, set_id DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM rk)"""


def ora_sql(members: str, wanted: str, background: str | None, min_overlap: int = 2) -> str:
    cut_bg = f"WHERE gene IN (SELECT gene FROM ({background}))" if background else ""
    return f"""mem AS (SELECT * FROM ({members}) {cut_bg}),
  q AS ({wanted}), uni AS (SELECT DISTINCT gene FROM mem),
  pop AS (SELECT count(*) AS pop, count(*) FILTER (WHERE gene IN (SELECT gene FROM q)) AS draws FROM uni),
  cnt AS (SELECT set_id, count(*) AS set_size, count(*) FILTER (WHERE gene IN (SELECT gene FROM q)) AS overlap,
    count(*) FILTER (WHERE gene IN (SELECT gene FROM q) AND ns >= 2) AS sup FROM mem GROUP BY 1),
  sc AS (SELECT cnt.*, pop, draws, {tail_sql('overlap', 'pop', 'set_size', 'draws')} AS p FROM cnt, pop
    WHERE set_size BETWEEN 5 AND 2000 AND overlap >= {min_overlap}),
  {bh_sql('sc')}"""


ORA_OUT = """SELECT set_id, name, collection, set_size, overlap, pop, draws,
  round(draws * set_size / pop, 6) AS expected, round((overlap / draws) / (set_size / pop), 6) AS fold,
  round(p, 6) AS p, round(fdr, 6) AS fdr,
  CASE WHEN collection = 'pathway' THEN round(sup / overlap, 6) END AS consensus FROM adj JOIN gs USING (set_id)"""


def _ora_out(df: DataFrame) -> DataFrame:
    return df.select("set_id", "name", "collection", "set_size", "overlap", "pop", "draws",
                     F.round("expected", 6).alias("expected"), F.round("fold", 6).alias("fold"),
                     F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"), F.round("consensus", 6).alias("consensus"))


BIG = "SELECT p_partkey AS gene FROM part WHERE p_size >= 45"


# ---------------------------------------------------------------- over-representation
@query("ora_basic", f"WITH {SUPPLIER_GENE}, {SUPPLIER_SET}, {ora_sql('SELECT * FROM sg', BIG, None)} {ORA_OUT}")
def ora_basic(t: Tables) -> DataFrame:
    return _ora_out(enrich.ora(P.big_parts(t), P.supplier_set(t), cut(P.supplier_gene(t))))


@query("ora_background", f"WITH {SUPPLIER_GENE}, {SUPPLIER_SET}, "
       + ora_sql("SELECT * FROM sg", BIG, "SELECT p_partkey AS gene FROM part WHERE p_type <> 'ECONOMY'") + f" {ORA_OUT}")
def ora_background(t: Tables) -> DataFrame:
    return _ora_out(enrich.ora(P.big_parts(t), P.supplier_set(t), cut(P.supplier_gene(t)), background=P.background_parts(t)))


_PICK = ("SELECT * FROM sg WHERE set_id IN (SELECT set_id FROM gs WHERE collection IN ('AMERICA','pathway') "
         "OR starts_with(collection, 'AMERICA:') OR starts_with(collection, 'pathway:'))")


@query("ora_collection_prefix", f"WITH {SUPPLIER_GENE}, {SUPPLIER_SET}, {ora_sql(_PICK, BIG, None)} {ORA_OUT}")
def ora_collection_prefix(t: Tables) -> DataFrame:
    return _ora_out(enrich.ora(P.big_parts(t), P.supplier_set(t), cut(P.supplier_gene(t)), collections=["AMERICA", "pathway"]))


@query("ora_hit_genes", f"WITH {SUPPLIER_GENE}, {SUPPLIER_SET}, {ora_sql('SELECT * FROM sg', BIG, None)} "
       "SELECT set_id, overlap, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS genes FROM adj JOIN sg USING (set_id) "
       "JOIN q USING (gene) WHERE fdr <= 0.9 GROUP BY 1, 2")
def ora_hit_genes(t: Tables) -> DataFrame:
    sets, member = P.supplier_set(t), cut(P.supplier_gene(t))
    found = enrich.significant(enrich.ora(P.big_parts(t), sets, member), 0.9)
    return enrich.with_genes(found, enrich.ora_hits(found, P.big_parts(t), member)).select(
        "set_id", "overlap", joined("genes").alias("genes"))


CUSTOMER_PAIR = """cp AS (SELECT DISTINCT o_custkey AS set_id, 'P' || l_partkey AS gene_a, 'S' || l_suppkey AS gene_b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAIR_QUERY = """q AS (SELECT 'P' || p_partkey AS gene FROM part WHERE p_size >= 30
  UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)"""
EDGE = """edge AS (SELECT 'P' || l_partkey AS gene_a, 'S' || l_suppkey AS gene_b,
  string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources, count(DISTINCT l_returnflag) AS n_sources,
  count(DISTINCT l_orderkey) AS n_pmids, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS methods,
  max(CAST(l_quantity * 20 AS INT)) AS string_score,
  count(DISTINCT CASE WHEN l_returnflag IN ('A','R') THEN l_returnflag END) AS n_exp FROM lineitem GROUP BY 1, 2),
  tiered AS (SELECT *, CASE WHEN n_exp >= 2 OR n_pmids >= 2 OR string_score >= 900 THEN 'high'
    WHEN n_exp >= 1 OR string_score >= 700 THEN 'medium' ELSE 'low' END AS tier FROM edge)"""
EXPERIMENTAL = ("A", "R")


def _pair_sql(pairs: str) -> str:
    return f"""pr AS ({pairs}), ok AS (SELECT set_id, count(*) AS set_pairs FROM pr GROUP BY 1 HAVING count(*) >= 5),
  qp AS (SELECT pr.*, set_pairs, gene_a IN (SELECT gene FROM q) AND gene_b IN (SELECT gene FROM q) AS hit FROM pr JOIN ok USING (set_id)),
  pop AS (SELECT count(DISTINCT (gene_a, gene_b)) AS pop, count(DISTINCT (gene_a, gene_b)) FILTER (WHERE hit) AS draws FROM qp),
  cnt AS (SELECT set_id, any_value(set_pairs) AS set_pairs, count(*) FILTER (WHERE hit) AS overlap_pairs FROM qp GROUP BY 1),
  sc AS (SELECT cnt.*, pop, draws, {tail_sql('overlap_pairs', 'pop', 'set_pairs', 'draws')} AS p FROM cnt, pop WHERE overlap_pairs >= 1),
  {bh_sql('sc')}
  SELECT set_id, set_pairs, overlap_pairs, pop, draws, round(draws * set_pairs / pop, 6) AS expected,
    round(p, 6) AS p, round(fdr, 6) AS fdr FROM adj"""


def _pair_out(df: DataFrame) -> DataFrame:
    return df.select("set_id", "set_pairs", "overlap_pairs", "pop", "draws", F.round("expected", 6).alias("expected"),
                     F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


@query("pair_ora", f"WITH {CUSTOMER_PAIR}, {PAIR_QUERY}, {_pair_sql('SELECT * FROM cp')}")
def pair_ora(t: Tables) -> DataFrame:
    return _pair_out(enrich.pair_ora(P.pair_query(t), P.customer_set(t), P.customer_pair(t)))


CUSTOMER_GENE = """cg AS (SELECT set_id, gene_a AS gene FROM cp UNION SELECT set_id, gene_b FROM cp)"""
_INNER = """SELECT a.set_id, e.gene_a, e.gene_b FROM (SELECT * FROM tiered WHERE tier = 'high') e
  JOIN cg a ON a.gene = e.gene_a JOIN cg b ON b.gene = e.gene_b AND b.set_id = a.set_id"""


@query("pair_ora_with_edges", f"WITH {CUSTOMER_PAIR}, {PAIR_QUERY}, {EDGE}, {CUSTOMER_GENE}, "
       + _pair_sql(f"SELECT * FROM cp UNION {_INNER}"))
def pair_ora_with_edges(t: Tables) -> DataFrame:
    edges, lines = cut(network.up_to_tier(_edges(t), "high")), cut(P.customer_lines(t))
    return _pair_out(enrich.pair_ora(P.pair_query(t), P.customer_set(t), P.customer_pair(t, lines),
                                     set_gene=cut(P.customer_gene(t, lines).select("set_id", "gene")), edges=edges))


@query("edges_within_sets", f"WITH {CUSTOMER_PAIR}, {EDGE}, {CUSTOMER_GENE}, w AS ({_INNER}) "
       "SELECT set_id, count(*) AS n_edges, min(gene_a || '-' || gene_b) AS first_edge FROM w GROUP BY 1")
def edges_within_sets(t: Tables) -> DataFrame:
    edges = cut(network.up_to_tier(_edges(t), "high"))
    return enrich.edges_within_sets(edges, cut(P.customer_gene(t).select("set_id", "gene"))).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min(F.concat_ws("-", "gene_a", "gene_b")).alias("first_edge"))


# ---------------------------------------------------------------- interaction evidence
def _edges(t: Tables) -> DataFrame:
    feed = P.line_feed(t)
    return network.integrate(network.map_feed(feed, None), EXPERIMENTAL, feed)


@query("edge_evidence", f"WITH {EDGE} SELECT gene_a, gene_b, sources, n_sources, n_pmids, methods, string_score, tier FROM tiered")
def edge_evidence(t: Tables) -> DataFrame:
    return _edges(t).select("gene_a", "gene_b", joined("sources").alias("sources"), "n_sources", "n_pmids",
                            joined("methods").alias("methods"), "string_score", "tier")


@query("edge_overlay", f"WITH {EDGE}, {CUSTOMER_PAIR}, s AS (SELECT gene_a, gene_b, count(*) AS n_sets, min(set_id) AS first_set "
       "FROM cp WHERE (gene_a, gene_b) IN (SELECT (gene_a, gene_b) FROM tiered WHERE tier = 'high') GROUP BY 1, 2) "
       "SELECT * FROM s")
def edge_overlay(t: Tables) -> DataFrame:
    high = network.up_to_tier(_edges(t), "high")
    return network.overlay(high, P.customer_pair(t)).groupBy("gene_a", "gene_b").agg(
        F.count(F.lit(1)).alias("n_sets"), F.min("set_id").alias("first_set"))


@query("edge_summary", f"""WITH {EDGE}, pairs AS (SELECT DISTINCT 'P' || l_partkey AS gene_a, 'S' || l_suppkey AS gene_b FROM lineitem)
  SELECT 'edges' AS metric, '' AS key, count(*) AS n FROM tiered
  UNION ALL SELECT 'edges_by_tier', tier, count(*) FROM tiered GROUP BY tier
  UNION ALL SELECT 'edges_per_source', s, count(*) FROM (SELECT unnest(string_split(sources, ',')) AS s FROM tiered) GROUP BY s
  UNION ALL SELECT 'edges_by_n_sources', n_sources::VARCHAR, count(*) FROM tiered GROUP BY n_sources
  UNION ALL SELECT 'genes', '', count(*) FROM (SELECT gene_a FROM tiered UNION SELECT gene_b FROM tiered)
  UNION ALL SELECT 'pathway_supported_edges', '', count(*) FROM tiered JOIN pairs USING (gene_a, gene_b)""")
def edge_summary(t: Tables) -> DataFrame:
    edges = _edges(t)
    pairs = t.lineitem.select(
        F.lit("x").alias("set_id"), P.part_gene("l_partkey").alias("gene_a"), P.supp_gene("l_suppkey").alias("gene_b"))
    return network.summary(cut(network.with_overlay(edges, network.overlay(edges, pairs))))


@query("feed_report", """WITH r AS (SELECT l_partkey AS a, l_orderkey AS b, pa.p_partkey AS ga, pb.p_partkey AS gb FROM lineitem
    LEFT JOIN part pa ON l_partkey = pa.p_partkey LEFT JOIN part pb ON l_orderkey = pb.p_partkey)
  SELECT 'codes' AS feed, count(*) AS rows, count(*) FILTER (WHERE ga IS NOT NULL AND gb IS NOT NULL AND ga <> gb) AS mapped_rows,
    (SELECT count(*) FROM (SELECT a AS i FROM r WHERE ga IS NULL UNION SELECT b FROM r WHERE gb IS NULL)) AS unmapped_ids FROM r""")
def feed_report(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.lit("codes").alias("feed"), P.part_gene("l_partkey").alias("id_a"),
                             P.part_gene("l_orderkey").alias("id_b"))
    return network.feed_report(network.map_feed(rows, identifiers.lookup_table(P.part_aliases(t))))


# ---------------------------------------------------------------- ranked enrichment
RANKED = """rv AS (SELECT l_partkey AS gene, sum(l_extendedprice * (1 - l_discount)) / 10000 - 60 AS score FROM lineitem GROUP BY 1),
  rk AS (SELECT gene, abs(score) AS w, row_number() OVER (ORDER BY score DESC, gene) - 1 AS pos FROM rv),
  ng AS (SELECT count(*) AS n FROM rk),
  mem AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS gene FROM lineitem),
  sz AS (SELECT set_id, count(*) AS k FROM mem JOIN rk USING (gene) GROUP BY 1 HAVING count(*) BETWEEN 15 AND 2000),
  h AS (SELECT set_id, gene, pos, w, k, row_number() OVER (PARTITION BY set_id ORDER BY pos) - 1 AS j,
    sum(w) OVER (PARTITION BY set_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY set_id) AS share,
    w / sum(w) OVER (PARTITION BY set_id) AS own FROM mem JOIN rk USING (gene) JOIN sz USING (set_id)),
  r AS (SELECT *, share - (pos - j) / greatest(n - k, 1) AS top, share - own - (pos - j) / greatest(n - k, 1) AS bottom FROM h, ng),
  x AS (SELECT set_id, any_value(k) AS k, max(top) AS hi, arg_max(j, top) AS jhi, min(bottom) AS lo, arg_min(j, bottom) AS jlo FROM r GROUP BY 1),
  es AS (SELECT set_id, k, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS es,
    CASE WHEN abs(hi) >= abs(lo) THEN jhi ELSE jlo END AS peak FROM x)"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    rank = cut(ranked.rank_genes(P.revenue_ranking(t)))
    member = t.lineitem.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("gene")).distinct()
    return rank, ranked.running_sum(ranked.ranked_hits(rank, P.supplier_set(t), member, max_size=2000), F.lit(rank.count()))


@query("gsea_observed_es", f"WITH {RANKED} SELECT set_id, k, round(es, 6) AS es, peak FROM es")
def gsea_observed_es(t: Tables) -> DataFrame:
    return ranked.observed(_ranked(t)[1]).select("set_id", "k", F.round("es", 6).alias("es"), F.col("peak").cast("long").alias("peak"))


@query("gsea_leading_edge", f"WITH {RANKED} SELECT set_id, count(*) AS n_lead, min(gene) AS first_gene, sum(gene)::BIGINT AS gene_sum "
       "FROM r JOIN es USING (set_id) WHERE CASE WHEN es >= 0 THEN j <= peak ELSE j >= peak END GROUP BY 1")
def gsea_leading_edge(t: Tables) -> DataFrame:
    sums = _ranked(t)[1]
    return ranked.leading_edge(sums, ranked.observed(sums)).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_lead"), F.min("gene").alias("first_gene"), F.sum("gene").alias("gene_sum"))


NULL = f"""{RANKED}, dk AS (SELECT DISTINCT k FROM es),
  pr AS (SELECT perm, pos, w, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || gene)) - 1 AS i FROM rk, range(200) AS t(perm)),
  nl AS (SELECT k, perm, pos, w FROM pr JOIN dk ON i < k),
  nh AS (SELECT k, perm, pos, w / sum(w) OVER (PARTITION BY k, perm) AS own, row_number() OVER (PARTITION BY k, perm ORDER BY pos) - 1 AS j,
    sum(w) OVER (PARTITION BY k, perm ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY k, perm) AS share FROM nl),
  nx AS (SELECT k, perm, max(share - (pos - j) / greatest(n - k, 1)) AS hi, min(share - own - (pos - j) / greatest(n - k, 1)) AS lo FROM nh, ng GROUP BY 1, 2),
  nu AS MATERIALIZED (SELECT k, perm, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS es FROM nx),
  sm AS (SELECT k, nullif(coalesce(avg(es) FILTER (es >= 0), 1), 0) AS up, count(*) FILTER (es >= 0) AS n_up,
    nullif(coalesce(abs(avg(es) FILTER (es < 0)), 1), 0) AS down, count(*) FILTER (es < 0) AS n_down FROM nu GROUP BY 1),
  bc AS (SELECT e.set_id, count(*) AS c FROM es e JOIN nu ON nu.k = e.k AND (nu.es < 0) = (e.es < 0) AND abs(nu.es) >= abs(e.es) GROUP BY 1),
  pt AS MATERIALIZED (SELECT set_id, k, e.es, (coalesce(c, 0) + 1) / (CASE WHEN e.es >= 0 THEN n_up ELSE n_down END + 1) AS p,
    round(coalesce(e.es / CASE WHEN e.es >= 0 THEN up ELSE down END, 0), 4) AS nes FROM es e JOIN sm USING (k) LEFT JOIN bc USING (set_id)),
  pv AS MATERIALIZED (SELECT coalesce(nu.es / CASE WHEN nu.es >= 0 THEN up ELSE down END, 0) AS v, sets
    FROM nu JOIN sm USING (k) JOIN (SELECT k, count(*) AS sets FROM es GROUP BY 1) USING (k)),
  ob AS (SELECT DISTINCT nes FROM pt),
  fd AS (SELECT nes, (SELECT coalesce(sum(sets) FILTER (abs(v) >= abs(nes)), 0) / greatest(sum(sets), 1) FROM pv WHERE (v >= 0) = (nes >= 0)) AS nshare,
    (SELECT count(*) FILTER (abs(x.nes) >= abs(ob.nes)) / count(*) FROM pt x WHERE (x.nes >= 0) = (ob.nes >= 0)) AS oshare FROM ob),
  b1 AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, set_id) AS raw FROM pt),
  b2 AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC, set_id DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM b1)"""


@query("gsea_full", f"WITH {NULL} SELECT set_id, k AS set_size, round(es, 6) AS es, nes, round(p, 6) AS p, "
       "round(least(1.0, coalesce(nshare, 0) / oshare), 6) AS fdr, round(padj, 6) AS padj FROM b2 JOIN fd USING (nes)")
def gsea_full(t: Tables) -> DataFrame:
    member = t.lineitem.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("gene")).distinct()
    return ranked.gsea(P.revenue_ranking(t), P.supplier_set(t), member, nperm=200, max_size=2000).select(
        "set_id", "set_size", F.round("es", 6).alias("es"), "nes", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"),
        F.round("padj", 6).alias("padj"))


@query("ranking_positions", "SELECT l_quantity AS quantity, place, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM "
       "(SELECT l_quantity, l_orderkey * 10 + l_linenumber AS place, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) - 1 AS pos "
       "FROM lineitem) GROUP BY 1, 2")
def ranking_positions(t: Tables) -> DataFrame:
    # every line is ranked by quantity: fifty score values, so each is heavily tied; lines with one key share its positions
    lines = t.lineitem.withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ordered.global_position(lines, "l_quantity", "place").groupBy(F.col("l_quantity").alias("quantity"), "place").agg(
        F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.count(F.lit(1)).alias("n"))


@query("bh_adjust", "WITH sc AS (SELECT o_orderkey AS set_id, o_totalprice / (SELECT max(o_totalprice) + 1 FROM orders) "
       "* CASE WHEN o_orderstatus = 'F' THEN 0.001 ELSE 1 END AS p FROM orders), "
       + bh_sql("sc") + " SELECT set_id, round(p, 10) AS p, round(fdr, 10) AS fdr FROM adj")
def bh_adjust(t: Tables) -> DataFrame:
    top = t.orders.agg((F.max("o_totalprice") + 1).alias("m")).scalar()
    p = F.col("o_totalprice") / top * F.when(F.col("o_orderstatus") == "F", 0.001).otherwise(1.0)
    return ordered.benjamini_hochberg(t.orders.select(F.col("o_orderkey").alias("set_id"), p.alias("p"))).select(
        "set_id", F.round("p", 10).alias("p"), F.round("fdr", 10).alias("fdr"))


@query("theme_cluster", "WITH RECURSIVE " + SUPPLIER_GENE + ", " + SUPPLIER_SET + ", "
       + ora_sql("SELECT set_id, gene, ns FROM sg", "SELECT p_partkey AS gene FROM part WHERE p_size >= 45", None) + """,
  h AS (SELECT set_id, name, row_number() OVER (ORDER BY p, overlap DESC, set_id) AS o FROM adj JOIN gs USING (set_id)),
  m AS (SELECT o, gene FROM sg JOIN h USING (set_id)), n AS (SELECT o, count(*) AS n FROM m GROUP BY 1),
  sh AS (SELECT a.o AS early, b.o AS late, count(*) AS k FROM m a JOIN m b USING (gene) WHERE a.o < b.o GROUP BY 1, 2),
  nr AS (SELECT late, list(early) AS e FROM sh JOIN n na ON na.o = early JOIN n nb ON nb.o = late WHERE k / (na.n + nb.n - k) >= 0.13 GROUP BY 1),
  w AS (SELECT o, coalesce(e, []) AS e FROM h LEFT JOIN nr ON late = o),
  g AS (SELECT 0::BIGINT AS o, []::BIGINT[] AS led, 0::BIGINT AS lead UNION ALL
    SELECT w.o, CASE WHEN len(list_intersect(led, e)) = 0 THEN list_append(led, w.o) ELSE led END,
      coalesce(list_min(list_intersect(led, e)), w.o) FROM g JOIN w ON w.o = g.o + 1)
  SELECT h.set_id, list_position(led, lead)::INT AS theme, l.name AS theme_leader FROM g JOIN h USING (o) JOIN h l ON l.o = lead""")
def theme_cluster(t: Tables) -> DataFrame:
    member = cut(P.supplier_gene(t))
    found = enrich.ora(P.big_parts(t), P.supplier_set(t), member)
    return themes.themes(cut(found), member, None, order=[F.asc("p"), F.desc("overlap"), F.asc("set_id")], alpha=1.0,
                         min_jaccard=0.13).select("set_id", "theme", "theme_leader")


# ---------------------------------------------------------------- ontology
TERM_EDGE = """te AS (SELECT DISTINCT 'OS:' || l_orderkey || ':' || l_linestatus AS child, 'O:' || l_orderkey AS parent FROM lineitem
  UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey FROM orders
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer)"""
CLOSURE = f"""{TERM_EDGE}, cl AS (SELECT child, parent AS ancestor, 1 AS depth FROM te
  UNION ALL SELECT cl.child, te.parent, cl.depth + 1 FROM cl JOIN te ON cl.ancestor = te.child)"""
PROPAGATED = f"""{CLOSURE}, ann AS (SELECT DISTINCT 'OS:' || l_orderkey || ':' || l_linestatus AS term, l_partkey AS gene,
    l_returnflag AS ev FROM lineitem),
  pf AS (SELECT term, gene, ev FROM ann UNION SELECT ancestor, gene, ev FROM ann JOIN cl ON child = term)"""


@query("dag_ancestors", f"WITH RECURSIVE {CLOSURE} SELECT child, ancestor, min(depth) AS depth FROM cl GROUP BY 1, 2")
def dag_ancestors(t: Tables) -> DataFrame:
    return graph.ancestors(P.order_edges(t))


@query("true_path_propagation", f"WITH RECURSIVE {PROPAGATED} SELECT term, gene, string_agg(ev, ',' ORDER BY ev) AS evidence FROM pf GROUP BY 1, 2")
def true_path_propagation(t: Tables) -> DataFrame:
    return ontology.propagate(P.order_annotation(t), graph.ancestors(P.order_edges(t))).select(
        "term", "gene", joined("evidence").alias("evidence"))


@query("nearest_drawn_ancestor", f"""WITH RECURSIVE {CLOSURE}, held AS (SELECT 'O:' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'C:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'N:' || n_nationkey FROM nation),
  s AS (SELECT child, ancestor, depth FROM cl UNION ALL SELECT DISTINCT child, child, 0 FROM te)
  SELECT child, arg_min(ancestor, depth) AS ancestor, min(depth) AS depth FROM s JOIN held ON ancestor = node GROUP BY 1""")
def nearest_drawn_ancestor(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat_ws(":", F.lit(p), F.col(c).cast("string"))
    held = t.orders.where("o_orderstatus = 'F'").select(key("O", "o_orderkey").alias("node")) \
        .union(t.customer.where("c_mktsegment = 'BUILDING'").select(key("C", "c_custkey"))) \
        .union(t.nation.select(key("N", "n_nationkey")))
    edges = P.order_edges(t)
    return graph.nearest_holder(edges, held, edges.select(F.col("child").alias("node"))).select(
        F.col("node").alias("child"), F.col("holder").alias("ancestor"), "depth")


@query("identical_set_merge", f"""WITH RECURSIVE {PROPAGATED},
  sz AS (SELECT term, CASE WHEN starts_with(term, 'N:') THEN 'mf' ELSE 'bp' END AS ns, count(*) AS n,
    string_agg(gene::VARCHAR, ',' ORDER BY gene::VARCHAR) AS content FROM (SELECT DISTINCT term, gene FROM pf) GROUP BY 1 HAVING count(*) BETWEEN 3 AND 2000),
  lin AS (SELECT cl.child AS t, cl.ancestor AS o FROM cl JOIN sz a ON a.term = cl.child JOIN sz b ON b.term = cl.ancestor AND a.ns = b.ns AND a.content = b.content),
  dn AS (SELECT greatest(t, o) AS hi, least(t, o) AS lo FROM lin),
  rch AS (SELECT hi, lo FROM dn UNION SELECT rch.hi, dn.lo FROM rch JOIN dn ON rch.lo = dn.hi),
  grp AS (SELECT term, least(term, coalesce(min(lo), term)) AS leader FROM sz LEFT JOIN rch ON hi = term GROUP BY term),
  gen AS (SELECT DISTINCT o AS term FROM lin JOIN grp a ON a.term = t JOIN grp b ON b.term = o AND a.leader = b.leader),
  rep AS (SELECT leader, min(term) AS set_id FROM grp WHERE term NOT IN (SELECT term FROM gen) GROUP BY 1)
  SELECT term, set_id FROM grp JOIN rep USING (leader)""")
def identical_set_merge(t: Tables) -> DataFrame:
    closure = graph.ancestors(P.order_edges(t))
    full = cut(ontology.propagate(P.order_annotation(t), closure))
    return ontology.merge_identical(full, P.order_terms(t), closure, min_size=3)


def lcs_sql(a: str, b: str) -> str:
    """LCS length of two SQL strings: rows of the alignment matrix folded with a running maximum."""
    eq = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: CAST(x = y AS INT)))"
    best = "list_transform(range(1, len(e) + 1), lambda j: greatest(s[j], CASE WHEN j > 1 THEN s[j-1] ELSE 0 END + e[j]))"
    row = f"list_transform(range(1, len(e) + 1), lambda u: list_max(({best})[1:u]))"
    zero = f"list_transform(string_split({b}, ''), lambda z: 0)"
    return f"list_max(list_reduce({eq}, lambda s, e: {row}, {zero}))"


@query("set_similarity_links", f"""WITH ln AS (SELECT DISTINCT l_orderkey AS ok, l_linestatus AS ls, l_partkey AS gene FROM lineitem),
  a AS (SELECT DISTINCT 'Order ' || ok AS set_a, gene FROM ln QUALIFY count(*) OVER (PARTITION BY ok) >= 1),
  sa AS (SELECT set_a, count(*) AS na FROM a GROUP BY 1),
  b AS (SELECT 'Order ' || ok || ' ' || ls AS set_b, gene FROM ln), sb AS (SELECT set_b, count(*) AS nb FROM b GROUP BY 1),
  sh AS (SELECT set_a, set_b, na, nb, count(*) AS k FROM a JOIN sa USING (set_a) JOIN b USING (gene) JOIN sb USING (set_b) GROUP BY 1, 2, 3, 4),
  j AS (SELECT set_a, set_b, k / (na + nb - k) AS jac FROM sh WHERE k / (na + nb - k) >= 0.2),
  al AS (SELECT *, length(set_a) AS x, length(set_b) AS y, CASE WHEN jac >= 0.5 THEN 0 ELSE {lcs_sql('lower(set_a)', 'lower(set_b)')} END AS score FROM j)
  SELECT set_a, set_b, round(jac, 6) AS jaccard FROM al
  WHERE jac >= 0.5 OR ((score > least(x, y) - 1 OR 2.0 * score / (x + y) > 0.91) AND 2.0 * score / (x + y) >= 0.5)""")
def set_similarity_links(t: Tables) -> DataFrame:
    a, ag = P.order_sets(t, False, 1)
    b, bg = P.order_sets(t, True, 1)
    return ontology.link_sets(a, cut(ag), b, cut(bg)).select("set_a", "set_b", F.round("jaccard", 6).alias("jaccard"))


# ---------------------------------------------------------------- names and unification
UNITS = """un AS (SELECT p_brand AS source, p_name || ' ' || lower(p_type) AS name, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
  so AS (SELECT source, min(pos) AS ord FROM un GROUP BY 1), u AS (SELECT un.*, ord FROM un JOIN so USING (source)),
  tx AS (SELECT DISTINCT name FROM un),
  al AS (SELECT a.name AS a, b.name AS b, CASE WHEN a.name = b.name THEN length(a.name) ELSE """ + lcs_sql("a.name", "b.name") + """ END AS score,
    length(a.name) + length(b.name) AS tot FROM tx a JOIN tx b ON 2 * least(length(a.name), length(b.name)) >= 0.5 * (length(a.name) + length(b.name)) AND a.name <= b.name),
  al2 AS (SELECT a, b, score, 2.0 * score / tot AS ratio FROM al UNION SELECT b, a, score, 2.0 * score / tot FROM al),
  cand AS (SELECT x.source AS source_a, x.name AS name_a, y.source AS source_b, y.name AS name_b, score, ratio, y.pos
    FROM u x JOIN al2 ON x.name = al2.a JOIN u y ON y.name = al2.b AND (x.ord < y.ord OR (x.source = y.source AND x.pos < y.pos))),
  top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY source_a, name_a, source_b ORDER BY ratio DESC, pos) = 1),
  hit AS (SELECT source_a, name_a, source_b, name_b, score, ratio FROM top
    WHERE (score > least(length(name_a), length(name_b)) - 1 OR ratio > 0.91) AND ratio >= 0.5)"""


@query("name_best_hit", f"WITH {UNITS} SELECT source_a, name_a, source_b, name_b, score, round(ratio, 6) AS ratio FROM hit")
def name_best_hit(t: Tables) -> DataFrame:
    return matching.best_hits(cut(matching.name_units(P.brand_pathways(t).pathway))).select(
        "source_a", "name_a", "source_b", "name_b", F.col("score").cast("long").alias("score"), F.round("ratio", 6).alias("ratio"))


GENES = """pg AS (SELECT DISTINCT p_brand AS source, p_name || ' ' || lower(p_type) AS name, 'S' || l_suppkey AS gene
  FROM lineitem JOIN part ON l_partkey = p_partkey), gn AS (SELECT source, name, count(*) AS n FROM pg GROUP BY 1, 2)"""
GUARDED = f"""{UNITS}, {GENES},
  ov AS (SELECT h.*, coalesce(k, 0) AS k, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM hit h
    LEFT JOIN (SELECT source_a, name_a, source_b, name_b, count(*) AS k FROM hit JOIN pg p ON p.source = source_a AND p.name = name_a
      JOIN pg q ON q.source = source_b AND q.name = name_b AND q.gene = p.gene GROUP BY 1, 2, 3, 4) s USING (source_a, name_a, source_b, name_b)
    LEFT JOIN gn x ON x.source = source_a AND x.name = name_a LEFT JOIN gn y ON y.source = source_b AND y.name = name_b),
  mt AS (SELECT source_a, name_a, source_b, name_b, score, ratio, CASE WHEN na + nb - k > 0 THEN k / (na + nb - k) ELSE 0 END AS overlap FROM ov
    WHERE CASE WHEN na + nb - k > 0 THEN k / (na + nb - k) ELSE 0 END >= 0.1 OR name_a = name_b)"""


def _extracted(t: Tables) -> unify.Pathways:
    p = P.brand_pathways(t)
    return unify.Pathways(p.pathway, cut(p.gene), p.pair, None)


@query("guarded_matches", f"WITH {GUARDED} SELECT source_a, name_a, source_b, name_b, score, round(ratio, 6) AS ratio, round(overlap, 6) AS overlap FROM mt")
def guarded_matches(t: Tables) -> DataFrame:
    return unify.merge_pathways(_extracted(t)).matches.select(
        "source_a", "name_a", "source_b", "name_b", F.col("score").cast("long").alias("score"), F.round("ratio", 6).alias("ratio"),
        F.round("overlap", 6).alias("overlap"))


COMPONENTS = f"""{GUARDED}, nd AS (SELECT source_a || '|' || name_a AS a, source_b || '|' || name_b AS b FROM mt),
  bd AS (SELECT a, b FROM nd UNION SELECT b, a FROM nd),
  rc AS (SELECT a, b FROM bd UNION SELECT rc.a, bd.b FROM rc JOIN bd ON rc.b = bd.a),
  cm AS (SELECT a AS node, least(a, min(b)) AS comp FROM rc GROUP BY a),
  mem AS (SELECT u.source, u.name, coalesce(comp, u.source || '|' || u.name) AS grp FROM u LEFT JOIN cm ON node = u.source || '|' || u.name),
  ids AS (SELECT grp, 'IP' || upper(substr(sha1(string_agg(source || ':' || name, '|' ORDER BY source, name)), 1, 10)) AS set_id,
    arg_min(name, lpad(length(name)::VARCHAR, 6, '0') || source || ' ' || name) AS title, count(*) AS n_members FROM mem GROUP BY 1)"""


@query("integrated_sets", f"""WITH RECURSIVE {COMPONENTS}, gg AS (SELECT grp, count(DISTINCT gene) AS n_genes FROM mem JOIN pg USING (source, name) GROUP BY 1)
  SELECT set_id, title AS name, n_members, coalesce(n_genes, 0) AS n_genes FROM ids LEFT JOIN gg USING (grp)""")
def integrated_sets(t: Tables) -> DataFrame:
    out = unify.merge_pathways(_extracted(t))
    n = out.set_member.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_members"))
    return out.gset.join(n, "set_id").select("set_id", "name", "n_members", "n_genes")


@query("full_unification", f"""WITH RECURSIVE {COMPONENTS} SELECT set_id, gene, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
  FROM ids JOIN mem USING (grp) JOIN pg USING (source, name) GROUP BY 1, 2""")
def full_unification(t: Tables) -> DataFrame:
    return unify.merge_pathways(_extracted(t)).set_gene.select("set_id", "gene", joined("sources").alias("sources"))


@query("full_unification_pairs", f"""WITH RECURSIVE {COMPONENTS} SELECT set_id, 'S' || l_suppkey AS gene_a, 'P' || l_partkey AS gene_b,
  string_agg(DISTINCT CASE WHEN l_linestatus = 'F' THEN 'PPrel' ELSE 'GErel' END, ',' ORDER BY CASE WHEN l_linestatus = 'F' THEN 'PPrel' ELSE 'GErel' END) AS relations,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ids JOIN mem USING (grp)
  JOIN part ON p_brand = source AND p_name || ' ' || lower(p_type) = name JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def full_unification_pairs(t: Tables) -> DataFrame:
    return unify.merge_pathways(_extracted(t)).set_pair.select(
        "set_id", "gene_a", "gene_b", joined("relations").alias("relations"), joined("sources").alias("sources"))


@query("related_components", """WITH RECURSIVE e AS (SELECT 'C' || c_custkey AS a, 'S' || floor(c_acctbal)::BIGINT AS b FROM customer),
  bd AS (SELECT a, b FROM e UNION SELECT b, a FROM e), rc AS (SELECT a, b FROM bd UNION SELECT rc.a, bd.b FROM rc JOIN bd ON rc.b = bd.a)
  SELECT a AS node, least(a, min(b)) AS component FROM rc GROUP BY a""")
def related_components(t: Tables) -> DataFrame:
    return graph.connected_components(t.customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("S"), F.floor("c_acctbal")).alias("b")))


@query("stable_set_ids", """SELECT l_orderkey AS ord, 'ST' || upper(substr(sha1(string_agg(src || ':' || part, '|' ORDER BY src, part)), 1, 10)) AS set_id
  FROM (SELECT DISTINCT l_orderkey, l_returnflag AS src, l_partkey::VARCHAR AS part FROM lineitem) GROUP BY 1""")
def stable_set_ids(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("group"), F.col("l_returnflag").alias("source"),
                             F.col("l_partkey").cast("string").alias("member_id")).distinct()
    return unify.set_ids(rows, "ST").withColumnRenamed("group", "ord")


@query("clean_titles", r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
  SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+-\s+[A-Z][a-z]+ [a-z]+(\s+\([^)]*\))?\s*$', ''), '\s+', ' ', 'g')) AS title FROM p""")
def clean_titles(t: Tables) -> DataFrame:
    return P.page_titles(t).select("page_id", X.clean_name(F.col("title")).alias("title"))


# ---------------------------------------------------------------- identifiers
ALIAS = """ar AS (SELECT 'P' || p_partkey AS key, 'P' || p_partkey AS symbol, 'exact' AS kind FROM part
    UNION ALL SELECT upper(p_brand || ' ' || p_name || ' ' || p_type), 'P' || p_partkey, 'previous' FROM part
    UNION ALL SELECT upper(p_name || ' ' || p_type), 'P' || p_partkey, 'alias' FROM part),
  lk AS (SELECT key, min(symbol) FILTER (WHERE kind = 'exact') AS ex, min(symbol) FILTER (WHERE kind = 'previous') AS pl,
    max(symbol) FILTER (WHERE kind = 'previous') AS ph, min(symbol) FILTER (WHERE kind = 'alias') AS sl,
    max(symbol) FILTER (WHERE kind = 'alias') AS sh FROM ar GROUP BY 1)"""
RESOLVED = f"""{ALIAS}, ids AS (SELECT ' p' || l_partkey || ' ' AS ident FROM lineitem UNION SELECT 'P' || l_partkey || '-' || l_linenumber FROM lineitem
    UNION SELECT 'UniProtKB:P' || l_orderkey FROM lineitem UNION SELECT p_brand || ' ' || p_name || ' ' || p_type FROM part
    UNION SELECT p_name || ' ' || lower(p_type) FROM part),
  ky AS (SELECT ident, regexp_replace(upper(trim(ident)), '^UNIPROTKB:', '') AS k FROM ids),
  kk AS (SELECT ident, CASE WHEN k NOT IN (SELECT key FROM lk WHERE ex IS NOT NULL) AND contains(k, '-')
    AND split_part(k, '-', 1) IN (SELECT key FROM lk WHERE ex IS NOT NULL) THEN split_part(k, '-', 1) ELSE k END AS key FROM ky),
  rs AS (SELECT ident, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN pl = ph THEN 'previous' WHEN pl IS NOT NULL THEN 'ambiguous_previous'
    WHEN sl = sh THEN 'alias' WHEN sl IS NOT NULL THEN 'ambiguous_alias' ELSE 'unmapped' END AS how, ex, pl, sl FROM kk LEFT JOIN lk USING (key))"""


@query("alias_resolve", f"WITH {RESOLVED} SELECT ident, CASE how WHEN 'exact' THEN ex WHEN 'previous' THEN pl WHEN 'alias' THEN sl END AS symbol, how FROM rs")
def alias_resolve(t: Tables) -> DataFrame:
    return identifiers.resolve(P.alias_idents(t), identifiers.lookup_table(P.part_aliases(t)))


@query("alias_counts", f"WITH {RESOLVED} SELECT how, count(*) AS n FROM rs GROUP BY 1")
def alias_counts(t: Tables) -> DataFrame:
    return identifiers.resolution_counts(alias_resolve(t))


@query("alias_table", f"""WITH {ALIAS}, g AS (SELECT DISTINCT 'P' || l_partkey AS gene FROM lineitem)
  SELECT key AS alias, coalesce(CASE WHEN ex IN (SELECT gene FROM g) THEN ex END, CASE WHEN pl = ph AND pl IN (SELECT gene FROM g) THEN pl END,
    CASE WHEN sl = sh AND sl IN (SELECT gene FROM g) THEN sl END) AS symbol FROM lk
  WHERE ex IN (SELECT gene FROM g) OR (pl = ph AND pl IN (SELECT gene FROM g)) OR (sl = sh AND sl IN (SELECT gene FROM g))""")
def alias_table(t: Tables) -> DataFrame:
    genes = t.lineitem.select(P.part_gene("l_partkey").alias("gene"))
    return identifiers.alias_table(identifiers.lookup_table(P.part_aliases(t)), genes)


# ---------------------------------------------------------------- lookups, statistics, exports
@query("collection_histogram", f"WITH {SUPPLIER_SET} SELECT collection, count(*) AS n FROM gs GROUP BY 1")
def collection_histogram(t: Tables) -> DataFrame:
    return catalogue.collections(P.supplier_set(t))


@query("set_search", f"""WITH {SUPPLIER_SET}, {SUPPLIER_GENE}, m AS (SELECT set_id, name, collection, CASE WHEN lower(name) = 'nation_1' THEN 0 ELSE 1 END AS o1,
    CASE WHEN collection = 'pathway' THEN 0 WHEN collection LIKE 'GO:%' THEN 1 ELSE 3 END AS o2, length(name) AS o3, 0 AS o0 FROM gs
    WHERE name ILIKE '%P7%' OR set_id IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%P7%')),
  g AS (SELECT set_id, name, collection, 0, 0, 0, 1 FROM gs WHERE set_id IN (SELECT set_id FROM sg WHERE gene = 7) AND set_id NOT IN (SELECT set_id FROM m))
  SELECT set_id, name, collection FROM (SELECT * FROM m UNION ALL SELECT * FROM g) ORDER BY o0, o1, o2, o3, set_id LIMIT 50""")
def set_search(t: Tables) -> DataFrame:
    return _searched(t, " p7 ").select("set_id", "name", "collection")


@query("set_search_by_grams", f"""WITH {SUPPLIER_SET} SELECT set_id, name, collection FROM gs
    WHERE name ILIKE '%TION_1%' OR set_id IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%TION_1%')""")
def set_search_by_grams(t: Tables) -> DataFrame:
    return _searched(t, "tION_1", grams=True).select("set_id", "name", "collection")


def _searched(t: Tables, term: str, grams: bool = False) -> DataFrame:
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    member = place.select(F.col("s_suppkey").alias("set_id"), F.col("n_name").alias("name"))
    gene = P.supplier_gene(t).withColumn("gene", P.part_gene("gene"))
    sets = P.supplier_set(t).withColumn("sources", F.array()).withColumn("n_genes", F.lit(0))
    aliases = t.part.select(P.part_gene("p_partkey").alias("alias"), P.part_gene("p_partkey").alias("symbol"))
    return catalogue.search(sets, member, gene, aliases, term, grams=catalogue.name_grams(sets, member) if grams else None)


@query("gene_detail", f"WITH {SUPPLIER_GENE}, {SUPPLIER_SET} SELECT gene, set_id, name, collection, ns AS n_sources FROM sg JOIN gs USING (set_id) "
       "WHERE gene IN (SELECT p_partkey FROM part WHERE p_size = 50)")
def gene_detail(t: Tables) -> DataFrame:
    genes = t.part.where("p_size = 50").select(F.col("p_partkey").alias("gene"))
    return catalogue.sets_of_genes(P.supplier_set(t), P.supplier_gene(t), genes).select(
        "gene", "set_id", "name", "collection", F.size("sources").cast("long").alias("n_sources"))


@query("gene_partners", f"WITH {EDGE} SELECT gene_b AS gene, sources, n_sources, n_pmids, string_score, tier FROM tiered WHERE gene_a = 'P7' "
       "ORDER BY n_sources DESC, n_pmids DESC, gene LIMIT 25")
def gene_partners(t: Tables) -> DataFrame:
    return catalogue.partners(_edges(t), "P7", 25).withColumn("sources", joined("sources"))


@query("gene_degree", "SELECT gene, count(*) AS degree FROM (SELECT DISTINCT 'P' || l_partkey AS gene, 'S' || l_suppkey AS o FROM lineitem "
       "UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem) GROUP BY 1")
def gene_degree(t: Tables) -> DataFrame:
    return catalogue.gene_degree(_edges(t))


@query("pathway_diff", """WITH x AS (SELECT DISTINCT p_name || ' ' || p_type AS gene FROM part WHERE p_brand = 'Brand#1'),
  y AS (SELECT DISTINCT upper(p_name || ' ' || p_type) AS gene FROM part WHERE p_brand = 'Brand#2')
  SELECT 'a' AS side, gene FROM x WHERE lower(gene) NOT IN (SELECT lower(gene) FROM y)
  UNION ALL SELECT 'b', gene FROM y WHERE lower(gene) NOT IN (SELECT lower(gene) FROM x)""")
def pathway_diff(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    return catalogue.symmetric_difference(t.part.where("p_brand = 'Brand#1'").select(name.alias("gene")),
                                          t.part.where("p_brand = 'Brand#2'").select(F.upper(name).alias("gene")))


@query("source_stats", """WITH x AS (SELECT p_brand AS source, p_name || ' ' || lower(p_type) AS name, l_suppkey AS g, l_partkey AS b FROM part LEFT JOIN lineitem ON l_partkey = p_partkey)
  SELECT source, count(DISTINCT name) AS pathways, count(DISTINCT g) AS genes, count(DISTINCT (g, b)) FILTER (WHERE g IS NOT NULL) AS gene_pairs,
    round(count(DISTINCT (name, g)) FILTER (WHERE g IS NOT NULL) / count(DISTINCT name), 6) AS mean_genes_per_pathway,
    round(count(DISTINCT (name, g, b)) FILTER (WHERE g IS NOT NULL) / count(DISTINCT name), 6) AS mean_pairs_per_pathway FROM x GROUP BY 1""")
def source_stats(t: Tables) -> DataFrame:
    p = P.brand_pathways(t)
    return catalogue.source_stats(p.pathway, p.gene, p.pair).withColumn(
        "mean_genes_per_pathway", F.round("mean_genes_per_pathway", 6)).withColumn("mean_pairs_per_pathway", F.round("mean_pairs_per_pathway", 6))


@query("set_stats", f"""WITH {CUSTOMER_PAIR}, {CUSTOMER_GENE}, n AS (SELECT count(*) AS n FROM customer), m AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)
  SELECT 'sets' AS metric, n::DOUBLE AS value FROM n UNION ALL SELECT 'merged_sets', count(*) FROM m WHERE c > 1
  UNION ALL SELECT 'members_in_merged_sets', sum(c) FROM m WHERE c > 1 UNION ALL SELECT 'genes', count(DISTINCT gene) FROM cg
  UNION ALL SELECT 'gene_pairs', count(DISTINCT (gene_a, gene_b)) FROM cp UNION ALL SELECT 'mean_genes_per_set', round((SELECT count(*) FROM cg) / n, 6) FROM n
  UNION ALL SELECT 'mean_pairs_per_set', round((SELECT count(*) FROM cp) / n, 6) FROM n""")
def set_stats(t: Tables) -> DataFrame:
    member = t.orders.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("source_set_id"))
    return catalogue.set_stats(P.customer_set(t), member, P.customer_gene(t), P.customer_pair(t)).withColumn("value", F.round("value", 6))


SUBGRAPH = f"""{CUSTOMER_PAIR}, {EDGE}, {CUSTOMER_GENE}, inn AS MATERIALIZED ({_INNER}),
  ce AS MATERIALIZED (SELECT set_id, gene_a AS source, gene_b AS target, 'curated' AS kind FROM cp
    UNION ALL SELECT set_id, gene_a, gene_b, 'ppi' FROM inn ANTI JOIN cp USING (set_id, gene_a, gene_b)),
  dg AS (SELECT set_id, gene, count(*) AS degree FROM (SELECT set_id, source AS gene FROM ce UNION ALL SELECT set_id, target FROM ce) GROUP BY 1, 2),
  nd AS (SELECT set_id, gene, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY set_id ORDER BY coalesce(degree, 0) DESC, gene) AS rank
    FROM cg LEFT JOIN dg USING (set_id, gene))"""


def _maps(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = cut(P.customer_lines(t))
    gene = cut(P.customer_gene(t, lines))
    wired = cut(subgraph.set_edges(gene, P.customer_pair(t, lines), _edges(t), "high"))
    return subgraph.set_graphs(gene, wired, P.pair_query(t))


@query("subgraph_nodes", f"WITH {SUBGRAPH}, {PAIR_QUERY} SELECT set_id, gene, degree, rank, gene IN (SELECT gene FROM q) AS hit FROM nd")
def subgraph_nodes(t: Tables) -> DataFrame:
    return _maps(t)[0].select("set_id", "gene", "degree", F.col("rank").cast("long").alias("rank"), "hit")


@query("subgraph_edges", f"WITH {SUBGRAPH} SELECT set_id, source, target, kind FROM ce")
def subgraph_edges(t: Tables) -> DataFrame:
    return _maps(t)[1].select("set_id", "source", "target", "kind")


@query("set_distances", f"""WITH RECURSIVE {EDGE}, bd AS MATERIALIZED (SELECT gene_a AS a, gene_b AS b FROM tiered UNION SELECT gene_b, gene_a FROM tiered),
  v(gene, d) USING KEY (gene) AS (SELECT DISTINCT 'P' || p_partkey, 0 FROM part WHERE p_size = 1
    UNION SELECT DISTINCT b, d + 1 FROM v JOIN bd ON v.gene = a WHERE b NOT IN (SELECT gene FROM recurring.v)), {CUSTOMER_PAIR}, {CUSTOMER_GENE}
  SELECT set_id, coalesce(min(d), -1) AS distance FROM cg LEFT JOIN v USING (gene) GROUP BY 1""")
def set_distances(t: Tables) -> DataFrame:
    start = t.part.where("p_size = 1").select(P.part_gene("p_partkey").alias("gene"))
    return graph.set_distances(start, _edges(t), P.customer_gene(t))


@query("hierarchy_links", """WITH m AS (SELECT 'O:' || o_orderkey AS id, o_custkey AS set_id FROM orders UNION ALL SELECT 'L:' || l_orderkey || ':' || l_linenumber, l_suppkey + 1000000 FROM lineitem),
  e AS (SELECT DISTINCT x.set_id AS a, y.set_id AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN m x ON x.id = 'L:' || l_orderkey || ':' || l_linenumber
    JOIN m y ON y.id = 'O:' || l_orderkey WHERE x.set_id <> y.set_id)
  SELECT a AS set_a, b AS set_b FROM e UNION SELECT b, a FROM e""")
def hierarchy_links(t: Tables) -> DataFrame:
    line = F.concat_ws(":", F.lit("L"), "l_orderkey", "l_linenumber")
    member = t.orders.select(F.lit("s").alias("source"), F.concat(F.lit("O:"), "o_orderkey").alias("source_set_id"), F.col("o_custkey").alias("set_id")) \
        .union(t.lineitem.select(F.lit("s"), line, F.col("l_suppkey") + 1000000))
    parent = t.lineitem.select(F.lit("s").alias("source"), line.alias("child_id"), F.concat(F.lit("O:"), "l_orderkey").alias("parent_id")).distinct()
    return unify.link_hierarchy(member, parent)


@query("gmt_export", f"""WITH {SUPPLIER_GENE}, {SUPPLIER_SET} SELECT set_id, set_id || chr(9) || name || chr(9) || string_agg(gene::VARCHAR, chr(9) ORDER BY gene::VARCHAR) AS line
  FROM gs JOIN sg USING (set_id) GROUP BY set_id, name""")
def gmt_export(t: Tables) -> DataFrame:
    return release.gmt_lines(P.supplier_set(t), P.supplier_gene(t))


@query("interaction_routing", f"""WITH {CUSTOMER_PAIR}, {CUSTOMER_GENE},
  i AS (SELECT DISTINCT 'P' || l_partkey AS gene_a, 'S' || l_suppkey AS gene_b, l_returnflag || l_linenumber AS ctx,
    CASE WHEN l_linestatus = 'F' THEN 'PPrel' ELSE 'GErel' END AS rel FROM lineitem),
  cx AS (SELECT 'A' || s_suppkey AS ctx, 'N:' || s_nationkey AS sid FROM supplier),
  pl AS (SELECT sid, gene_a, gene_b, 'GPrel' AS rel FROM i JOIN cx USING (ctx)
    UNION SELECT 'C:' || a.set_id, gene_a, gene_b, rel FROM i JOIN cg a ON a.gene = gene_a JOIN cg b ON b.gene = gene_b AND a.set_id = b.set_id
    WHERE ctx NOT IN (SELECT ctx FROM cx)),
  up AS (SELECT 'C:' || c_custkey AS sid, 'N:' || c_nationkey AS anc FROM customer UNION SELECT 'C:' || c_custkey, 'C:' || c_custkey FROM customer
    UNION SELECT 'N:' || n_nationkey, 'N:' || n_nationkey FROM nation)
  SELECT DISTINCT anc AS source_id, gene_a, gene_b, rel AS relation FROM pl JOIN up USING (sid)""")
def interaction_routing(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat_ws(":", F.lit(p), F.col(c).cast("string"))
    rows = t.lineitem.select(
        P.part_gene("l_partkey").alias("gene_a"), P.supp_gene("l_suppkey").alias("gene_b"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("context"),
        F.when(F.col("l_linestatus") == "F", "PPrel").otherwise("GErel").alias("relation"))
    complexes = t.supplier.select(F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("complex"), key("N", "s_nationkey").alias("source_id"))
    lowest = P.customer_gene(t).select(key("C", "set_id").alias("source_id"), "gene")
    edges = t.customer.select(key("C", "c_custkey").alias("child"), key("N", "c_nationkey").alias("parent"))
    nodes = edges.select("child").union(t.nation.select(key("N", "n_nationkey")))
    return pathways.route_interactions(rows, complexes, lowest, graph.with_self(graph.ancestors(edges), nodes))


@query("collection_equivalents", """WITH r AS (SELECT 'SET ' || l_orderkey AS nm, 'O:' || l_orderkey AS src, 'P' || l_partkey AS gene FROM lineitem),
  g AS (SELECT DISTINCT nm, src, gene FROM r JOIN part ON 'P' || p_partkey = gene), n AS (SELECT nm, count(*) AS n FROM g GROUP BY 1),
  ow AS (SELECT DISTINCT o_custkey AS set_id, 'P' || l_partkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  no AS (SELECT set_id, count(*) AS m FROM ow GROUP BY 1), h AS (SELECT DISTINCT nm, o_custkey AS set_id FROM r JOIN orders ON src = 'O:' || o_orderkey),
  k AS (SELECT h.nm, count(*) AS k FROM h JOIN g USING (nm) JOIN ow ON ow.set_id = h.set_id AND ow.gene = g.gene GROUP BY 1)
  SELECT nm AS msigdb_name, 'M' || substr(nm, 5) AS systematic_name, 'C2' AS collection, set_id, round(coalesce(k, 0) / (coalesce(n, 0) + m - coalesce(k, 0)), 4) AS jaccard
  FROM h LEFT JOIN n USING (nm) LEFT JOIN no USING (set_id) LEFT JOIN k USING (nm)""")
def collection_equivalents(t: Tables) -> DataFrame:
    order = F.col("l_orderkey").cast("string")
    rows = t.lineitem.select(
        F.concat(F.lit("SET "), order).alias("set_name"), F.concat(F.lit("O:"), order).alias("exact_source"), F.concat(F.lit("M"), order).alias("systematic_name"),
        F.lit("C2").alias("collection"), P.part_gene("l_partkey").alias("gene"))
    member = t.orders.select(F.col("o_custkey").alias("set_id"), F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("source_set_id"))
    owned = P.customer_gene(t).where(F.col("gene").startswith("P"))
    lookup = cut(identifiers.lookup_table(P.part_aliases(t)))
    return pathways.msigdb_sets(rows, lookup, "link", member, owned)[0]


@query("review_decisions", f"""WITH {UNITS}, cur AS (SELECT x, y, arg_max(d, pos) AS d FROM (SELECT DISTINCT 'cold ' || substr(name, 5) AS x, name AS y, 1 AS pos,
      CASE WHEN name LIKE '%promo' THEN 'merge' ELSE 'separate' END AS d FROM un WHERE name LIKE 'old %'
    UNION ALL SELECT DISTINCT 'cold ' || substr(name, 5), name, 2, 'separate' FROM un WHERE name LIKE 'old %' AND length(name) % 3 = 0) GROUP BY 1, 2),
  dec AS (SELECT source_a, name_a, source_b, name_b, CASE WHEN name_a = name_b OR d = 'merge' THEN 'accept' WHEN d IS NULL THEN 'pending' ELSE 'reject' END AS decision
    FROM hit LEFT JOIN cur ON least(name_a, name_b) = x AND greatest(name_a, name_b) = y)
  SELECT * FROM dec""")
def review_decisions(t: Tables) -> DataFrame:
    units = cut(matching.name_units(P.brand_pathways(t).pathway))
    old = units.where("name LIKE 'old %'").select("name").distinct()
    reviewed = old.select(F.concat(F.lit("cold "), F.substring("name", 5, 100)).alias("name_a"), F.col("name").alias("name_b"),
                          F.when(F.col("name").endswith("promo"), "merge").otherwise("separate").alias("decision"), F.lit("").alias("reason"),
                          F.lit(1).alias("pos"))
    # some pairs are named again, the other way round: the later row counts
    again = reviewed.where(F.length("name_b") % 3 == 0).select(
        F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), F.lit("separate").alias("decision"), "reason", F.lit(2).alias("pos"))
    return matching.review(matching.best_hits(units), reviewed.unionByName(again)).select("source_a", "name_a", "source_b", "name_b", "decision")


# ---------------------------------------------------------------- file readers
QUERIES |= source_queries.QUERIES
ORACLE |= source_queries.ORACLE
