"""Requests against a written release: the analyses and lookups a caller runs by organism."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, enrich, identifiers, network, ranked, subgraph, themes
from ..session import cut
from ..sources import drawings, release

# Largest inputs of one request; larger ones are refused, results are never cut.
MAX_GENES, MAX_BACKGROUND, MAX_SIZE = 20_000, 60_000, 5000
NPERM = (100, 2000)


class Library:
    """One organism's release tables, read lazily."""

    def __init__(self, spark: SparkSession, folder: str, organism: str) -> None:
        self.spark, self.folder, self.organism = spark, folder, organism

    def table(self, name: str) -> DataFrame:
        return release.read(self.spark, self.folder, self.organism, name)

    @cached_property
    def aliases(self) -> DataFrame:
        """Aliases and symbols in upper case; the symbol itself always wins."""
        gene = self.table("gene").select(F.upper("symbol").alias("alias"), "symbol", F.lit(0).alias("o"))
        return gene.union(self.table("alias").select("alias", "symbol", F.lit(1))).groupBy("alias").agg(
            F.min_by("symbol", F.struct("o", "symbol")).alias("symbol"))

    def resolve(self, idents: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
        if len(idents) > limit:
            raise ValueError(f"at most {limit} identifiers per request")
        rows = self.spark.createDataFrame([(str(x), i) for i, x in enumerate(idents)], "ident string, pos long")
        return identifiers.resolve_query(rows, self.aliases)

    def _report(self, result: DataFrame, order: list, found: DataFrame, missing: DataFrame, n: int) -> dict:
        return {"n_input": n, "n_mapped": found.count(), "unmapped": missing.orderBy("pos").select("ident"),
                "results": result.orderBy(*order)}

    def ora(self, genes: list[str], background: list[str] | None = None, collections: list[str] | None = None, *,
            min_size: int = 5, max_size: int = 2000, alpha: float = 0.05) -> dict:
        """Over-representation with hit genes and themes; ``results`` is the whole DataFrame."""
        if max_size > MAX_SIZE:
            raise ValueError(f"max_size is at most {MAX_SIZE}")
        found, missing = self.resolve(genes, MAX_GENES)
        query = found.select(F.col("symbol").alias("gene"))
        back = self.resolve(background, MAX_BACKGROUND)[0].select(F.col("symbol").alias("gene")) if background else None
        member = self.table("set_gene")
        result = cut(enrich.ora(query, self.table("gset"), member, background=back, collections=collections,
                                min_size=min_size, max_size=max_size))
        order = [F.asc("p"), F.desc("overlap"), F.asc("set_id")]
        named = themes.themes(result, member, self.table("set_link"), order=order, alpha=alpha)
        return self._report(enrich.with_genes(named, enrich.ora_hits(result, query, member, back)), order, found, missing, len(genes))

    def pairs(self, genes: list[str], collections: tuple[str, ...] = ("pathway",), tier: str | None = None) -> dict:
        """Pair enrichment; ``tier`` (high, medium, low, string) adds network edges inside each set."""
        found, missing = self.resolve(genes, MAX_GENES)
        edges = None
        if tier == "string":
            edges = self.table("string_ppi")
        elif tier:
            edges = network.up_to_tier(self.table("ppi"), tier)
        result = enrich.pair_ora(found.select(F.col("symbol").alias("gene")), self.table("gset"), self.table("set_pair"),
                                 set_gene=self.table("set_gene"), edges=edges, collections=collections)
        return self._report(result, [F.asc("p"), F.asc("set_id")], found, missing, len(genes))

    def gsea(self, ranking: list[tuple[str, float]], collections: list[str] | None = None, *, nperm: int = 1000,
             min_size: int = 15, max_size: int = 500, seed: int = 0, alpha: float = 0.05) -> dict:
        """Preranked enrichment; of identifiers that name one gene the first counts."""
        if not NPERM[0] <= nperm <= NPERM[1] or len(ranking) > MAX_BACKGROUND:
            raise ValueError("request outside the service limits")
        found, missing = self.resolve([g for g, _ in ranking], MAX_BACKGROUND)
        score = self.spark.createDataFrame([(i, float(v)) for i, (_, v) in enumerate(ranking)], "pos long, score double")
        rows = found.join(score, "pos").select(F.col("symbol").alias("gene"), "score", F.col("pos").alias("input_pos"))
        member = self.table("set_gene")
        result = cut(ranked.gsea(rows, self.table("gset"), member, collections=collections, nperm=nperm, min_size=min_size,
                                 max_size=max_size, seed=seed))
        order = [F.asc("p"), F.abs("nes").desc(), F.asc("set_id")]
        return self._report(themes.themes(result, member, self.table("set_link"), order=order, alpha=alpha), order, found, missing, len(ranking))

    def collections(self) -> DataFrame:
        return catalogue.collections(self.table("gset")).orderBy("collection")

    def search(self, term: str, limit: int | None = None) -> DataFrame:
        return catalogue.search(self.table("gset"), self.table("set_member"), self.table("set_gene"), self.aliases, term, limit,
                                self.table("name_gram"))

    def set_detail(self, set_id: str) -> dict[str, DataFrame]:
        return catalogue.set_detail(set_id, self.table("gset"), self.table("set_member"), self.table("set_gene"),
                                    self.table("set_pair"), self.table("set_link"), self.table("msigdb_equivalent"))

    def drawings(self, set_id: str) -> DataFrame:
        """(set_id, source, id, name, focus): the stored drawings of a set's members; ``focus`` is the sub-pathway to show."""
        member = self.table("set_member").where(F.col("set_id") == set_id)
        return drawings.drawings_of_sets(member, self.table("diagram"), self.table("diagram_of")).orderBy("source", "id", "focus")

    def drawing(self, source: str, id_: str) -> str:
        """One drawing as JSON text: nodes, edges and, for layouts, the nodes of each sub-pathway."""
        row = self.table("diagram").where((F.col("source") == source) & (F.col("source_set_id") == id_)).select("data").first()
        if row is None:
            raise KeyError(f"{source} {id_}")
        return row["data"]

    def stats(self) -> DataFrame:
        return self.table("stats").orderBy("metric", "key")

    def gene_detail(self, symbol: str, limit: int | None = None) -> dict[str, DataFrame]:
        found, _ = self.resolve([symbol], 1)
        row = found.first()
        if row is None:
            raise KeyError(symbol)
        one = found.select(F.col("symbol").alias("gene"))
        return {"sets": catalogue.sets_of_genes(self.table("gset"), self.table("set_gene"), one).orderBy("collection", "name"),
                "ppi_partners": catalogue.partners(self.table("ppi"), row["symbol"], limit),
                "string_partners": catalogue.string_partners(self.table("string_ppi"), row["symbol"], limit)}

    def map(self, set_id: str, kind: str = "cyjs", tier: str | None = None, genes: list[str] | None = None,
            max_nodes: int | None = None) -> str:
        """One set's map as Cytoscape JSON, SBML-qual or SBGN text."""
        one = lambda name: self.table(name).where(F.col("set_id") == set_id)
        head, member = one("gset"), one("set_gene")
        if head.isEmpty():
            raise KeyError(set_id)
        hits = self.resolve(genes, MAX_GENES)[0].select(F.col("symbol").alias("gene")) if genes else None
        edges = self.table("string_ppi").withColumn("tier", F.lit("high")) if tier == "string" else (self.table("ppi") if tier else None)
        wired = subgraph.set_edges(member, one("set_pair"), edges, "high" if tier == "string" else tier)
        nodes, shown = subgraph.set_graphs(member, wired, hits, max_nodes)
        write = {"cyjs": lambda: subgraph.to_cytoscape(head, nodes, shown), "sbml": lambda: subgraph.to_sbml(head, nodes, shown),
                 "sbgn": lambda: subgraph.to_sbgn(head, nodes, shown)}[kind]
        return write().first()[1]
