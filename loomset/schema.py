"""Vocabularies and the column layout of every table the package exchanges.

Collections travel as arrays inside Spark; only the text sinks join them into one cell.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Unified relation vocabulary and the meaning of each class.
RELATIONS = {
    "ECrel": "enzymes catalysing successive reaction steps",
    "PPrel": "protein-protein relation",
    "GErel": "transcription factor and its target",
    "GPrel": "members of one complex or group",
    "PPI": "physical interaction from an interaction database",
}
# Relations drawn without a direction.
UNDIRECTED_RELATIONS = ("GPrel", "PPI")
# Interaction feeds that count as experimental evidence.
EXPERIMENTAL_SOURCES = ("BioGRID", "IntAct", "MINT", "HuRI")
# Cumulative confidence tiers, strongest first.
TIER_RANK = {"high": 0, "medium": 1, "low": 2}
# Ontology namespaces and the collection each becomes.
NAMESPACE_COLLECTION = {
    "biological_process": "GO:BP",
    "molecular_function": "GO:MF",
    "cellular_component": "GO:CC",
}
# Sources that may only be used in a full (not public) build.
RESTRICTED_SOURCES = ("KEGG", "BioCyc")
# Sources with a curated hierarchy, never merged within themselves in guarded mode.
HIERARCHICAL_SOURCES = ("Reactome", "GO")

_S = T.StringType()
_A = T.ArrayType(T.StringType())


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


SRC_PATHWAY = _struct(source=_S, name=_S, source_id=_S, pos=T.LongType())
SRC_GENE = _struct(source=_S, name=_S, gene=_S)
SRC_PAIR = _struct(source=_S, name=_S, gene_a=_S, gene_b=_S, relation=_S)
SRC_PARENT = _struct(source=_S, child_id=_S, parent_id=_S)
ALIAS = _struct(key=_S, symbol=_S, tier=T.IntegerType(), pos=T.LongType())
CURATION = _struct(name_a=_S, name_b=_S, decision=_S, reason=_S)

RELEASE = {
    "meta": _struct(key=_S, value=_S),
    "gene": _struct(symbol=_S, gene_id=_S),
    "alias": _struct(alias=_S, symbol=_S),
    "gset": _struct(set_id=_S, name=_S, collection=_S, sources=_A, n_genes=T.LongType(), n_pairs=T.LongType()),
    "set_member": _struct(set_id=_S, source=_S, source_set_id=_S, name=_S, description=_S),
    "set_gene": _struct(set_id=_S, gene=_S, sources=_A),
    "set_pair": _struct(set_id=_S, gene_a=_S, gene_b=_S, relations=_A, sources=_A),
    "set_link": _struct(set_a=_S, set_b=_S),
    "ppi": _struct(gene_a=_S, gene_b=_S, sources=_A, n_sources=T.LongType(), n_pmids=T.LongType(), methods=_A,
                   string_score=T.IntegerType(), tier=_S, pathway_sets=_A),
    "string_ppi": _struct(gene_a=_S, gene_b=_S, sources=_A, n_sources=T.LongType(), n_pmids=T.LongType(),
                          methods=_A, string_score=T.IntegerType(), tier=_S, pathway_sets=_A),
    "msigdb_equivalent": _struct(msigdb_name=_S, systematic_name=_S, collection=_S, set_id=_S,
                                 jaccard=T.DoubleType()),
    "match_log": _struct(source_a=_S, name_a=_S, source_b=_S, name_b=_S, score=T.IntegerType(),
                         ratio=T.DoubleType(), overlap=T.DoubleType(), decision=_S, reason=_S),
    "stats": _struct(metric=_S, key=_S, value=T.DoubleType()),
    "name_gram": _struct(gram=_S, set_id=_S),
    "diagram": _struct(source=_S, source_set_id=_S, name=_S, data=_S),
    "diagram_of": _struct(source=_S, source_set_id=_S, diagram_id=_S),
}
